"""Line deduplication by a segment-partition edit join (5); DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, documents, numbered

EDITS, SHORTEST = 2, 24
#: ASCII letters whose counts, modulo 16, tell most lines apart before their texts are compared; as many as a long has room for.
COUNTED = ("etaoinsrhldcump", "fgwybvkxjqz .,;", "0123456789-_/:#")
_BLANK = " \t\r\x0b\x0c"
#: Lines whose numbers are sent to every task to fetch their texts; above it the texts are shuffled instead.
FETCH = 500_000
#: Segments that a hundred of so many lines, drawn by hash, share are hot: their rows are dealt out over so many groups.
DRAWN, SHARED, SALTS = 100_000, 100, 64
#: Blocks of a line that are looked for in another one before the two are compared.
BLOCKS = 16
#: Rounds in which the lines of a segment meet one of them only, before all that are left meet each other.
STARS = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edits between two arrays of characters, exact up to ``edits`` and above it otherwise; ``a`` must not be the shorter one.

    Bit-parallel within a band: bit k of a column's word is the row ``k -
    edits`` below the diagonal.  Words hold where the distance steps up and
    down from row to row.  Beyond the band steps count as up, which no path of
    few edits takes.  The distance adds up along the last cell's diagonal.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    lit = lambda x: F.lit(x).cast("long")
    d = (F.size(a) - F.size(b)).cast("int")

    def step(acc: Column, j: Column) -> Column:
        # The window moves down by a row.
        up = F.shiftright(acc["up"], 1).bitwiseOR(lit(top))
        down = F.shiftright(acc["down"], 1)

        def column(c: Column) -> Column:
            equal = [F.when(F.get(a, j + (k - edits)) == c, lit(1 << k)).otherwise(lit(0)) for k in range(width)]
            total = equal[0]
            for x in equal[1:]:
                total = total + x
            return total

        def rows(v: Column) -> Column:
            up, x = v["up"], v["eq"].bitwiseOR(v["down"])
            return F.struct(
                ((x.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(x).bitwiseAND(lit(mask)).alias("d0"), up.alias("up"), v["down"].alias("down")
            )

        def across(v: Column) -> Column:
            right = v["down"].bitwiseOR(F.bitwise_not(v["d0"].bitwiseOR(v["up"])))
            return F.struct(
                F.shiftleft(right, 1).bitwiseOR(lit(1)).bitwiseAND(lit(mask)).alias("right"),
                F.shiftleft(v["d0"].bitwiseAND(v["up"]), 1).bitwiseAND(lit(mask)).alias("left"),
                v["d0"].alias("d0"),
            )

        def done(v: Column) -> Column:
            return F.struct(
                v["left"].bitwiseOR(F.bitwise_not(v["d0"].bitwiseOR(v["right"]))).bitwiseAND(lit(mask)).alias("up"),
                v["right"].bitwiseAND(v["d0"]).alias("down"),
                (acc["far"] + 1 - F.call_function("shiftright", v["d0"], d + edits).bitwiseAND(lit(1)).cast("int")).alias("far"),
            )

        start = F.struct(let(F.get(b, j), column).alias("eq"), up.alias("up"), down.alias("down"))
        return let(let(let(start, rows), across), done)

    # Before the first column rows above the text step down, the others up.
    low = (1 << (edits + 1)) - 1
    first = F.struct(lit(mask ^ low).alias("up"), lit(low).alias("down"), d.alias("far"))
    run = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), first, step, lambda acc: acc["far"])
    return F.when(F.abs(d) > edits, F.lit(edits + 1)).when(F.size(b) == 0, F.size(a)).otherwise(run)


def index_places(edits: int) -> list[tuple[int, int, int]]:
    """(gap, segment, move) of the ``edits + 1`` segments under which a line is indexed."""
    return [(0, i, 0) for i in range(1, edits + 2)]


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(gap, segment, move) of the substrings under which a line may find a line shorter by ``gap``.

    If two lines are at most ``edits`` apart, some segment i of the shorter one
    occurs in the longer one with at most i - 1 edits before it and the rest
    behind it, so that it is moved by few places only.  Of two lines of one
    length either may probe, so moves forward are enough, and unmoved ones are
    the index itself.
    """
    found = []
    for gap in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), gap - (edits + 1 - i))
            found += [(gap, i, move) for move in range(low if gap else 1, min(i - 1, gap + edits + 1 - i) + 1)]
    return found


def keyed(lines: DataFrame, edits: int, shortest: int) -> DataFrame:
    """(key, who): a row for each segment under which a line is indexed, and for each substring by which it probes (who is odd).

    The places are the rows' own columns, so one short expression serves all
    of them.  Of the segments of a length the last ones are longer by one; keys
    hold the segment's number and the length it was cut for.  Four bytes for
    each character let every segment be cut out without a walk along the line.
    """
    parts = edits + 1
    places = [(False, *x) for x in index_places(edits)] + [(True, *x) for x in probe_places(edits)]
    each = F.inline(F.array(*[F.struct(F.lit(probe).alias("probe"), F.lit(gap).alias("gap"), F.lit(i).alias("i"), F.lit(move).alias("move")) for probe, gap, i, move in places]))
    x = lines.select("h1", F.encode("line", "UTF-32").alias("wide")).where(F.octet_length("wide") >= 4 * shortest)
    x = x.select("h1", "wide", F.expr("cast(octet_length(wide) div 4 as int)").alias("length"), each).withColumn("l", F.col("length") - F.col("gap"))
    x = x.withColumn("short", F.expr(f"cast(l div {parts} as int)"))
    early = F.col("i") - 1 - (parts - (F.col("l") - F.col("short") * parts))  # how many of the longer segments come before
    at = (F.col("i") - 1) * F.col("short") + F.greatest(F.lit(0), early) + F.col("move")
    n = F.col("short") + F.when(early >= 0, 1).otherwise(0)
    return x.select(F.xxhash64("i", "l", F.substring(F.col("wide"), 4 * at + 1, 4 * n)).alias("key"), F.when(F.col("probe"), F.col("h1") + 1).otherwise(F.col("h1")).alias("who"))


def _trimmed(line: str) -> Column:
    """The line without white space around it; few lines have any behind them, and looking for it there is dear."""
    behind = F.lit(False)
    for c in _BLANK:
        behind = behind | F.endswith(F.col(line), F.lit(c))
    left = F.ltrim(F.col(line), F.lit(_BLANK))
    return F.when(behind, F.rtrim(left, F.lit(_BLANK))).otherwise(left)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line): every line that is not blank, without the white space around it."""
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "line"))
    return lines.select("id", "pos", _trimmed("line").alias("line")).where("line <> ''")


def first_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, id, pos, line): each line once, at its first place.  A line's rows are one for each task before any shuffle.

    h1, a line's number from here on, is even; lines that share one are told apart by their places.
    """
    rows = _rows(docs, id_col, text_col)
    first = rows.groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.min(F.struct("id", "pos", "line")).alias("first"))
    return first.select(F.col("h1").bitwiseAND(F.lit(-2)).alias("h1"), "first.*")


def crowds(lines: Scratch, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(key, who): the rows whose key an indexed line shares with another line.

    Index and probes are dealt out by key once; the one shuffle is counted up
    and then read again for the keys that are shared.  A key that many lines
    hold is hot: ``DRAWN`` lines tell which those are, at most some thousands,
    and their rows go to ``SALTS`` groups, all of them kept.
    """
    rows = keyed(lines.df, edits, shortest)
    # Lines lie dealt out by hash, so a few files are a fair draw.
    files, total = sorted(lines.df.inputFiles()), lines.df.count()
    few = files[: -(-len(files) * DRAWN // max(DRAWN, total))]
    hot = Scratch(keyed(lines.spark.read.schema(lines.schema).parquet(*few), edits, shortest).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("key"))
    group = ["key"]
    if hot.df.count():
        rows = rows.join(F.broadcast(hot.df.withColumn("hot", F.lit(True))), "key", "left")
        rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.shiftright("who", 1), F.lit(SALTS)).cast("int")).otherwise(-1))
        group.append("salt")
    # Some hundred thousand rows for each task, as far as the session's number of partitions lets there be so many.
    parts = min(4 * int(lines.spark.conf.get("spark.sql.shuffle.partitions")), len(index_places(edits) + probe_places(edits)) * total // 100_000 + 1)
    rows = rows.select(*group, "who").repartition(parts, *group)
    # Rows of one line differ in the last bit only.
    line = F.shiftright("who", 1)
    counts = rows.groupBy(*group).agg(F.min(line).alias("one"), F.max(line).alias("two"), F.min(F.col("who").bitwiseAND(F.lit(1))).alias("probes"))
    counts = counts.where("one <> two AND probes = 0" + " OR salt >= 0" * (len(group) > 1)).select(*group)
    return rows.join(counts.hint("shuffle_hash"), group).select("key", "who")


def _letters(line: str, letters: str) -> Column:
    """Counts of some letters, modulo 16, side by side in a long."""
    counts = F.lit(0).cast("long")
    for k, c in enumerate(letters):
        counts = counts + F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(15)).cast("long"), 4 * k)
    return counts


def _alike(a: str, b: str, edits: int) -> Column:
    """Whether lengths and letters of two lines allow that they are ``edits`` apart; each edit changes two counts at most."""
    apart = F.lit(0)
    for name, letters in enumerate(COUNTED):
        for k in range(len(letters)):
            off = (F.shiftright(f"{a}.letters{name}", 4 * k) - F.shiftright(f"{b}.letters{name}", 4 * k)).bitwiseAND(F.lit(15).cast("long"))
            apart = apart + F.least(off, 16 - off)
    return (F.abs(F.col(f"{a}.length") - F.col(f"{b}.length")) <= edits) & (apart <= 2 * edits)


def _compared(a: str, b: str, edits: int) -> Column:
    """A struct of two lines: found, how many blocks of the shorter one lie in the longer one, moved by ``edits`` places at most, and both without the blocks that they begin and end with in common.

    An edit falls into one block, so near lines have all but ``edits`` found;
    lines that differ in many places mostly do not.  What lines begin and end
    with in common does not change how far apart they are.
    """
    wide = [F.encode(x, "UTF-32") for x in (a, b)]
    swap = F.octet_length(wide[0]) < F.octet_length(wide[1])
    both = F.struct(F.when(swap, wide[0]).otherwise(wide[1]).alias("short"), F.when(swap, wide[1]).otherwise(wide[0]).alias("long"))
    cut = lambda text, at, size: F.substring(text, 4 * at + 1, 4 * size)

    def sized(s: Column) -> Column:
        n = F.floor(F.octet_length(s["short"]) / 4).cast("int")
        return F.struct(s["short"].alias("short"), s["long"].alias("long"), n.alias("n"), (F.floor(F.octet_length(s["long"]) / 4).cast("int") - n).alias("more"))

    def blocks(s: Column) -> Column:
        def block(i: Column) -> Column:
            at = lambda k: F.floor(k * s["n"].cast("long") / BLOCKS).cast("int")
            return let(F.struct(at(i).alias("at"), at(i + 1).alias("to")), lambda x: let(F.struct(x["at"].alias("at"), x["to"].alias("to"), cut(s["short"], x["at"], x["to"] - x["at"]).alias("piece")), seen))

        def seen(x: Column) -> Column:
            here = lambda move: (x["at"] + move >= 0) & (cut(s["long"], x["at"] + move, x["to"] - x["at"]) == x["piece"])
            moved = F.lit(False)
            for move in range(-edits, edits + 1):
                moved = moved | here(F.lit(move))
            return F.struct(x["at"].alias("at"), x["to"].alias("to"), moved.alias("moved"), here(F.lit(0)).alias("first"), here(s["more"]).alias("last"))

        return F.struct(s["short"].alias("short"), s["long"].alias("long"), s["n"].alias("n"), s["more"].alias("more"), F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), block).alias("blocks"))

    def core(s: Column) -> Column:
        start = F.coalesce(F.array_min(F.transform(F.filter(s["blocks"], lambda x: ~x["first"]), lambda x: x["at"])), s["n"])
        end = F.coalesce(F.array_max(F.transform(F.filter(s["blocks"], lambda x: ~x["last"]), lambda x: x["to"])), F.lit(0))
        end = F.greatest(start, end)
        found = F.size(F.filter(s["blocks"], lambda x: x["moved"]))
        return F.struct(found.alias("found"), cut(s["short"], start, end - start).alias("short"), cut(s["long"], start, end + s["more"] - start).alias("long"))

    return let(let(let(both, sized), blocks), core)


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The later line b, as ``at``, of each pair (a, b) of lines that are at most ``edits`` apart."""
    text = lambda x: texts.select(F.col("at").alias(x), F.col("line").alias(f"{x}_line"))
    both = Scratch(pairs.distinct()).df.join(text("a"), "a").join(text("b"), "b")
    both = both.select("b", F.explode(F.array(_compared("a_line", "b_line", edits))).alias("s")).where(F.col("s.found") >= BLOCKS - edits)
    # The characters are split off once for each pair, not once for each step.
    chars = F.struct(*[F.split(F.decode(F.col("s")[x], "UTF-32"), "").alias(x) for x in ("long", "short")])
    close = both.where(let(chars, lambda s: edit_distance(_some(s["long"]), _some(s["short"]), edits)) <= edits)
    return Scratch(close.select(F.col("b").alias("at")).distinct()).df


def _some(chars: Column) -> Column:
    """An empty text splits into one empty character."""
    return F.filter(chars, lambda c: c != "")


def followers(lines: Scratch, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """``at``, a struct (id, pos), of every line that an earlier one is at most ``edits`` away from.

    A line goes for one earlier line near it, so not every pair is needed.  In
    each round the lines of a key that have not gone meet the earliest of them
    that is indexed, which leaves little of a large group of near copies.  When
    what could still meet is about as much as the rows that share keys, or
    rounds no longer help, every line that is left meets all earlier ones of
    its keys, so no pair is left out.
    """
    shared = Scratch(crowds(lines, edits, shortest))
    line = F.col("who").bitwiseAND(F.lit(-2)).alias("h1")
    wanted = Scratch(shared.df.select(line).distinct())
    ids = F.broadcast(wanted.df) if wanted.df.count() <= FETCH else wanted.df
    # Two lines of one hash are told apart by their places.
    counts = [_letters("line", letters).alias(f"letters{i}") for i, letters in enumerate(COUNTED)]
    texts = Scratch(lines.df.join(ids, "h1", "left_semi").select("h1", F.struct("id", "pos").alias("at"), "line", F.char_length("line").alias("length"), *counts)).df
    rows = shared.df.select("key", line, (F.col("who").bitwiseAND(F.lit(1)) == 1).alias("probe"))
    rows = Scratch(rows.join(texts.drop("line"), "h1").drop("h1")).df
    n = rows.count()
    left, met, gone, last = rows, rows.limit(0).select("key", "at"), None, None
    for turn in range(STARS + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        open_ = left.groupBy("key").agg(F.count("*").alias("m")).join(sizes, "key")
        meet = open_.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        if turn == STARS or meet <= 4 * n or (turn and meet > 0.8 * last):
            break
        last = meet
        star = left.where("NOT probe").join(met, ["key", "at"], "left_anti").groupBy("key").agg(F.min("at").alias("at"))
        stars = Scratch(left.where("NOT probe").join(star, ["key", "at"])).df
        pairs = left.alias("x").join(stars.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.at") != F.col("y.at")) & _alike("x", "y", edits))
        found = _verified(pairs.select(F.least("x.at", "y.at").alias("a"), F.greatest("x.at", "y.at").alias("b")), texts, edits)
        gone = found if gone is None else Scratch(gone.unionByName(found).distinct()).df
        left = Scratch(left.join(found, "at", "left_anti").select(*rows.columns)).df
        met = met.unionByName(stars.select("key", "at"))
    earlier = (F.col("x.key") == F.col("y.key")) & (F.col("y.at") < F.col("x.at")) & ~(F.col("x.probe") & F.col("y.probe")) & _alike("x", "y", edits)
    pairs = left.alias("x").join(rows.alias("y"), earlier)
    found = _verified(pairs.select(F.col("y.at").alias("a"), F.col("x.at").alias("b")), texts, edits)
    return found if gone is None else gone.unionByName(found).distinct()


def kept_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept): the places of each document's lines that no earlier line equals or nearly equals."""
    lines = Scratch(first_lines(docs, id_col, text_col))
    gone = followers(lines, edits, shortest).select("at.id", "at.pos")
    return lines.df.select("id", "pos").join(gone, ["id", "pos"], "left_anti").repartition("id").groupBy("id").agg(F.collect_list("pos").alias("kept"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every line that an earlier line, of this or another document, equals or nearly equals.

    Earlier is by document id, then by place.  White space around a line does
    not matter; blank lines stay.  Lines of ``shortest`` characters or more are
    also removed if an earlier line of that length is at most ``edits``
    insertions, deletions or substitutions away, whether that line stays or
    not; shorter ones only if they are equal.  Returns the input's columns with
    the text cut down, _n_lines (not blank) and _n_removed.  A null text stays
    null; a document may end up empty.  Rows that share an id, or lack one, are
    documents of their own, in order of an own row number; those without an id
    come first.  An empty table gives no rows.

    Equal lines are one row per task before any shuffle.  A segment that many
    unlike lines share is a hot key of a plain equality join, which Spark
    splits, and the letters' counts are compared within the join.
    """
    names = docs.columns
    # Under plain names no column of the input can clash with those in between.
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    plain, docs = docs, numbered(docs, at_id, "id")
    kept = kept_lines(docs, edits, shortest, "id", at_text)
    # A document has one row of places: a table of them is small beside the texts, and no id is hot.
    d = docs.join(kept.hint("shuffle_hash"), "id", "left").withColumn("lines", F.split(at_text, "\n"))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    blank = F.filter(places, lambda i: F.ltrim(F.get(F.col("lines"), i), F.lit(_BLANK)) == "")
    stay = F.filter(F.coalesce("kept", F.array().cast("array<int>")), lambda i: i < F.size("lines"))
    d = d.withColumn("blank", blank).withColumn("stay", stay)
    text = F.array_join(F.transform(F.array_sort(F.concat("stay", "blank")), lambda i: F.get(F.col("lines"), i)), "\n")
    none = F.col("lines").isNull()
    n = F.when(none, 0).otherwise(F.size("lines") - F.size("blank")).cast("long")
    columns = [F.when(~none, text).alias(c) if c == at_text else F.col(c) for c in plain.columns]
    return d.select(*columns, n.alias("n"), F.when(none, 0).otherwise(n - F.size("stay")).cast("long").alias("gone")).toDF(*names, "_n_lines", "_n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"), "text")
