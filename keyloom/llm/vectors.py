"""Embedding near-duplicates by cover trees (8) and exact top-k search by branch and bound (9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, components, table

#: Vectors of the cover tree's top level, which the driver sees; vectors of a lower node that is compared at once.
TOP, NODE = 2048, 2048
#: The side of vectors whose node meets itself; nodes that meet another one are sides 0 and 1.
SELF = 2


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def finite(vector: str) -> Column:
    """True for arrays that are not null and hold neither null nor non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


class Cover:
    """A node of a cover tree: a centre, what it covers, its covering radius and its children, whose radii are half as large.

    A node whose members do not fall into few balls of half its radius is a
    leaf, as nothing can be pruned below it.
    """

    __slots__ = ("centre", "kids", "radius", "rows")

    def __init__(self, units: np.ndarray, rows: np.ndarray, centre: int, dist: np.ndarray, leaf: int = 48) -> None:
        self.rows, self.centre, self.radius, self.kids = rows, centre, float(dist.max(initial=0.0)), []
        if len(rows) <= leaf or self.radius < 1e-9:
            return
        half, left, own, most, kids = self.radius / 2, rows, dist, max(4, len(rows) // 8), []
        while len(left):
            inside = own <= half
            kids.append((left[inside], centre, own[inside]))
            left = left[~inside]
            if len(kids) > most:
                return
            if len(left):
                centre = int(left[0])
                own = distances(units[left], units[centre])
        self.kids = [Cover(units, *x, leaf) for x in kids] if len(kids) > 1 else []


def distances(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ centre)))


def tree(units: np.ndarray) -> Cover:
    return Cover(units, np.arange(len(units)), 0, distances(units, units[0]))


def threshold_pairs(raw: np.ndarray, units: np.ndarray, a: Cover, b: Cover, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Dual traversal: blocks (rows of a, rows of b, links between them; None: all link), with every pair of cosine ``least`` or more in one of them."""
    reach, slack = (2.0 - 2.0 * least) ** 0.5, 1e-6
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        apart = float(distances(units[[a.centre]], units[b.centre])[0])
        if apart - a.radius - b.radius > reach + slack:
            continue
        if apart + a.radius + b.radius < reach - slack:
            yield a.rows, b.rows, None
        elif a.kids and (a.radius >= b.radius or not b.kids):
            todo += [(x, b) for x in a.kids]
        elif b.kids:
            todo += [(a, x) for x in b.kids]
        else:
            cos = units[a.rows] @ units[b.rows].T
            links = cos >= least
            for i, j in np.argwhere(np.abs(cos - least) < 1e-10):  # too near to tell by rounded unit vectors
                x, y = raw[a.rows[i]], raw[b.rows[j]]
                links[i, j] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least
            if links.any():
                yield a.rows, b.rows, links


def _linked(ids: np.ndarray, copies: np.ndarray, raw: np.ndarray, sides: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, smallest id it links up with here) of the vectors that link, within one side or between two."""
    kinds = np.unique(sides)
    same = kinds[0] == SELF
    if len(kinds) < 2 and not same:  # the other node's part is empty
        return ids[:0], ids[:0], ids[:0]
    units = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
    trees = []
    for side in kinds:
        rows = np.flatnonzero(sides == side)
        trees.append(Cover(units, rows, int(rows[0]), distances(units[rows], units[rows[0]])))
    n, root, heard = np.zeros(len(ids), np.int64), ids.copy(), np.zeros(len(ids), bool)
    found = []
    for x, y, links in threshold_pairs(raw, units, trees[0], trees[-1], least):
        if links is None:
            n[x] += copies[y].sum()
            if not same:
                n[y] += copies[x].sum()
            found.append((x, np.full(len(x), y[0])))
            found.append((np.full(len(y), x[0]), y))
        else:
            n[x] += links @ copies[y]
            if not same:
                n[y] += copies[x] @ links
            i, j = np.nonzero(links)
            found.append((x[i], y[j]))
    if found:
        u, v = (np.concatenate(z) for z in zip(*found))
        keep = u != v
        u, v = u[keep], v[keep]
        heard[u] = heard[v] = True
        while len(u):
            new = root.copy()
            np.minimum.at(new, u, root[v])
            np.minimum.at(new, v, root[u])
            if (new == root).all():
                break
            root = new
    if same:  # each vector met itself once: it counts its other copies
        n = n - copies
    return ids[heard], n[heard], root[heard]


def near_vectors(vectors: DataFrame, least: float = 0.93, top: int = TOP, node: int = NODE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of one label with cosine ``least`` or more; exact, by dual traversal of cover trees.

    Returns one row per input row: its id, n_links (other vectors that it links
    with directly), component_id (the smallest id reachable) and kept (it is
    that id).  Vectors that are null, zero, hold null or non-finite components
    or have no label or id link with nothing, nor do vectors of unlike
    lengths.  Equal vectors are compared once and counted with their copies;
    rows that repeat an id count as vectors of their own in n_links.

    The top level is a bounded sample of ``top`` vectors.  Every vector goes to
    the nearest of its label; the driver learns radius and size of each such
    ball and drops pairs of balls whose covering radii keep them too far
    apart.  Balls are cut into nodes of at most about ``node`` vectors, and
    each remaining pair of nodes is one group of bounded size, in which two
    cover trees with halving radii are traversed together.  What a group
    returns is a row for each vector, never its pairs.  Labels that the sample
    missed are cut into nodes likewise, all of which meet; how many each has
    comes from a table, as there may be any number of such labels.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    good = finite("x") & F.col("label").isNotNull() & F.col("id").isNotNull() & F.exists("x", lambda c: c != 0)
    v = v.where(good)
    group = ["label", "x"]
    distinct = Scratch(v.groupBy(*group).agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    d = distinct.df.withColumn("key", F.concat_ws("/", F.col("label").cast("string"), F.size("x").cast("string")))
    total = d.count()
    node = max(64, min(node, total // 64))
    pivots = d.orderBy(F.xxhash64("id", "key")).limit(top).select("key", "x").collect() if total else []
    by_key: dict[str, list[int]] = {}
    units = []
    for p in pivots:
        x = np.array(p.x, float)
        by_key.setdefault(p.key, []).append(len(units))
        units.append(x / np.sqrt(x @ x))
    tops = {k: (np.array(at), np.array([units[i] for i in at])) for k, at in by_key.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = np.array(batch.column(2).to_pylist(), object), batch.column(3)
            ball, far = np.full(len(keys), -1, np.int64), np.full(len(keys), 2.0)
            for k in set(keys) & set(tops):
                at = np.flatnonzero(keys == k)
                x = matrix(rows.take(pa.array(at)))
                cos = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ tops[k][1].T
                best = cos.argmax(axis=1)
                ball[at] = tops[k][0][best]
                far[at] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[np.arange(len(at)), best]))
            yield pa.record_batch([*batch.columns, pa.array(ball), pa.array(far)], names=["id", "copies", "key", "x", "ball", "far"])

    balls = Scratch(d.select("id", "copies", "key", "x").mapInArrow(nearest, "id long, copies long, key string, x array<double>, ball long, far double"))
    # Balls of the sample; labels that the sample missed are known by key alone, and one vector has nothing to meet.
    known = {r.ball: (r.far, r.n) for r in balls.df.where("ball >= 0").groupBy("ball").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    reach, partners = (2.0 - 2.0 * least) ** 0.5 + 1e-6, []
    missed = Scratch(balls.df.where("ball < 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / node).cast("int").alias("cuts")))
    dealt = balls.df.where("ball >= 0").withColumn("cuts", F.lit(0))
    if missed.df.limit(1).count():
        dealt = dealt.unionByName(balls.df.where("ball < 0").join(missed.df, "key").select(*dealt.columns))
    parts = {b: -(-n // node) for b, (_, n) in known.items()}
    # Small neighbouring balls would give many tiny pairs: they share a node, which only ever adds pairs to look at.
    nodes: dict[int, tuple[str, int]] = {}
    spans: list[dict] = []
    for k, (at, _) in tops.items():
        open_: dict | None = None
        for b in sorted((b for b in at.tolist() if b in known), key=lambda b: -known[b][1]):
            if parts[b] > 1 or known[b][1] > node // 2:
                spans.append({"key": k, "balls": [b], "n": known[b][1]})
            else:
                if open_ is None or open_["n"] + known[b][1] > node:
                    open_ = {"key": k, "balls": [], "n": 0}
                    spans.append(open_)
                open_["balls"].append(b)
                open_["n"] += known[b][1]
    for s, span in enumerate(spans):
        for b in span["balls"]:
            nodes[b] = (span["key"], s)
    for s, one in enumerate(spans):
        for t in range(s, len(spans)):
            if spans[t]["key"] == one["key"]:
                ra = np.array([known[b][0] for b in one["balls"]])
                rb = np.array([known[b][0] for b in spans[t]["balls"]])
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.array([units[b] for b in one["balls"]]) @ np.array([units[b] for b in spans[t]["balls"]]).T))
                if (apart - ra[:, None] - rb[None, :] <= reach).any():
                    partners.append((s, t))
    cuts = [-(-span["n"] // node) for span in spans]
    pairs: dict[int, list[int]] = {s: [] for s in range(len(spans))}
    for s, t in partners:
        pairs[s].append(t)
        if t != s:
            pairs[t].append(s)
    span_of = np.full(len(units) + 1, -1, np.int64)
    for b, (_, s) in nodes.items():
        span_of[b] = s

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for every node that its own node meets: the meeting's name, and which side it is on."""
        for batch in batches:
            ids, ball, own = batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.column(6).to_pylist()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at, meets, sides = [], [], []
            for i, (s, h) in enumerate(zip(span_of[ball].tolist(), mixed.tolist())):
                if s < 0:  # of a label that the sample missed all nodes meet
                    for part in range(own[i]):
                        one, two = sorted((h % own[i], part))
                        at.append(i)
                        meets.append(f"={batch.column(2)[i].as_py()}.{one}-{two}")
                        sides.append(SELF if one == two else int(h % own[i] == two))
                    continue
                mine = (s, h % cuts[s])
                for t in pairs[s]:
                    for part in range(cuts[t]):
                        one, two = sorted((mine, (t, part)))
                        at.append(i)
                        meets.append(f"{one[0]}.{one[1]}-{two[0]}.{two[1]}")
                        sides.append(SELF if one == two else int(mine == two))
            cols = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([pa.array(meets, pa.string()), pa.array(sides, pa.int32()), cols.column(0), cols.column(1), cols.column(3)], names=["meet", "side", "id", "copies", "x"])

    def link(table: pa.Table) -> pa.Table:
        found = _linked(table["id"].to_numpy(), table["copies"].to_numpy(), matrix(table["x"]), table["side"].to_numpy(), least)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["id", "n", "root"])

    met = dealt.mapInArrow(deal, "meet string, side int, id long, copies long, x array<double>")
    linked = Scratch(met.groupBy("meet").applyInArrow(link, "id long, n long, root long"))
    counts = linked.df.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(vectors.sparkSession, linked.df.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = distinct.df.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    per = per.select(*group, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    # A table of its own, so that Spark splits a vector that many rows have.
    per = Scratch(per).df
    full = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    full = full.withColumn("label", F.when(finite("x") & F.col("vec_id").isNotNull(), F.col("label")))
    out = full.join(per, group, "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir))


def best_by_blocks(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, inner products) of the ``k`` best of ``rows`` for each query, ties to smaller ids.

    ``rows`` lie dimension by dimension.  Products add up over blocks of
    dimensions; what the rest can still add or take is at most the product of
    the norms of the rests.  A row whose upper bound falls below the k-th
    largest lower bound is out, and the others are moved together.
    """
    columns = np.ascontiguousarray(rows.T)
    dims, n = columns.shape
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dims, 1) < 2.0**53
    if not exact:  # beyond what doubles add up exactly
        ints = [[int(x) for x in r] for r in rows]
    starts = list(range(0, dims, block))
    rest_rows = np.array([np.sqrt((columns[s:] ** 2).sum(axis=0)) for s in [*starts[1:], dims]]).reshape(-1, n)
    rest_queries = np.array([np.sqrt((queries[:, s:] ** 2).sum(axis=1)) for s in [*starts[1:], dims]]).reshape(-1, len(queries))
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != own[q])
        if not exact:
            # What does not fit a long counts as the largest or smallest one.
            score = np.array([max(-(2**63), min(2**63 - 1, sum(int(x) * y for x, y in zip(queries[q], ints[i])))) for i in alive], object)
        else:
            score = np.zeros(len(alive))
            for b, s in enumerate(starts):
                score = score + queries[q, s : s + block] @ columns[s : s + block, alive]
                if len(alive) > k and b + 1 < len(starts):
                    rest = rest_rows[b, alive] * (rest_queries[b, q] * (1 + 1e-12)) + 1e-6
                    keep = score + rest >= np.partition(score - rest, len(alive) - k)[len(alive) - k]
                    if keep.sum() < 0.9 * len(alive):
                        alive, score = alive[keep], score[keep]
        order = sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]])) if not exact else np.lexsort((ids[alive], -score))
        order = order[:k]
        yield q, ids[alive[order]], np.array([int(score[i]) for i in order], np.int64)


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = 10, scale: float = 1024.0, bucket_rows: int = 8192, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest integer inner product for every query, exactly.

    Components become floor(scale * x).  ``queries`` is a condition on
    ``vectors`` (ids divisible by 100 by default); all rows but those with the
    query's own id are candidates.  Returns query_id, rank from 1, vec_id and
    score; ties go to the smaller id, and a query has fewer rows if there are
    fewer candidates.  Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; a shorter vector counts
    as if it had zeros behind.  Rows that repeat an id are candidates each, and
    queries each unless their vectors are equal too.  Scores beyond a long's
    range count as its largest or smallest value.

    Candidates lie in buckets and queries in blocks of bounded size; each
    bucket meets each block in one group, which keeps ``k`` rows per query.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(finite("x") & F.col("id").isNotNull())
    asked = v.where((F.col("id") % 100 == 0) if queries is None else queries).distinct().withColumn("q", F.xxhash64("id", "x"))
    rows, n_queries = v.count(), asked.count()
    buckets = max(-(-rows // bucket_rows), min(64, -(-rows // 16)), 1)
    blocks = max(1, -(-n_queries // block_rows))
    bucket, block = F.pmod(F.xxhash64("id"), F.lit(buckets)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    left = v.withColumn("bucket", bucket).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = asked.withColumn("block", block).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))

    def dense(column: pa.ChunkedArray, dims: int) -> np.ndarray:
        lengths = np.asarray(column.combine_chunks().value_lengths())
        out = np.zeros((len(column), dims))
        out[np.arange(dims)[None, :] < lengths[:, None]] = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.floor(out * scale)

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if len(rows) and len(asked):
            dims = max(int(np.asarray(t["x"].combine_chunks().value_lengths()).max()) for t in (rows, asked))
            own, which, ids = asked["id"].to_numpy(), asked["q"].to_numpy(), rows["id"].to_numpy()
            for q, near, scores in best_by_blocks(dense(asked["x"], dims), own, dense(rows["x"], dims), ids, k):
                found[0].append(np.full(len(near), own[q]))
                found[1].append(near)
                found[2].append(scores)
                found[3].append(np.full(len(near), which[q]))
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found], names=["query_id", "vec_id", "score", "q"])

    pairs = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block"))
    best = pairs.applyInArrow(search, "query_id long, vec_id long, score long, q long")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x::DOUBLE[], v.x::DOUBLE[])::BIGINT AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
"""
