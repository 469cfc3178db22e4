"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python unless they find it already."""
    root = Path(__file__).resolve().parents[2]
    places = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if spark.sparkContext.master.startswith("local["):
        places.add(Path.cwd())
    context = spark.sparkContext.applicationId
    if root in places or getattr(ship, "done", None) == context:
        return
    d = tempfile.mkdtemp(prefix="keyloom-")
    atexit.register(shutil.rmtree, d, True)  # Spark serves the file from there
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/keyloom", "zip", root, "keyloom"))
    ship.done = context


def give_back() -> None:
    """Return what a Python worker no longer needs to the system, as idle workers stay for a while."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where that is set.  A local session without
    it (tests) gets a temporary folder; a cluster without it is an error, since
    executors there do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(shared_dir, "local", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A DataFrame written to the shared folder; reading it cuts the lineage."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/keyloom-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)
        _made.append((self.spark, self.path))

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _made[:] = [x for x in _made if x[1] != self.path]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def numbered(docs: DataFrame, id_col: str, to: str, nulls_last: bool = False) -> DataFrame:
    """Add ``to``: a number of each row's own, in order of its id, then of an own row number.

    Ids that are neither null nor repeated are such numbers.  Otherwise rows
    are sorted, numbered and written to the shared folder, so that every later
    reading finds the same numbers; rows without an id come first or last.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    if not docs.groupBy(ident.alias("i")).agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").limit(1).count():
        return docs.withColumn(to, ident)
    order = ident.asc_nulls_last() if nulls_last else ident.asc_nulls_first()
    # The row's number is part of the order, so that ranges also split a hot id.
    rows = docs.withColumn(to, F.monotonically_increasing_id()).orderBy(order, to)
    return Scratch(rows.withColumn(to, F.monotonically_increasing_id())).df


def buckets_for(rows: int) -> int:
    """Buckets that keep a group of all rows at some ten thousand rows each."""
    return int(min(1 << 20, max(256, rows // 20_000)))


def salted_rank(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], to: str, counted: DataFrame | None = None) -> DataFrame:
    """Add ``to``: the rank from 1 within ``keys``, in order of ``bucket``, then ``order``.

    No window holds more than a bucket's rows or a group's bucket counts, so a
    group with a third of all rows is split.  Keys must not be null.
    ``counted`` may have the same rows in a form that is cheaper to read.
    """
    cells = (df if counted is None else counted).groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = df.withColumn("_within", F.row_number().over(within))
    return ranked.join(cells, [*keys, bucket]).withColumn(to, F.col("_within") + F.col("_before")).drop("_within", "_before")


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps, which need a number of rounds
    that grows with the logarithm of the largest component.  Each round's links
    go to the shared folder; none come to the driver.  Both steps use group
    minima only, which Spark sums up before it shuffles, and joins on nodes,
    whose minima are tables of their own, so that Spark splits a hot node.
    """
    e = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Scratch(e)
    for _ in range(rounds):
        e = now.df
        # Large star: every larger neighbour of a node links to the node's smallest neighbour or itself.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Scratch(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = Scratch(both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least.drop()
        # Small star: every smaller neighbour of a node, and the node, link to the smallest of them.
        least = Scratch(large.df.groupBy("u").agg(F.min("v").alias("m")))
        new = Scratch(large.df.join(least.df, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        for done in (now, large, least):
            done.drop()
        now = new
        # Done when every link goes from a node straight to its root: no root is the larger end of a link, no node has two roots.
        e = now.df
        if not e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
