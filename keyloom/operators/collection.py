"""A collection: rows with a unique, totally ordered key, over any DataFrame."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.index import Change, Derived, Index, Updater

Values = dict[str, Column]


def checkpoints(spark: SparkSession) -> None:
    """See to it that checkpoints have a folder: the session's own, or a temporary one where all run on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        context.setCheckpointDir(where)


@dataclass(frozen=True)
class Collection:
    """``df`` holds the key columns ``key`` (one, or several for a composite key) and the value columns.

    Keys are not null and unique.  Everything is lazy; writes return a new
    collection.  Rows come out in key order only where an operator says so,
    as a total order over a cluster is a shuffle of its own.
    """

    df: DataFrame
    key: tuple[str, ...]
    name: str = "collection"
    indexes: dict[str, tuple[Derived | Updater, Index]] = field(default_factory=dict)
    change: Change | None = None

    @staticmethod
    def of(df: DataFrame, key: str | Sequence[str], name: str = "collection") -> Collection:
        return Collection(df, (key,) if isinstance(key, str) else tuple(key), name)

    # Keys.
    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key]

    def key_column(self) -> Column:
        return F.col(self.key[0]) if len(self.key) == 1 else F.struct(*self.key)

    def literal(self, key: Any) -> Column:
        """A key as a literal; a tuple for a composite key."""
        if len(self.key) == 1:
            return F.lit(key).cast(self.df.schema[self.key[0]].dataType)
        return F.struct(*[F.lit(v).cast(self.df.schema[c].dataType).alias(c) for c, v in zip(self.key, key)])

    def at_key(self, key: Any) -> Column:
        """The condition that a row has ``key``, one plain comparison per column so that scans can prune by it."""
        if len(self.key) == 1:
            return self.key_column() == self.literal(key)
        same = F.lit(True)
        for c, v in zip(self.key, key):
            same = same & (F.col(c) == F.lit(v))
        return same

    def beyond(self, key: Any, backward: bool = False) -> Column:
        """The condition that a row lies strictly behind ``key``, or before it if ``backward``; the key need not exist."""
        here = self.key_column() < self.literal(key) if backward else self.key_column() > self.literal(key)
        if len(self.key) > 1:  # a looser test on the first column alone reaches the scan
            first = F.col(self.key[0]) <= F.lit(key[0]) if backward else F.col(self.key[0]) >= F.lit(key[0])
            here = here & first
        return here

    def order(self, backward: bool = False) -> list[Column]:
        return [F.col(c).desc() if backward else F.col(c).asc() for c in self.key]

    # Scans.
    def scan(self, keys: Column | None = None, values: Column | None = None, start_after: Any = None, backward: bool = False, limit: int | None = None, ordered: bool = True) -> DataFrame:
        """Rows that pass both filters, in key order, from behind ``start_after``; the limit counts what passes."""
        df = self.df
        if start_after is not None:
            df = df.where(self.beyond(start_after, backward))
        for test in (keys, values):
            if test is not None:
                df = df.where(test)
        if limit is not None and limit <= 0:
            return df.limit(0)
        if ordered or limit is not None:
            df = df.orderBy(*self.order(backward))
        return df if limit is None else df.limit(limit)

    def collect(self, **options: Any) -> list:
        return self.scan(**options).select(*self.values).collect()

    def stream(self, **options: Any):  # noqa: ANN201
        """Values in key order, pulled a partition at a time."""
        return self.scan(**options).select(*self.values).toLocalIterator()

    def stream_with_keys(self, **options: Any):  # noqa: ANN201
        return self.scan(**options).toLocalIterator()

    def size(self) -> int:
        return self.df.count()

    # Points and steps.
    def fetch(self, key: Any) -> DataFrame:
        return self.df.where(self.at_key(key)).limit(1)

    def contains(self, key: Any) -> DataFrame:
        """One row: found."""
        return self.df.where(self.at_key(key)).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("found"))

    def fetch_at(self, position: int) -> DataFrame:
        """The row at a place in key order, from 0; none if there is no such place."""
        if position < 0:
            return self.df.limit(0)
        return self.df.orderBy(*self.order()).offset(position).limit(1)

    def head(self) -> DataFrame:
        return self.df.orderBy(*self.order()).limit(1)

    def last(self) -> DataFrame:
        return self.df.orderBy(*self.order(True)).limit(1)

    def next(self, key: Any) -> DataFrame:
        """The row strictly behind ``key``, whether the key exists or not."""
        return self.df.where(self.beyond(key)).orderBy(*self.order()).limit(1)

    def previous(self, key: Any) -> DataFrame:
        return self.df.where(self.beyond(key, True)).orderBy(*self.order(True)).limit(1)

    def neighbours(self, keys: DataFrame, key_col: str) -> DataFrame:
        """For many keys at once: each with the nearest smaller and larger key of the collection, null where there is none.

        Keys and collection are cut into the same ranges, so each task looks at
        one range and the borders carry over by two small summaries; no window
        runs over the whole collection.  The cut is checkpointed, since it is
        read twice and a cut drawn anew need not be the same.
        """
        from pyspark.sql import Window

        spark = self.df.sparkSession
        k, ranges = self.key[0], int(spark.conf.get("spark.sql.shuffle.partitions"))
        both = self.df.select(F.col(k).alias("_k"), F.lit(0).alias("_ask")).unionByName(keys.select(F.col(key_col).alias("_k"), F.lit(1).alias("_ask")).where("_k IS NOT NULL").distinct())
        checkpoints(spark)
        ranged = both.repartitionByRange(ranges, "_k").withColumn("_part", F.spark_partition_id()).checkpoint()
        own = F.when(F.col("_ask") == 0, F.col("_k"))
        edges = ranged.groupBy("_part").agg(F.min(own).alias("_lo"), F.max(own).alias("_hi"))
        # One row for each range.
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select("_part", F.max("_hi").over(before).alias("_down"), F.min("_lo").over(after).alias("_up"))
        # A key that is asked for comes before its equal either way; frames that begin at the first row grow row by row.
        up, down = (Window.partitionBy("_part").orderBy(order, F.col("_ask").desc()).rowsBetween(Window.unboundedPreceding, -1) for order in (F.col("_k").asc(), F.col("_k").desc()))
        near = ranged.withColumn("_d", F.last(own, True).over(up)).withColumn("_u", F.last(own, True).over(down))
        out = near.where("_ask = 1").join(F.broadcast(edges), "_part")
        return out.select(F.col("_k").alias(key_col), F.coalesce("_d", "_down").alias("previous"), F.coalesce("_u", "_up").alias("next"))

    # Indexes.
    def with_index(self, name: str, keys: Column) -> Collection:
        """Attach an index from each value of the array ``keys`` to the row's key."""
        return self._attach(name, Derived(keys, None))

    def with_index_full(self, name: str, pairs: Column) -> Collection:
        """Attach an index of the pairs in ``pairs``, an array of structs (ik, tk)."""
        return self._attach(name, Derived(None, pairs))

    def with_updater(self, name: str, index: Index, updater: Updater) -> Collection:
        """Attach ``index``, which ``updater`` keeps up at every write."""
        return replace(self, indexes=self.indexes | {name: (updater, index)})

    def _attach(self, name: str, how: Derived) -> Collection:
        return replace(self, indexes=self.indexes | {name: (how, Index.empty_like(how.pairs(self.df, self.key)))})

    def derive(self, keys: Column) -> Index:
        """An index computed from what the collection holds: each value of the array ``keys`` leads to the row's key."""
        return Index(Derived(keys, None).pairs(self.df, self.key).distinct())

    def derive_full(self, pairs: Column) -> Index:
        return Index(Derived(None, pairs).pairs(self.df, self.key).distinct())

    def rebuild_indexes(self) -> Collection:
        rebuilt = lambda how, i: how.insert(how.cleared(i), self.df) if isinstance(how, Updater) else Index(how.pairs(self.df, self.key).distinct())
        return replace(self, indexes={n: (how, rebuilt(how, i)) for n, (how, i) in self.indexes.items()})

    def index(self, name: str) -> Index:
        return self.indexes[name][1]

    def _written(self, df: DataFrame, old: DataFrame, new: DataFrame, change: Change) -> Collection:
        """With ``df`` for rows, and every index changed by the difference between the rows that went and those that came."""
        moved = {}
        for name, (how, index) in self.indexes.items():
            if isinstance(how, Updater):
                moved[name] = (how, how.written(index, old, new, self.key))
                continue
            gone, come = how.pairs(old, self.key).distinct(), how.pairs(new, self.key).distinct()
            moved[name] = (how, index.apply(gone.join(come, ["ik", "tk"], "left_anti"), come.join(gone, ["ik", "tk"], "left_anti")))
        return replace(self, df=df, indexes=moved, change=change)

    # Writes: batches of any size, each one step.
    def fold(self, batch: DataFrame, sequence: str | None) -> DataFrame:
        """The last row for each key, by ``sequence`` if the batch has one; without it a key that repeats is an error, as none is the last."""
        if sequence is None:
            rest = F.struct(*[c for c in batch.columns if c not in self.key])
            one = batch.groupBy(*self.key).agg(F.first(rest).alias("_v"), F.count("*").alias("_n"))
            once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a key repeats in the batch: name the column of its sequence"))).otherwise(F.col("_v"))
            return one.select(*self.key, once.alias("_v")).select(*self.key, "_v.*") if len(batch.columns) > len(self.key) else batch.distinct()
        rest = [c for c in batch.columns if c not in self.key]
        last = F.max_by(F.struct(*[c for c in rest if c != sequence]), F.col(sequence))
        return batch.groupBy(*self.key).agg(last.alias("_v")).select(*self.key, "_v.*")

    def upsert_overwrite(self, batch: DataFrame, sequence: str | None = None) -> Collection:
        """Insert or replace rows; old values are not looked at unless indexes are attached."""
        new = self.fold(batch, sequence).select(*self.df.columns)
        df = self.df.join(new, list(self.key), "left_anti").unionByName(new)
        old = self.df.join(new, list(self.key), "left_semi") if self.indexes else self.df.limit(0)
        return self._written(df, old, new, Change(self.df, come=new))

    def upsert(self, keys: DataFrame, modify: Callable[[Callable[[str], Column], Column], Values]) -> tuple[Collection, DataFrame]:
        """Rows of ``keys`` changed or made by ``modify(old, exists)``, and the new rows.

        ``keys`` has the key columns and whatever else the modifier reads;
        ``old(c)`` is the old value of a column, null without one.
        """
        if len(keys.columns) == len(self.key):
            keys = keys.distinct()
        held = self.df.select(*self.key, F.struct(*self.values).alias("_old"), F.lit(True).alias("_here"))
        both = keys.join(held, list(self.key), "left")
        here = F.coalesce("_here", F.lit(False))
        changed = modify(lambda c: F.col("_old")[c], here)
        new = both.select(*self.key, *[changed.get(c, F.col("_old")[c]).cast(self.df.schema[c].dataType).alias(c) for c in self.values])
        return self.upsert_overwrite(new), new

    def update(self, keys: DataFrame, modify: Callable[[Callable[[str], Column]], Values]) -> tuple[Collection, DataFrame]:
        """As ``upsert``, but only rows that exist."""
        present = keys.join(self.df.select(*self.key), list(self.key), "left_semi")
        return self.upsert(present, lambda old, _: modify(old))

    def delete(self, keys: DataFrame) -> tuple[Collection, DataFrame]:
        """Rows without those of ``keys``, and the rows that went; missing keys are no error."""
        keys = keys.select(*self.key).distinct()
        gone = self.df.join(keys, list(self.key), "left_semi")
        return self._written(self.df.join(keys, list(self.key), "left_anti"), gone, self.df.limit(0), Change(self.df, gone=gone)), gone

    def clear(self) -> Collection:
        """No rows; attached indexes are emptied, whatever else filled them."""
        return replace(self, df=self.df.limit(0), change=None, indexes={n: (how, how.cleared(i) if isinstance(how, Updater) else Index(i.df.limit(0))) for n, (how, i) in self.indexes.items()})

    # Queries.
    def query(self):  # noqa: ANN201
        from keyloom.plans.query import Query

        return Query(self)
