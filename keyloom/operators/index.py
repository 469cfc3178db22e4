"""An index: a sorted multimap from a key to target keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Change:
    """How a write got from ``before`` to its result: the rows whose keys went, and the rows that came or were replaced.

    No key is in both, or twice in ``come``.  A store writes this instead of
    the result.
    """

    before: DataFrame
    gone: DataFrame | None = None
    come: DataFrame | None = None


@dataclass(frozen=True)
class Derived:
    """How index pairs follow from a row: an array of keys, or an array of structs (ik, tk).  Null gives no pair."""

    keys: Column | None
    full: Column | None

    def pairs(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        if self.full is not None:
            found = df.select(F.explode(self.full).alias("p")).select(F.col("p")["ik"].alias("ik"), F.col("p")["tk"].alias("tk"))
        else:
            target = F.col(key[0]) if len(key) == 1 else F.struct(*key)
            found = df.select(F.explode(self.keys).alias("ik"), target.alias("tk"))
        return found.where("ik IS NOT NULL AND tk IS NOT NULL")


@dataclass(frozen=True)
class Updater:
    """An index kept up by functions of one's own, each from the index and the rows that changed to the new index.

    ``update`` gets the rows before and after; without it they are deleted and
    inserted.  Without ``clear`` the index is emptied.
    """

    insert: Callable[[Index, DataFrame], Index]
    delete: Callable[[Index, DataFrame], Index]
    update: Callable[[Index, DataFrame, DataFrame], Index] | None = None
    clear: Callable[[Index], Index] | None = None

    def written(self, index: Index, old: DataFrame, new: DataFrame, key: Sequence[str]) -> Index:
        """After rows ``old`` went and rows ``new`` came; those of one key are an update."""
        keys = list(key)
        index = self.delete(index, old.join(new.select(*keys), keys, "left_anti"))
        before, after = old.join(new.select(*keys), keys, "left_semi"), new.join(old.select(*keys), keys, "left_semi")
        index = self.update(index, before, after) if self.update else self.insert(self.delete(index, before), after)
        return self.insert(index, new.join(old.select(*keys), keys, "left_anti"))

    def cleared(self, index: Index) -> Index:
        return self.clear(index) if self.clear else Index(index.df.limit(0))


@dataclass(frozen=True)
class Index:
    """``df`` has the columns (ik, tk), each pair once."""

    df: DataFrame
    change: Change | None = None

    @staticmethod
    def of(df: DataFrame, ik: str = "ik", tk: str = "tk") -> Index:
        return Index(df.select(F.col(ik).alias("ik"), F.col(tk).alias("tk")).where("ik IS NOT NULL AND tk IS NOT NULL").distinct())

    @staticmethod
    def empty_like(pairs: DataFrame) -> Index:
        return Index(pairs.limit(0))

    def key(self, value: Any) -> Column:
        return F.lit(value).cast(self.df.schema["ik"].dataType)

    def target(self, value: Any) -> Column:
        return F.lit(value).cast(self.df.schema["tk"].dataType)

    # Writes.
    def index(self, pairs: DataFrame) -> Index:
        """Add pairs; those that are there already change nothing."""
        pairs = pairs.select("ik", "tk").distinct()
        return Index(self.df.unionByName(pairs).distinct(), Change(self.df, come=pairs))

    def unindex(self, pairs: DataFrame) -> tuple[Index, DataFrame]:
        """Without ``pairs``, and those of them that were there."""
        there = self.df.join(pairs.select("ik", "tk").distinct(), ["ik", "tk"], "left_semi")
        return Index(self.df.join(pairs.select("ik", "tk"), ["ik", "tk"], "left_anti"), Change(self.df, gone=there)), there

    def apply(self, gone: DataFrame, come: DataFrame) -> Index:
        """One step of upkeep: pairs are a set, so a pair that goes is gone whoever else implied it; none goes and comes."""
        return Index(self.df.join(gone, ["ik", "tk"], "left_anti").unionByName(come).distinct(), Change(self.df, gone, come))

    def clear(self) -> Index:
        return Index(self.df.limit(0))

    # Reads.
    def contains(self, key: Any, target: Any) -> DataFrame:
        return self._any((F.col("ik") == self.key(key)) & (F.col("tk") == self.target(target)))

    def has_key(self, key: Any) -> DataFrame:
        return self._any(F.col("ik") == self.key(key))

    def _any(self, test: Column) -> DataFrame:
        return self.df.where(test).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("found"))

    def _in_order(self, backward: bool = False) -> list[Column]:
        return [F.col(c).desc() if backward else F.col(c).asc() for c in ("ik", "tk")]

    def head(self) -> DataFrame:
        return self.df.orderBy(*self._in_order()).limit(1)

    def last(self) -> DataFrame:
        return self.df.orderBy(*self._in_order(True)).limit(1)

    def next(self, key: Any) -> DataFrame:
        """The pair behind the key's first pair, which may be the key's second; for an absent key the first pair behind it."""
        first = self.df.where(F.col("ik") == self.key(key)).agg(F.min("tk").alias("_first"))
        ahead = self.df.where(F.col("ik") >= self.key(key))
        # The summary has one row, whatever the key's pairs.
        later = ahead.join(F.broadcast(first), (F.col("ik") > self.key(key)) | (F.col("tk") > F.col("_first")), "left_semi")
        return later.orderBy(*self._in_order()).limit(1)

    def previous(self, key: Any) -> DataFrame:
        """The pair before the key's first pair: the last target of the key before."""
        return self.df.where(F.col("ik") < self.key(key)).orderBy(*self._in_order(True)).limit(1)

    def fetch(self, key: Any) -> DataFrame:
        """The key's smallest target; no row without one."""
        return self.df.where(F.col("ik") == self.key(key)).agg(F.min("tk").alias("tk")).where("tk IS NOT NULL")

    def fetch_at(self, position: int) -> DataFrame:
        """The pair at a place in (ik, tk) order, from 0; a negative place counts as 0."""
        return self.df.orderBy(*self._in_order()).offset(max(0, position)).limit(1)

    def indexed(self, key: Any, limit_to_key: bool = True, ordered: bool = True) -> DataFrame:
        """The key's pairs, or with ``limit_to_key`` off all from the key on; none if the key is absent, either way."""
        if limit_to_key:
            found = self.df.where(F.col("ik") == self.key(key))
        else:
            here = self.df.where(F.col("ik") == self.key(key)).select(F.lit(True).alias("_here")).limit(1)
            found = self.df.where(F.col("ik") >= self.key(key)).join(F.broadcast(here), F.lit(True), "left_semi")
        return found.orderBy(*self._in_order()) if ordered else found

    def query(self, key: Any):  # noqa: ANN201
        from keyloom.plans.query import IndexQuery

        return IndexQuery(self, key)
