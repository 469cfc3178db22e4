"""The fluent query layer: immutable builders, each of which becomes one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.collection import Collection
from keyloom.operators.index import Index

Test = Callable[[Any], Column] | Column


def python_test(test: Callable[[Any], bool], *columns: str) -> Column:
    """A plain Python predicate as a condition.

    Scans cannot prune by it and rows leave the JVM; conditions on columns are
    the way to go wherever they can say the same.
    """
    return F.udf(lambda *x: bool(test(*x)), "boolean")(*columns)


def _condition(test: Test, of: Any) -> Column:
    return test if isinstance(test, Column) else test(of)


def _all(tests: tuple[Column, ...]) -> Column | None:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


@dataclass(frozen=True)
class Query:
    """Rows of a collection: key and value filters, a start, a direction and a limit."""

    collection: Collection
    key_tests: tuple[Column, ...] = ()
    value_tests: tuple[Column, ...] = ()
    start: Any = None
    backward: bool = False
    most: int | None = None

    def where_key(self, test: Test) -> Query:
        """Only keys that pass; tests add up.  The test gets the key's column."""
        return replace(self, key_tests=(*self.key_tests, _condition(test, self.collection.key_column())))

    def where_value(self, test: Test) -> Query:
        """Only values that pass; tests add up.  The test gets a function from names to columns."""
        return replace(self, value_tests=(*self.value_tests, _condition(test, F.col)))

    def start_after(self, key: Any) -> Query:
        """Only keys behind ``key``, or before it in reverse; the last call counts."""
        return replace(self, start=key)

    def reverse(self) -> Query:
        return replace(self, backward=True)

    def limit(self, n: int) -> Query:
        """At most ``n`` rows of those that pass, in key order, before any join; the last call counts."""
        return replace(self, most=n)

    def to_df(self, ordered: bool = True) -> DataFrame:
        """Keys and values; ``ordered`` off leaves out the sort where no limit needs it."""
        return self.collection.scan(_all(self.key_tests), _all(self.value_tests), self.start, self.backward, self.most, ordered)

    def values_df(self, ordered: bool = True) -> DataFrame:
        return self.to_df(ordered).select(*self.collection.values)

    def to_list(self) -> list:
        return self.values_df().collect()

    def to_stream(self):  # noqa: ANN201
        return self.values_df().toLocalIterator()

    def to_stream_with_keys(self):  # noqa: ANN201
        return self.to_df().toLocalIterator()

    def _left(self) -> DataFrame:
        c = self.collection
        keys = [F.col(k).alias(f"_o{i}") for i, k in enumerate(c.key)]
        return self.to_df(ordered=False).select(F.struct(*c.df.columns).alias("left"), *keys)

    def join_by_key(self, right: Collection, key: Callable[[Column], Column]) -> JoinedQuery:
        """Inner join on the right collection's key; ``key`` gets the left row."""
        return _by_key(self._left(), right, key(F.col("left")), tuple([not self.backward] * len(self.collection.key)))

    def join_by_index(self, right: Collection, index: Index, key: Callable[[Column], Column]) -> JoinedQuery:
        """Inner join through an index: one row for each target that the right collection holds."""
        return _by_index(self._left(), right, index, key(F.col("left")), tuple([not self.backward] * len(self.collection.key)))


def _right(right: Collection) -> DataFrame:
    return right.df.select(right.key_column().alias("_rk"), F.struct(*right.df.columns).alias("right"))


def _by_key(left: DataFrame, right: Collection, key: Column, order: tuple[bool, ...]) -> JoinedQuery:
    r = _right(right)
    names = [c for c in left.columns if c != "left"]
    out = left.withColumn("_lk", key).join(r, F.col("_lk") == F.col("_rk")).select("left", "right", *names)
    return JoinedQuery(out, order)


def _by_index(left: DataFrame, right: Collection, index: Index, key: Column, order: tuple[bool, ...]) -> JoinedQuery:
    names = [c for c in left.columns if c != "left"]
    through = left.withColumn("_lk", key).join(index.df, F.col("_lk") == F.col("ik"))
    out = through.join(_right(right), F.col("tk") == F.col("_rk")).select("left", "right", *names, F.col("tk").alias(f"_o{len(names)}"))
    return JoinedQuery(out, (*order, True))


@dataclass(frozen=True)
class IndexQuery:
    """Targets of an index key: a filter, a limit, and whether to go on behind the key."""

    index: Index
    key: Any
    tests: tuple[Column, ...] = ()
    most: int | None = None
    on: bool = False

    def where_target_key(self, test: Test) -> IndexQuery:
        return replace(self, tests=(*self.tests, _condition(test, F.col("tk"))))

    def limit(self, n: int) -> IndexQuery:
        """At most ``n`` targets of those that pass, before any join; targets that lead nowhere count."""
        return replace(self, most=n)

    def proceed(self) -> IndexQuery:
        """Do not stop at the key's own pairs."""
        return replace(self, on=True)

    def pairs_df(self, ordered: bool = True) -> DataFrame:
        found = self.index.indexed(self.key, not self.on, ordered=False)
        if (test := _all(self.tests)) is not None:
            found = found.where(test)
        if self.most is not None and self.most <= 0:
            return found.limit(0)
        if ordered or self.most is not None:
            found = found.orderBy("ik", "tk")
        return found if self.most is None else found.limit(self.most)

    def to_df(self, ordered: bool = True) -> DataFrame:
        """Targets only; going on, a target may occur under several keys."""
        return self.pairs_df(ordered).select("tk")

    def to_list(self) -> list:
        return [r.tk for r in self.to_df().collect()]

    def to_stream(self):  # noqa: ANN201
        return (r.tk for r in self.to_df().toLocalIterator())

    def join(self, right: Collection) -> JoinedQuery:
        """(target key, record) of the targets that the collection holds."""
        left = self.pairs_df(ordered=False).select(F.col("tk").alias("left"), F.col("ik").alias("_o0"), F.col("tk").alias("_o1"))
        return _by_key(left, right, F.col("left"), (True, True))


@dataclass(frozen=True)
class JoinedQuery:
    """Pairs in the columns left and right; a further join makes struct(left, right) the new left."""

    df: DataFrame
    order: tuple[bool, ...]

    def filter(self, test: Callable[[Column, Column], Column]) -> JoinedQuery:
        """Only pairs that pass; Spark moves what concerns one side to that side."""
        return replace(self, df=self.df.where(test(F.col("left"), F.col("right"))))

    def _pair(self) -> DataFrame:
        names = [c for c in self.df.columns if c.startswith("_o")]
        return self.df.select(F.struct("left", "right").alias("left"), *names)

    def join_by_key(self, right: Collection, key: Callable[[Column, Column], Column]) -> JoinedQuery:
        return _by_key(self._pair(), right, key(F.col("left")["left"], F.col("left")["right"]), self.order)

    def join_by_index(self, right: Collection, index: Index, key: Callable[[Column, Column], Column]) -> JoinedQuery:
        return _by_index(self._pair(), right, index, key(F.col("left")["left"], F.col("left")["right"]), self.order)

    def to_df(self, ordered: bool = True) -> DataFrame:
        """left and right, in the left side's order, then the targets'."""
        df = self.df
        if ordered:
            df = df.orderBy(*[F.col(f"_o{i}").asc() if up else F.col(f"_o{i}").desc() for i, up in enumerate(self.order)])
        return df.select("left", "right")

    def to_list(self) -> list:
        return self.to_df().collect()

    def to_stream(self):  # noqa: ANN201
        return self.to_df().toLocalIterator()
