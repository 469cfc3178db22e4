"""A store: named collections and indexes in Parquet snapshots, under manifests that commit all of them at once.

``root/data/<name>/<id>/`` holds the snapshots and ``root/_manifest/<n>.json``
names, for every object, its kind, key, schema, snapshot, deltas and row count.
A write adds a delta: the rows that came, and the keys of those that went.
Reads put the latest row of a key in the deltas before the snapshot's.  Deltas
are folded into one once there are ``DELTAS`` of them, and into a new snapshot
once they have a quarter of its rows; objects of at most ``SMALL`` rows are
rewritten at once, which is quicker than merging.  A commit writes its files and then
creates manifest n + 1 exclusively; a reader keeps to the manifest it opened.
Files go through Hadoop's file system, so a store may lie wherever Spark reads
and writes.
"""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import errors as E
from keyloom.operators.collection import Collection
from keyloom.operators.index import Change, Derived, Index, Updater

#: Deltas that a reader merges at most, and how many times their rows a snapshot has at least.
DELTAS, SHARE = 8, 4
#: Rows that are rewritten rather than given a delta.
SMALL = 10_000
#: Columns of a delta beside the object's own: whether the key went, and whether it was there.
GONE, HAD = "_keyloom_gone", "_keyloom_had"

_writing = threading.local()
#: One lock for each store that this process writes to: a local disk's check for a file and its making are two steps.
_turns: dict[str, threading.Lock] = {}


@dataclass(frozen=True)
class StoreConfig:
    """Settings, from arguments or from ``KEYLOOM_*`` variables.

    ``sync``, ``max_readers``, ``max_collections`` and ``map_size`` are accepted
    for callers that set them; file systems under Spark have no such limits.
    """

    name: str = "default"
    home: str | None = None
    max_key_bytes: int = 511
    lock_timeout: float = 60.0
    lock_lease: float = 30.0
    sync: bool = False
    max_readers: int = 1000
    max_collections: int = 10_000
    map_size: int = 0

    @staticmethod
    def from_env(**given: Any) -> StoreConfig:
        kinds = {"max_key_bytes": int, "lock_timeout": float, "lock_lease": float, "sync": lambda x: x.lower() in ("1", "true"), "max_readers": int, "max_collections": int, "map_size": int}
        found = {}
        for f in StoreConfig.__dataclass_fields__:
            if (v := os.environ.get(f"KEYLOOM_{f.upper()}")) is not None:
                found[f] = kinds.get(f, str)(v)
        return StoreConfig(**found | {k: v for k, v in given.items() if v is not None})

    @property
    def path(self) -> str:
        home = self.home or os.path.join(os.path.expanduser("~"), ".keyloom")
        return f"{home.rstrip('/')}/{self.name}"


class Files:
    """What the store needs of Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, p: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self._path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def names(self, p: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(p))]

    def put(self, p: str, text: str, overwrite: bool = False) -> bool:
        """Write a file; False if there is one that must not be overwritten."""
        try:
            out = self.fs.create(self._path(p), overwrite)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" in str(e):
                return False
            raise E.StorageError(str(e)) from e
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        return True

    def age(self, p: str) -> float | None:
        """Seconds since a file was last touched; None if it has gone."""
        try:
            return time.time() - self.fs.getFileStatus(self._path(p)).getModificationTime() / 1000
        except Exception:  # noqa: BLE001
            return None

    def touch(self, p: str) -> None:
        self.fs.setTimes(self._path(p), int(time.time() * 1000), -1)

    def create(self, p: str, text: str, lease: float) -> bool:
        """Write a new file whole; False if it exists or another writer is about to make it.

        Exclusive by a claim with its owner's name, since renames may overwrite
        on some file systems.  A claim whose owner went before it made the file
        is taken over once it is older than ``lease``.
        """
        owner, claim = uuid.uuid4().hex, f"{p}.claim"
        while not self.put(claim, owner):
            age = self.age(claim)
            if self.exists(p) or (age is not None and age <= lease):
                return False
            self.delete(claim)
        part = f"{p}.{owner}"
        self.put(part, text, True)
        if self.exists(p) or self.read(claim) != owner:
            self.delete(part)
            return False
        return bool(self.fs.rename(self._path(part), self._path(p)))

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Store:
    """Open with ``Store.open``; reads see the latest commit, or one commit within ``read_only``."""

    def __init__(self, spark: SparkSession, config: StoreConfig) -> None:
        self.spark, self.config, self.path = spark, config, config.path
        self.files = Files(spark, self.path)
        self.files.mkdirs(f"{self.path}/_manifest")
        if not self.files.exists(f"{self.path}/_manifest/{0:012d}.json"):
            self.files.create(f"{self.path}/_manifest/{0:012d}.json", json.dumps({"objects": {}}), config.lock_lease)

    @staticmethod
    def open(spark: SparkSession, home: str | None = None, name: str | None = None, **options: Any) -> Store:
        return Store(spark, StoreConfig.from_env(home=home, name=name, **options))

    # Manifests.
    def version(self) -> int:
        return max(int(n[:-5]) for n in self.files.names(f"{self.path}/_manifest") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/_manifest/{version:012d}.json"))["objects"]

    def platform_check(self) -> None:
        """Write, read and delete a probe; raises if any of it fails."""
        where = f"{self.path}/_probe-{uuid.uuid4().hex}"
        try:
            self.spark.range(3).write.parquet(where)
            if self.spark.read.parquet(where).count() != 3:
                raise E.StorageError("the probe came back changed")
        finally:
            self.files.delete(where)

    # Transactions.
    @contextlib.contextmanager
    def read_only(self) -> Iterator[ReadTxn]:
        yield ReadTxn(self, self.version())

    @contextlib.contextmanager
    def read_write(self) -> Iterator[WriteTxn]:
        """All or nothing: commits at the end, drops everything if the body raises."""
        held = _writing.__dict__.setdefault("paths", set())
        if self.path in held:
            raise E.NestedWriteTransaction(self.path)
        lock, owner = f"{self.path}/_lock", uuid.uuid4().hex
        until = time.monotonic() + self.config.lock_timeout
        turn = _turns.setdefault(self.path, threading.Lock())
        if not turn.acquire(timeout=self.config.lock_timeout):
            raise E.StorageError(f"{lock} is held by another writer")
        try:
            self._take(lock, owner, until)
        except BaseException:
            turn.release()
            raise
        held.add(self.path)
        over = threading.Event()

        def keep() -> None:
            while not over.wait(self.config.lock_lease / 4):
                with contextlib.suppress(Exception):
                    if self.files.read(lock) == owner:
                        self.files.touch(lock)

        threading.Thread(target=keep, daemon=True).start()
        try:
            txn = WriteTxn(self, self.version())
            try:
                yield txn
                txn.commit()
            except BaseException:
                txn.abort()
                raise
        finally:
            over.set()
            held.discard(self.path)
            with contextlib.suppress(Exception):
                if self.files.read(lock) == owner:
                    self.files.delete(lock)
            turn.release()

    def _take(self, lock: str, owner: str, until: float) -> None:
        while True:
            if self.files.put(lock, owner):
                time.sleep(0.01)
                with contextlib.suppress(Exception):
                    if self.files.read(lock) == owner:
                        return
            # Its holder touches the lock again and again; one that does not any more has died.
            if (self.files.age(lock) or 0) > self.config.lock_lease:
                self.files.delete(lock)
            elif time.monotonic() > until:
                raise E.StorageError(f"{lock} is held by another writer")
            else:
                time.sleep(0.05)

    def vacuum(self, keep: int = 10) -> int:
        """Delete the snapshots and deltas that none of the last ``keep`` commits names, and older manifests; how many went.

        A reader that is pinned to one of those commits still finds its files.
        """
        with self.read_write():
            folder, gone = f"{self.path}/_manifest", 0
            versions = sorted(int(n[:-5]) for n in self.files.names(folder) if n.endswith(".json"))
            named = {f for v in versions[-max(1, keep) :] for o in self.manifest(v).values() for f in (o["snapshot"], *o.get("deltas", ()))}
            for v in versions[: -max(1, keep)]:
                for suffix in ("json", "json.claim"):
                    self.files.delete(f"{folder}/{v:012d}.{suffix}")
            for name in self.files.names(f"{self.path}/data") if self.files.exists(f"{self.path}/data") else ():
                for snapshot in self.files.names(f"{self.path}/data/{name}"):
                    if f"data/{name}/{snapshot}" not in named:
                        self.files.delete(f"{self.path}/data/{name}/{snapshot}")
                        gone += 1
        return gone

    # Catalog.
    def _names(self, kind: str | None) -> list[str]:
        return sorted(n for n, o in self.manifest(self.version()).items() if kind in (None, o["kind"]))

    def collections_available(self) -> list[str]:
        return self._names("collection")

    def indexes(self) -> list[str]:
        return self._names("index")

    def list_all(self) -> list[str]:
        return self._names(None)

    def collection_exists(self, name: str) -> bool:
        return name in self.collections_available()

    def index_exists(self, name: str) -> bool:
        return name in self.indexes()

    def collection_create(self, name: str, key: str | tuple[str, ...], schema: T.StructType | str, fail_if_exists: bool = True) -> StoredCollection:
        if not fail_if_exists and self.collection_exists(name):
            return self.collection_get(name, schema)
        with self.read_write() as txn:
            txn.create(name, "collection", (key,) if isinstance(key, str) else tuple(key), _schema(self.spark, schema))
        return self.collection_get(name)

    def collection_allocate(self, name: str, key: str | tuple[str, ...], schema: T.StructType | str) -> None:
        self.collection_create(name, key, schema)

    def collection_get(self, name: str, schema: T.StructType | str | None = None) -> StoredCollection:
        """A handle; a schema that differs from the stored one is an error at once."""
        entry = self.manifest(self.version()).get(name)
        if entry is None or entry["kind"] != "collection":
            raise E.CollectionNotFound(name)
        if schema is not None and _plain(_schema(self.spark, schema)) != _plain(T.StructType.fromJson(entry["schema"])):
            raise E.CodecFailure(f"{name} has another schema")
        return StoredCollection(self, name)

    def collection_size(self, name: str) -> int:
        """From the manifest, without a scan."""
        entry = self.manifest(self.version()).get(name)
        if entry is None or entry["kind"] != "collection":
            raise E.CollectionNotFound(name)
        return entry["rows"]

    def collection_clear(self, name: str) -> None:
        self.collection_get(name).clear()

    def collection_drop(self, name: str) -> None:
        self._drop(name, "collection", E.CollectionNotFound)

    def index_create(self, name: str, ik: str = "string", tk: str = "string", fail_if_exists: bool = True) -> StoredIndex:
        if not fail_if_exists and self.index_exists(name):
            return self.index_get(name)
        with self.read_write() as txn:
            txn.create(name, "index", ("ik", "tk"), _schema(self.spark, f"ik {ik}, tk {tk}"))
        return self.index_get(name)

    def index_get(self, name: str) -> StoredIndex:
        if not self.index_exists(name):
            raise E.IndexNotFound(name)
        return StoredIndex(self, name)

    def index_drop(self, name: str) -> None:
        self._drop(name, "index", E.IndexNotFound)

    def index_clear(self, name: str) -> None:
        self.index_get(name).clear()

    def _drop(self, name: str, kind: str, missing: type[Exception]) -> None:
        with self.read_write() as txn:
            if txn.objects.get(name, {}).get("kind") != kind:
                raise missing(name)
            del txn.objects[name]
            txn.staged.pop(name, None)


def _schema(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def _plain(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


class ReadTxn:
    """All reads see one commit."""

    def __init__(self, store: Store, version: int) -> None:
        self.store, self.version = store, version
        self.objects: dict[str, dict] = store.manifest(version)

    def _entry(self, name: str, kind: str) -> dict:
        entry = self.objects.get(name)
        if entry is None or entry["kind"] != kind:
            raise (E.CollectionNotFound if kind == "collection" else E.IndexNotFound)(name)
        return entry

    def _df(self, name: str, kind: str) -> DataFrame:
        entry = self._entry(name, kind)
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["snapshot"]:
            return self.store.spark.createDataFrame([], schema)
        base = self.store.spark.read.schema(schema).parquet(f"{self.store.path}/{entry['snapshot']}")
        if not entry.get("deltas"):
            return base
        changes = self._changes(entry)
        came = changes.where(~F.col(GONE))
        return base.join(changes.select(*entry["key"]), entry["key"], "left_anti").select(*schema.names).unionByName(came.select(*schema.names))

    def _changes(self, entry: dict) -> DataFrame:
        """The deltas as one: the latest row of every key in them."""
        schema = T.StructType.fromJson(entry["schema"])
        marked = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])
        each = [self.store.spark.read.schema(marked).parquet(f"{self.store.path}/{d}") for d in entry["deltas"]]
        if len(each) == 1:
            return each[0]
        both = each[0].withColumn("_keyloom_nth", F.lit(0))
        for i, d in enumerate(each[1:], 1):
            both = both.unionByName(d.withColumn("_keyloom_nth", F.lit(i)))
        rest = [c for c in marked.names if c not in entry["key"]]
        last = both.groupBy(*entry["key"]).agg(F.max_by(F.struct(*rest), F.col("_keyloom_nth")).alias("_keyloom_row"))
        return last.select(*entry["key"], "_keyloom_row.*")

    def collection(self, name: str) -> Collection:
        df = self._df(name, "collection")
        return Collection(df, tuple(self.objects[name]["key"]), name)

    def index(self, name: str) -> Index:
        return Index(self._df(name, "index"))

    def collection_exists(self, name: str) -> bool:
        return self.objects.get(name, {}).get("kind") == "collection"

    def index_exists(self, name: str) -> bool:
        return self.objects.get(name, {}).get("kind") == "index"

    def collection_size(self, name: str) -> int:
        return self._entry(name, "collection")["rows"]


class WriteTxn(ReadTxn):
    """Reads see its own writes.  Every write becomes files at once, so that lineage does not grow; commit only names them."""

    def __init__(self, store: Store, version: int) -> None:
        super().__init__(store, version)
        self.staged: dict[str, DataFrame] = {}
        self.made: list[str] = []

    def create(self, name: str, kind: str, key: tuple[str, ...], schema: T.StructType) -> None:
        if name in self.objects:  # one namespace for both kinds
            raise (E.CollectionAlreadyExists if kind == "collection" else E.IndexAlreadyExists)(name)
        self.objects[name] = {"kind": kind, "key": list(key), "schema": schema.jsonValue(), "snapshot": "", "rows": 0}

    def _put(self, name: str, df: DataFrame, order: list[str]) -> None:
        entry = self.objects[name]
        schema = T.StructType.fromJson(entry["schema"])
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        where = f"data/{name}/{uuid.uuid4().hex}"
        full = f"{self.store.path}/{where}"
        # Ranges of keys, sorted within: scans skip files and row groups by the key.
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(full)
        self.made.append(full)
        rows = self.store.spark.read.schema(schema).parquet(full).count()
        self.objects[name] = entry | {"snapshot": where, "rows": rows, "deltas": [], "base": rows, "changed": 0}

    def _add(self, name: str, change: Change) -> None:
        """Write a delta, and fold deltas where there are many or they are large."""
        entry, spark = self.objects[name], self.store.spark
        schema, key = T.StructType.fromJson(entry["schema"]), entry["key"]
        rows = None
        for df, went in ((change.come, False), (change.gone, True)):
            if df is not None:
                part = df.select(*[F.col(f.name).cast(f.dataType) if f.name in key or not went else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(went).alias(GONE))
                rows = part if rows is None else rows.unionByName(part)
        there = change.before.select(*key, F.lit(True).alias(HAD))
        rows = rows.join(there, key, "left").withColumn(HAD, F.coalesce(HAD, F.lit(False)))
        # What was not there cannot go, and a row of nothing but its key cannot change.
        rows = rows.where(F.col(HAD) | ~F.col(GONE))
        if len(key) == len(schema.fields):
            rows = rows.where(F.col(GONE) | ~F.col(HAD))
        where = self._delta(name, rows.select(*schema.names, GONE, HAD), key)
        made = spark.read.parquet(f"{self.store.path}/{where}")
        n = made.agg(F.count("*").alias("all"), F.count_if(F.col(GONE)).alias("went"), F.count_if(~F.col(GONE) & ~F.col(HAD)).alias("came")).first()
        if not n["all"]:
            self._unmake(where)
            return
        entry |= {"deltas": [*entry.get("deltas", ()), where], "rows": entry["rows"] + n.came - n.went, "changed": entry.get("changed", 0) + n["all"]}
        self.objects[name] = entry
        if entry["changed"] * SHARE > entry.get("base", entry["rows"]):
            self._put(name, self._df(name, entry["kind"]), key)
            self._unmake(where)
        elif len(entry["deltas"]) >= DELTAS:
            folded = self._delta(name, self._changes(entry), key)
            changed = spark.read.parquet(f"{self.store.path}/{folded}").count()
            self.objects[name] = entry | {"deltas": [folded], "changed": changed}
            self._unmake(where)

    def _delta(self, name: str, rows: DataFrame, key: list[str]) -> str:
        where = f"data/{name}/{uuid.uuid4().hex}"
        self.made.append(f"{self.store.path}/{where}")
        rows.sortWithinPartitions(*key).write.parquet(f"{self.store.path}/{where}")
        return where

    def _unmake(self, where: str) -> None:
        """Delete a delta of this write that no commit and no earlier read names."""
        self.store.files.delete(f"{self.store.path}/{where}")
        self.made.remove(f"{self.store.path}/{where}")

    def _change(self, name: str, after: Collection | Index, before: Collection | Index, key: list[str]) -> None:
        if after.df is before.df:
            return
        change = after.change
        if change is not None and change.before is before.df and self.objects[name]["snapshot"] and self.objects[name]["rows"] > SMALL:
            self._add(name, change)
        else:
            self._put(name, after.df, key)

    def put_collection(self, name: str, c: Collection, before: Collection) -> None:
        """``c`` in place of ``before``: the difference if one write made it, else all of it."""
        self._entry(name, "collection")
        self._change(name, c, before, list(c.key))

    def put_index(self, name: str, i: Index, before: Index) -> None:
        self._entry(name, "index")
        self._change(name, i, before, ["ik", "tk"])

    def lift(self, handle: StoredCollection | StoredIndex) -> StoredCollection | StoredIndex:
        """The handle bound to this transaction; several may share it."""
        return replace(handle, txn=self)

    def _check_keys(self, keys: DataFrame, key: tuple[str, ...]) -> None:
        texts = [c for c in key if isinstance(keys.schema[c].dataType, T.StringType)]
        bad = F.lit(False)
        for c in key:
            bad = bad | F.col(c).isNull()
        size = F.lit(0)
        for c in texts:
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        seen = keys.select(bad.alias("missing"), (size > self.store.config.max_key_bytes).alias("long")).where("missing OR long").limit(1).collect()
        if seen:
            if seen[0]["long"]:
                raise E.OverSizedKey(f"over {self.store.config.max_key_bytes} bytes")
            raise E.CodecFailure("a key is null")

    def commit(self) -> None:
        where = f"{self.store.path}/_manifest/{self.version + 1:012d}.json"
        if self.objects == self.store.manifest(self.version):
            return
        if not self.store.files.create(where, json.dumps({"objects": self.objects}), self.store.config.lock_lease):
            raise E.WriteConflict(where)

    def abort(self) -> None:
        for p in self.made:
            self.store.files.delete(p)


@dataclass(frozen=True)
class StoredCollection:
    """A handle on a stored collection: reads like ``Collection``, writes commit.

    ``indexes`` maps the names of stored indexes to how their pairs follow from
    a row; attaching one gives a new handle, and every write keeps them up in
    the same transaction.
    """

    store: Store
    name: str
    indexes: tuple[tuple[str, Derived | Updater], ...] = ()
    txn: WriteTxn | ReadTxn | None = None

    def with_index(self, index: str, keys: Column) -> StoredCollection:
        return replace(self, indexes=(*self.indexes, (index, Derived(keys, None))))

    def with_index_full(self, index: str, pairs: Column) -> StoredCollection:
        return replace(self, indexes=(*self.indexes, (index, Derived(None, pairs))))

    def with_updater(self, index: str, updater: Updater) -> StoredCollection:
        return replace(self, indexes=(*self.indexes, (index, updater)))

    def now(self) -> Collection:
        """The rows as of this transaction, or of the latest commit."""
        return (self.txn or ReadTxn(self.store, self.store.version())).collection(self.name)

    def query(self):  # noqa: ANN201
        return self.now().query()

    def exists(self) -> bool:
        return (self.txn or ReadTxn(self.store, self.store.version())).collection_exists(self.name)

    def size(self) -> int:
        return (self.txn or ReadTxn(self.store, self.store.version())).collection_size(self.name)

    @contextlib.contextmanager
    def read_only(self) -> Iterator[StoredCollection]:
        with self.store.read_only() as txn:
            yield replace(self, txn=txn)

    @contextlib.contextmanager
    def read_write(self) -> Iterator[StoredCollection]:
        with self.store.read_write() as txn:
            yield replace(self, txn=txn)

    def lift(self, txn: ReadTxn) -> StoredCollection:
        return replace(self, txn=txn)

    # Reads by key.
    def _row(self, df: DataFrame):  # noqa: ANN202
        return next(iter(df.collect()), None)

    def fetch(self, key: Any):  # noqa: ANN201
        c = self.now()
        return self._row(c.fetch(key).select(*c.values))

    def contains(self, key: Any) -> bool:
        return self.now().contains(key).first().found

    def fetch_at(self, position: int):  # noqa: ANN201
        return self._row(self.now().fetch_at(position))

    def head(self):  # noqa: ANN201
        return self._row(self.now().head())

    def last(self):  # noqa: ANN201
        return self._row(self.now().last())

    def next(self, key: Any):  # noqa: ANN201
        return self._row(self.now().next(key))

    def previous(self, key: Any):  # noqa: ANN201
        return self._row(self.now().previous(key))

    def collect(self, **options: Any) -> list:
        return self.now().collect(**options)

    def stream(self, **options: Any):  # noqa: ANN201
        return self.now().stream(**options)

    def stream_with_keys(self, **options: Any):  # noqa: ANN201
        return self.now().stream_with_keys(**options)

    # Writes.
    def _write(self, change: Callable[[WriteTxn, Collection], tuple[Collection, Any]]) -> Any:
        if self.txn is not None:
            if not isinstance(self.txn, WriteTxn):
                raise E.StorageError("a write in a read-only transaction")
            return self._apply(self.txn, change)
        with self.store.read_write() as txn:
            return self._apply(txn, change)

    def _apply(self, txn: WriteTxn, change: Callable) -> Any:
        c = txn.collection(self.name)
        c = replace(c, indexes={n: (how, txn.index(n)) for n, how in self.indexes})
        after, result = change(txn, c)
        txn.put_collection(self.name, after, c)
        for n in after.indexes:
            txn.put_index(n, after.index(n), c.index(n))
        return result(txn) if callable(result) else result

    def _result(self, given: Any, df: DataFrame) -> Any:
        """Rows for keys that came as a list; for a batch of any size a DataFrame over snapshots, of which the caller collects what it likes."""
        return df if isinstance(given, DataFrame) else df.collect()

    def _frame(self, rows: DataFrame | list | dict | tuple) -> tuple[DataFrame, str | None]:
        """The rows, and for a list the column that says which of a key's rows is the last."""
        if isinstance(rows, DataFrame):
            return rows, None
        schema = self.now().df.schema
        rows = [tuple(r.get(f.name) for f in schema) if isinstance(r, dict) else tuple(r) for r in (rows if isinstance(rows, list) else [rows])]
        ordered = T.StructType([*schema.fields, T.StructField("_nth", T.LongType())])
        return self.store.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ordered), "_nth"

    def _keys(self, keys: Any) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys
        c = self.now()
        rows = keys if isinstance(keys, list) else [keys]
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        return self.store.spark.createDataFrame(rows, T.StructType([c.df.schema[k] for k in c.key]))

    def upsert_overwrite(self, rows: Any, sequence: str | None = None) -> None:
        """Of a key that repeats the last row in a list, or by ``sequence``, wins; in a DataFrame without one it is an error."""
        batch, nth = self._frame(rows)
        sequence = sequence or nth
        if sequence != nth and nth:
            batch = batch.drop(nth)

        def change(txn: WriteTxn, c: Collection) -> tuple[Collection, None]:
            txn._check_keys(batch, c.key)
            return c.upsert_overwrite(batch, sequence), None

        self._write(change)

    def upsert(self, keys: Any, modify: Callable) -> list:
        """The rows after ``modify(old, exists)``."""
        batch = self._keys(keys)

        def change(txn: WriteTxn, c: Collection) -> tuple[Collection, Callable]:
            txn._check_keys(batch, c.key)
            after, _ = c.upsert(batch, modify)
            return after, lambda txn: self._result(keys, txn.collection(self.name).df.join(batch.select(*c.key), list(c.key), "left_semi"))

        return self._write(change)

    def update(self, keys: Any, modify: Callable) -> list:
        batch = self._keys(keys)

        def change(txn: WriteTxn, c: Collection) -> tuple[Collection, Callable]:
            after, _ = c.update(batch, modify)
            return after, lambda txn: self._result(keys, txn.collection(self.name).df.join(batch.select(*c.key), list(c.key), "left_semi"))

        return self._write(change)

    def delete(self, keys: Any) -> list:
        """The rows that went."""
        batch = self._keys(keys)

        def change(txn: WriteTxn, c: Collection) -> tuple[Collection, Any]:
            after, gone = c.delete(batch)
            return after, lambda txn: self._result(keys, gone)

        return self._write(change)

    def clear(self) -> None:
        self._write(lambda txn, c: (c.clear(), None))

    def rebuild_indexes(self) -> None:
        self._write(lambda txn, c: (c.rebuild_indexes(), None))


@dataclass(frozen=True)
class StoredIndex:
    """A handle on a stored index."""

    store: Store
    name: str
    txn: WriteTxn | ReadTxn | None = None

    def now(self) -> Index:
        return (self.txn or ReadTxn(self.store, self.store.version())).index(self.name)

    def exists(self) -> bool:
        return (self.txn or ReadTxn(self.store, self.store.version())).index_exists(self.name)

    @contextlib.contextmanager
    def read_only(self) -> Iterator[StoredIndex]:
        with self.store.read_only() as txn:
            yield replace(self, txn=txn)

    @contextlib.contextmanager
    def read_write(self) -> Iterator[StoredIndex]:
        with self.store.read_write() as txn:
            yield replace(self, txn=txn)

    def lift(self, txn: ReadTxn) -> StoredIndex:
        return replace(self, txn=txn)

    def _frame(self, pairs: Any) -> DataFrame:
        if isinstance(pairs, DataFrame):
            return pairs.select("ik", "tk")
        return self.store.spark.createDataFrame(pairs if isinstance(pairs, list) else [pairs], self.now().df.schema)

    def _write(self, change: Callable[[Index], tuple[Index, DataFrame | None]]) -> DataFrame | None:
        def apply(txn: WriteTxn) -> DataFrame | None:
            before = txn.index(self.name)
            after, result = change(before)
            txn.put_index(self.name, after, before)
            return result

        if isinstance(self.txn, WriteTxn):
            return apply(self.txn)
        if self.txn is not None:
            raise E.StorageError("a write in a read-only transaction")
        with self.store.read_write() as txn:
            return apply(txn)

    def index(self, pairs: Any) -> None:
        batch = self._frame(pairs)
        self._write(lambda i: (i.index(batch), None))

    def unindex(self, pairs: Any) -> list | DataFrame:
        """The pairs that were there when they were removed: a list for a list, a DataFrame over the snapshot for a DataFrame."""
        there = self._write(lambda i: i.unindex(self._frame(pairs)))
        return there if isinstance(pairs, DataFrame) else there.collect()

    def clear(self) -> None:
        self._write(lambda i: (i.clear(), None))

    def _row(self, df: DataFrame):  # noqa: ANN202
        return next(iter(df.collect()), None)

    def contains(self, key: Any, target: Any) -> bool:
        return self.now().contains(key, target).first().found

    def has_key(self, key: Any) -> bool:
        return self.now().has_key(key).first().found

    def head(self):  # noqa: ANN201
        return self._row(self.now().head())

    def last(self):  # noqa: ANN201
        return self._row(self.now().last())

    def next(self, key: Any):  # noqa: ANN201
        return self._row(self.now().next(key))

    def previous(self, key: Any):  # noqa: ANN201
        return self._row(self.now().previous(key))

    def fetch(self, key: Any):  # noqa: ANN201
        row = self._row(self.now().fetch(key))
        return None if row is None else row.tk

    def fetch_at(self, position: int):  # noqa: ANN201
        return self._row(self.now().fetch_at(position))

    def indexed(self, key: Any, limit_to_key: bool = True):  # noqa: ANN201
        return self.now().indexed(key, limit_to_key).toLocalIterator()

    def query(self, key: Any):  # noqa: ANN201
        return self.now().query(key)
