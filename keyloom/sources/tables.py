"""Tables in files as collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from keyloom.operators.collection import Collection


def collection(spark: SparkSession, folder: str, table: str, key: str | Sequence[str], form: str = "parquet", schema: T.StructType | str | None = None) -> Collection:
    """``folder/table.form`` as a collection; formats without a schema of their own need ``schema``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return Collection.of(reader.format(form).load(f"{folder}/{table}.{form}"), key, table)
