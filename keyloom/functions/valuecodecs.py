"""Values as JSON text and back, in UTF-8 both ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def record_decode(text: Column, schema: T.StructType | str, strict: bool = True) -> Column:
    """A record from JSON; ``strict`` raises on malformed text, else its fields are null."""
    return F.from_json(text, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def record_encode(record: Column) -> Column:
    return F.to_json(record)


def any_decode(text: Column) -> Column:
    """Any JSON value, as a variant; malformed text raises."""
    return F.parse_json(text)


def any_encode(value: Column) -> Column:
    return F.to_json(value)


def _in_record(text: Column, kind: str) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {kind}", {"mode": "FAILFAST"})["v"]


def text_decode(text: Column) -> Column:
    return _in_record(text, "string")


def text_encode(value: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")


def number_decode(text: Column, kind: str = "decimal(38,18)") -> Column:
    """A JSON number as int, double, float or decimal; a number that does not fit, or text that is no JSON number, raises."""
    good = text.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")
    text = F.when(~good, F.raise_error(F.lit("not a JSON number"))).otherwise(text)
    return text.cast("decimal(38,18)").cast(kind) if kind == "int" else text.cast(kind)


def number_encode(value: Column) -> Column:
    return value.cast("string")


def custom(encode: Callable, decode: Callable, kind: T.DataType | str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """A pair of column functions from Python functions over pandas Series, bytes on the encoded side."""
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(encode, "binary"), pandas_udf(decode, kind)
