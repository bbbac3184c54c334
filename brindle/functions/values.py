"""The value taxonomy: kinds, their ranks, typed literals, presence, and the order of record keys.

A field of a row is missing, null or has a value.  Missing fields are null in their column and named in the
row's `_absent` array; a frame without that column has every field present.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaValidation

ABSENT = "_absent"
#: The order of kinds where values of different kinds meet.
RANKS = {"null": 0, "bool": 1, "int": 2, "bigint": 3, "double": 4, "datetime": 5, "string": 6, "bytes": 7, "list": 8, "map": 9}
INT64 = range(-(2**63), 2**63)


#: The type of a field that holds values of several kinds: numbers, texts and so on in columns of their own, in an order
#: that makes the struct sort by kind and then by value.  Lists and maps are JSON.  `kind` is last, as 5 and Big(5) are
#: one number.
MIXED = "struct<rank:tinyint,flag:boolean,number:decimal(38,0),real:double,time:timestamp,text:string,bytes:binary,json:string,kind:tinyint>"
MIXED_NAMES = ["rank", "flag", "number", "real", "time", "text", "bytes", "json", "kind"]
PLACE = {"bool": "flag", "int": "number", "bigint": "number", "double": "real", "datetime": "time", "string": "text", "bytes": "bytes", "list": "json", "map": "json"}


class Big(int):
    """An integer of up to 128 bits that isn't an int64, also where it would fit."""


def kind_of(value: object) -> str:
    """The kind of a Python value."""
    for types, kind in (((bool,), "bool"), ((Big, decimal.Decimal), "bigint"), ((float,), "double"), ((dt.datetime,), "datetime"), ((str,), "string"), ((bytes, bytearray), "bytes"), ((list, tuple), "list"), ((dict,), "map")):
        if isinstance(value, types):
            return kind
    if value is None:
        return "null"
    if isinstance(value, int):
        return "int" if value in INT64 else "bigint"
    raise SchemaValidation(f"{type(value).__name__} is no value type")


def is_mixed(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == MIXED_NAMES


def to_mixed(value: object) -> tuple | None:
    """A value as a row of MIXED."""
    kind = kind_of(value)
    if kind == "null":
        return None
    if PLACE[kind] == "number":
        held: object = decimal.Decimal(int(value))
    else:
        held = json.dumps(value, sort_keys=True, default=str) if PLACE[kind] == "json" else bytes(value) if kind == "bytes" else value
    rank = RANKS["int"] if kind == "bigint" else RANKS[kind]
    return (rank, *(held if n == PLACE[kind] else None for n in MIXED_NAMES[1:-1]), RANKS[kind])


def from_mixed(row: Row | None) -> object:
    """The value that a row of MIXED holds."""
    if row is None:
        return None
    kind = next(k for k, r in RANKS.items() if r == row["kind"])
    held = row[PLACE[kind]]
    if kind == "int":
        return int(held)
    if kind == "bigint":
        return Big(held)
    return json.loads(held) if PLACE[kind] == "json" else held


def kind_of_type(t: T.DataType) -> str:
    """The kind of a column's values; `mixed` for the type of several."""
    if is_mixed(t):
        return "mixed"
    if isinstance(t, T.DecimalType):
        if t.scale:
            raise SchemaValidation("decimals with a scale are no value type")
        return "bigint"
    for types, kind in (((T.BooleanType,), "bool"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType), "double"), ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.StringType,), "string"), ((T.BinaryType,), "bytes"), ((T.ArrayType,), "list"), ((T.MapType, T.StructType), "map"), ((T.NullType,), "null")):
        if isinstance(t, types):
            return kind
    raise SchemaValidation(f"{t.simpleString()} is no value type")


def literal(value: object, t: T.DataType) -> Column:
    """A literal of a column's own type; its kind has been checked."""
    if is_mixed(t):
        row = value if isinstance(value, Row) or value is None else to_mixed(value)
        if row is None:
            return F.lit(None).cast(t)
        return F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(row, t.fields, strict=True)))
    if isinstance(value, (Big, decimal.Decimal)) or isinstance(t, T.DecimalType):
        return F.lit(decimal.Decimal(int(value))).cast(T.DecimalType(38, 0))
    if isinstance(value, (list, tuple)):
        return F.array(*(literal(x, t.elementType) for x in value)).cast(t)
    if isinstance(value, bytearray):
        value = bytes(value)
    if isinstance(value, dt.datetime) and value.tzinfo and isinstance(t, T.TimestampNTZType):
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.lit(value).cast("bigint")
    return F.lit(value).cast(t)


def present(df: DataFrame, field: str) -> Column:
    """Whether a row has the field, be it null."""
    if field not in df.columns:
        return F.lit(False)
    if ABSENT not in df.columns:
        return F.lit(True)
    return ~F.coalesce(F.array_contains(F.col(ABSENT), field), F.lit(False))


def presence_counts(df: DataFrame, field: str) -> DataFrame:
    """One row: in how many rows a field is present, null or not, and in how many it is missing."""
    here = present(df, field)
    return df.agg(F.count_if(here).alias("present"), F.count_if(~here).alias("missing"))


def key_order(df: DataFrame, key: str) -> list[Column]:
    """Columns that sort by record key: strings by length in bytes and then bytes, numbers with negatives last."""
    c, kind = F.col(key), kind_of_type(df.schema[key].dataType)
    if kind in ("string", "bytes"):
        return [F.octet_length(c).asc(), c.asc()]
    if kind in ("int", "bigint"):
        return [(c < 0).asc(), c.asc()]
    if kind == "double":
        return [(c < 0).asc(), F.abs(c).asc()]
    if kind == "datetime":
        return [(c < F.lit(dt.datetime(1970, 1, 1)).cast(df.schema[key].dataType)).asc(), c.asc()]
    return [c.asc()]
