"""Filters as columns: strict equality, inclusive ranges and string prefixes; all of them false for missing fields."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .values import MIXED_NAMES, RANKS, is_mixed, kind_of, kind_of_type, literal, present, to_mixed

NUMBERS = {"int", "bigint"}


@dataclass(frozen=True)
class Eq:
    """Equal and of the same kind: 5 is neither 5.0 nor Big(5); null equals an explicit null; NaN equals nothing."""

    field: str
    value: object

    def column(self, df: DataFrame) -> Column:
        here = present(df, self.field)
        if self.field not in df.columns:
            return here
        c, t = F.col(self.field), df.schema[self.field].dataType
        if self.value is None:
            return here & c.isNull()
        kind = kind_of(self.value)
        if is_mixed(t) and not (kind == "double" and math.isnan(self.value)):
            return here & F.coalesce(c == literal(self.value, t), F.lit(False))
        if kind != kind_of_type(t) or kind == "double" and math.isnan(self.value):
            return F.lit(False)
        if kind == "map":
            if t.typeName() == "map":
                want = [F.struct(F.lit(k).cast(t.keyType).alias("key"), literal(v, t.valueType).alias("value")) for k, v in sorted(self.value.items())]
                same = F.array_sort(F.map_entries(c)) == (F.array(*want) if want else F.array().cast(f"array<struct<key:{t.keyType.simpleString()},value:{t.valueType.simpleString()}>>"))
            elif set(self.value) != set(t.names):
                return F.lit(False)
            else:
                same = F.lit(True)
                for name, v in self.value.items():
                    same = same & c[name].eqNullSafe(literal(v, t[name].dataType))
            return here & F.coalesce(same, F.lit(False))
        return here & (c == literal(self.value, t))


@dataclass(frozen=True)
class Range:
    """Between inclusive bounds, either of which may be left out; values of other kinds compare by kind.

    An explicit null ranks below everything: it passes an upper bound and fails a lower one.
    """

    field: str
    min: object = None
    max: object = None

    def column(self, df: DataFrame) -> Column:
        here = present(df, self.field)
        if self.field not in df.columns:
            return here
        c, t = F.col(self.field), df.schema[self.field].dataType
        kind = kind_of_type(t)
        out = here
        for bound, lower in ((self.min, True), (self.max, False)):
            if bound is None:
                continue
            other = kind_of(bound)
            if kind == "mixed":  # the struct's own order; numbers count whatever their kind
                x = literal(Row(*MIXED_NAMES)(*to_mixed(bound)[:-1], -1 if lower else 127), t)
                out = out & (F.coalesce(c >= x, F.lit(False)) if lower else (c <= x) | c.isNull())
            elif other == kind or {other, kind} <= NUMBERS:
                x = literal(bound, t)
                out = out & (c >= x if lower else (c <= x) | c.isNull())
            elif lower:
                out = out & (c.isNotNull() if RANKS[kind] > RANKS[other] else F.lit(False))
            else:
                out = out & (F.lit(True) if RANKS[kind] < RANKS[other] else c.isNull())
        return out


@dataclass(frozen=True)
class Prefix:
    """Strings that begin with `prefix`, by bytes."""

    field: str
    prefix: str

    def column(self, df: DataFrame) -> Column:
        if self.field not in df.columns:
            return F.lit(False)
        if is_mixed(df.schema[self.field].dataType):
            c = F.col(self.field)
            return present(df, self.field) & F.coalesce((c["kind"] == RANKS["string"]) & F.startswith(c["text"], F.lit(self.prefix)), F.lit(False))
        if kind_of_type(df.schema[self.field].dataType) != "string":
            return F.lit(False)
        return present(df, self.field) & F.startswith(F.col(self.field), F.lit(self.prefix))
