"""Sort orders as columns.

Explicit nulls come first ascending and last descending; missing fields the other way round; ties go by record
key, always ascending.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import ABSENT, key_order, present


@dataclass(frozen=True)
class SortSpec:
    field: str
    descending: bool = False


def order_by(df: DataFrame, specs: tuple[SortSpec, ...], key: str) -> list[Column]:
    out: list[Column] = []
    for s in specs:
        if s.field not in df.columns:
            continue
        c = F.col(s.field)
        if ABSENT in df.columns:
            missing = ~present(df, s.field)
            out.append(missing.desc() if s.descending else missing.asc())
        out.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
    return [*out, *key_order(df, key)]
