"""A pipeline that prepares `documents` for training; each stage's rows are written as Parquet and read again.

Null and empty texts pass all filters; very long ones are read whole.  Rows that repeat an id and a text are one document,
of which one row stays; empty texts are no copies of each other.  An empty table gives an empty result.  Further columns,
whatever their names, go through all stages but the last unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, leaks, neardup, repeats, toxicity
from brindle.llm.common import ease, small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's ids and what they decode to."""
    return bpe.tokenize(docs, bpe.vocabulary_path())


def _in_small_batches(stage: Stage) -> Stage:
    """The same stage in a session that hands texts to Python in small batches, when the result is written too.

    The driver returns what it doesn't use before and after, so that what a stage left doesn't add to the next one's.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        ease(spark)
        out = stage(spark, docs, sf_dir)
        ease(spark)
        return out

    return run


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in (
        ("toxicity", toxicity.stage),
        ("near_duplicates", neardup.stage),
        ("substring_dedup", repeats.stage),
        ("decontamination", leaks.stage),
        ("bpe", tokens),
    )
]

#: No SQL: classifiers, approximate matches and the tokenizer can't be said in it; tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
