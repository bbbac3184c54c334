"""The queries of this subpackage's operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, leaks, licenses, media, neardup, pseudo, repeats, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urls": urls.query,
        "op2_langid": langid.query,
        "op3_bpe": bpe.query,
        "op4_media": media.query,
        "op5_pseudo": pseudo.query,
        "op6_leaks": leaks.query,
        "op7_repeats": repeats.query,
        "op8_toxicity": toxicity.query,
        "op9_licenses": licenses.query,
        "op10_neardup": neardup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urls": urls.SQL,
        "op7_repeats": repeats.SQL,
        "op9_licenses": licenses.SQL,
    }
