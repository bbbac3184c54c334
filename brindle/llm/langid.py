"""Language identification of web pages by fusing evidence.

The log posterior of a language is the sum of four kinds of evidence: the text's likelihood under character
trigram models (tempered, as neighbouring trigrams depend on each other), how often pages of that language
declare the markup language that this page declares, how often their addresses have this address's suffix, and
the log prior of the page's host.  Declared languages and suffixes are judged against what the texts alone say,
by grouped counts over all pages.  A host's prior is smoothed towards its domain's, and that towards all pages'.

The trigram models are fitted on a sample of labelled documents, `SAMPLE_DOCS` of each language at most, picked
by hash.  Null or empty pages have no text or markup evidence: their priors decide.  Ties go to the language
that sorts first.  Every labelled language counts; more than `LANGUAGES` are refused.  Without labelled documents there
are no languages, and `lang` is null.  Repeated rows get equal results; each counts as a page of its host.  Very long
pages are read whole, broken markup as far as it goes; an empty table of pages gives an empty result.  Further columns
don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_batches, small_side, table, written

SAMPLE_DOCS = 400
BUCKETS = 1 << 16
LANGUAGES = 512  # a model takes half a megabyte
TEMPER = 0.15
HOST_WEIGHT, DOMAIN_WEIGHT = 8.0, 32.0
TAGS = re.compile(r"(?is)<(script|style)\b.*?(</\1\s*>|$)|<!--.*?(-->|$)|<[^>]*>")
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text's lower-cased words."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] * 65_599 + b[1:-1] * 257 + b[2:]) * np.uint32(2_654_435_761)) >> np.uint32(16) if len(b) > 2 else np.empty(0, np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for b in row_batches(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held[lang] += np.bincount(trigrams(text or ""), minlength=BUCKETS)
    for lang, c in held.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of each bucket."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id").where("lang is not null and doc_id is not null")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"documents are labelled with more than {LANGUAGES} languages")
    rank = F.xxhash64("doc_id")
    ids = [r["doc_id"] for x in langs for r in known.where(F.col("lang") == x).orderBy(rank, "doc_id").limit(SAMPLE_DOCS).collect()]
    if not ids:
        return [], np.zeros((0, BUCKETS))
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(x,) for x in ids], docs.select("doc_id").schema))
    sample = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(chosen, "doc_id", "left_semi")
    rows = sample.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(langs), BUCKETS), 0.1)
    for r in rows.where(F.col("lang").isin(langs)).toLocalIterator():
        counts[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def page_text(html: str) -> str:
    return TAGS.sub(" ", html)


def _likelihoods(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in row_batches(batches):
            out = []
            for html in b.column(4).to_pylist():
                n = np.bincount(trigrams(page_text(html or "")), minlength=BUCKETS) if html else None
                at = np.flatnonzero(n) if n is not None else []
                x = TEMPER * (model[:, at] @ n[at]) if len(at) else np.zeros(len(model))
                out.append((x - x.max()).tolist() if len(x) else [])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), b.column(5), pa.array(out, pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "text"])

    return run


def _best(scores: Column) -> Column:
    """The place, from 0, of the largest score; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _table(pages: DataFrame, kind: str, n: int) -> dict[str, list[float]]:
    """log P(value | language) for each of the few values of a kind of evidence, from the texts' own verdicts."""
    rows = pages.where("sure").groupBy(kind, "first").agg(F.count(F.lit(1)).alias("n")).collect()
    values = sorted({r[kind] for r in rows})
    counts = np.full((len(values), n), 0.5)
    for r in rows:
        counts[values.index(r[kind]), r["first"]] += r["n"]
    return {v: x.tolist() for v, x in zip(values, np.log(counts / counts.sum(0)), strict=True)}


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """`page_id`, `lang`, `confidence`, `text_lang`, `declared`, `suffix` and `host` for every row of `pages`."""
    spark = pages.sparkSession
    langs, model = fit(docs)
    ids = pages.schema["page_id"].dataType.simpleString()
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"), none.alias("host"))
    n = len(langs)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    known = F.array(*(F.lit(x) for x in langs))

    def code(c: Column) -> Column:
        return F.when(F.array_contains(known, c), c).when(c == "", "").otherwise("?")

    suffix = F.concat_ws("/", F.regexp_extract(host, r"\.([a-z]{2,6})$", 1), code(F.lower(F.regexp_extract(url, r"(?s)://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))))
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    html = F.col("html").cast("string")
    read = pages.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), html.alias("html"), code(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), DECLARED, 1))).alias("declared"))
    seen = read.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)), f"page_id {ids}, host string, domain string, suffix string, declared string, text array<double>")
    total = F.aggregate("text", F.lit(0.0), lambda a, x: a + F.exp(x))
    seen = written(seen.withColumn("first", _best(F.col("text"))).withColumn("sure", total < 1.2), "pages")
    evidence = _table(seen, "declared", n)
    counts = [F.sum((F.col("sure") & (F.col("first") == k)).cast("double")).alias(f"c{k}") for k in range(n)]
    overall = seen.agg(*counts).first()
    everything = [(x or 0.0) + 0.5 for x in overall]
    top = [x / sum(everything) for x in everything]

    def smoothed(own: list[Column], above: list[Column], weight: float) -> Column:
        size = sum(own[1:], own[0])
        return F.array(*((c + F.lit(weight) * a) / (size + F.lit(weight)) for c, a in zip(own, above, strict=True)))

    hosts = seen.groupBy("host", "domain").agg(*counts)
    domains = hosts.groupBy("domain").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(n)))
    domains = domains.select("domain", smoothed([F.col(f"c{k}") for k in range(n)], [F.lit(x) for x in top], DOMAIN_WEIGHT).alias("above"))
    hosts = hosts.join(domains, "domain").select(F.col("host").alias("h"), smoothed([F.col(f"c{k}") for k in range(n)], [F.get("above", F.lit(k)) for k in range(n)], HOST_WEIGHT).alias("prior"))

    flat = F.array(*(F.lit(0.0) for _ in range(n)))
    suffixes = written(seen.where("sure").groupBy("suffix").agg(*counts), "suffixes")
    values = suffixes.count()
    logs = F.array(*(F.log((F.col(f"c{k}") + F.lit(0.5)) / F.lit((overall[k] or 0.0) + 0.5 * values)) for k in range(n)))
    suffixes = small_side(suffixes.select(F.col("suffix").alias("x"), logs.alias("by_suffix")), values, 40 + 8 * n)

    def looked_up(kind: str) -> Column:
        out = None
        for value, logs in evidence.items():
            x = F.array(*(F.lit(v) for v in logs))
            out = F.when(F.col(kind) == value, x) if out is None else out.when(F.col(kind) == value, x)
        return flat if out is None else out.otherwise(flat)

    joined = seen.join(hosts, seen["host"] == hosts["h"], "left").join(suffixes, seen["suffix"] == suffixes["x"], "left")
    joined = joined.withColumn("d", looked_up("declared")).withColumn("s", F.coalesce("by_suffix", flat))
    scores = F.array(*(F.get("text", F.lit(k)) + F.get("d", F.lit(k)) + F.get("s", F.lit(k)) + F.log(F.get("prior", F.lit(k))) for k in range(n)))
    joined = joined.withColumn("scores", scores).withColumn("best", _best(F.col("scores")))
    mass = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("scores")))
    return joined.select("page_id", F.get(known, F.col("best")).alias("lang"), (F.lit(1.0) / mass).alias("confidence"), F.get(known, F.col("first")).alias("text_lang"), "declared", "suffix", "host")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: the language of every page."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
