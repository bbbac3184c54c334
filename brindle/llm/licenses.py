"""License scans by diagonal voting: places in texts where the words of license templates stand.

Texts are lower-cased (A-Z) and cut into words.  Every run of `K` words of every text is joined by its hash to
the same runs of the templates; hits are counted on each diagonal (place in the text minus place in the
template), neighbouring diagonals are merged, and a span is kept if its verified hits cover enough of its
template.  A hit is verified by comparing the words themselves, so hash collisions never count.

Null texts count as empty: no words, no hits.  Very long texts are read whole; an empty table gives an empty result;
further columns don't matter.  Rows with the same id and the same text get the same result,
as do rows with a null id.  The templates are a fixed small table, which is why that side is broadcast.
Everything runs in Spark's own operators.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, table

#: The phrases whose whole occurrences are base places, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further templates, of which a part is enough; labels that the method adds.
TEMPLATES = {
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl-3-name": "gnu general public license version 3",
    "gpl-2-name": "gnu general public license version 2",
    "lgpl-3-name": "gnu lesser general public license version 3",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
}
K = 3  # words in a run
COVER = 0.6  # of a template's runs that a span must have
DRIFT = 2  # diagonals that words put in or left out may move a span
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; without empty strings at either end."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def runs_of(words: Column) -> Column:
    """All runs of K words in a row, each as one string.

    The array of words is bound to a lambda's variable, so that it's computed once for a text.
    """

    def runs(w: Column) -> Column:
        last = F.size(w) - K
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(K)))))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def template_runs(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(template, label, base, n_runs, tpos, run, hash) for each run of each template."""
    rows = []
    for kind, items in (("base", phrases.items()), ("own", ((v, k) for k, v in templates.items()))):
        for text, label in items:
            w = re.sub(SEPARATORS, " ", text.lower()).split()
            n = len(w) - K + 1
            rows += [(f"{kind}:{text}", label, kind == "base", n, i, " ".join(w[i : i + K])) for i in range(n)]
    df = spark.createDataFrame(rows, "template string, label string, base boolean, n_runs int, tpos int, run string")
    return F.broadcast(df.withColumn("hash", F.xxhash64("run")))


def hits_of(docs: DataFrame, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """Verified hits: (doc_id, th, template, label, base, n_runs, tpos, pos)."""
    runs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(runs_of(words_of(F.col("text")))).alias("pos", "run"))
    t = template_runs(docs.sparkSession, phrases, templates).withColumnsRenamed({"run": "trun", "hash": "thash"})
    hits = runs.withColumn("hash", F.xxhash64("run")).join(t, (F.col("hash") == F.col("thash")) & (F.col("run") == F.col("trun")))
    kept = ("doc_id", "th", "template", "label", "base", "n_runs", "tpos", "pos")
    return hits.select(*kept).dropDuplicates(["doc_id", "th", "template", "tpos", "pos"])


def spans_of(hits: DataFrame) -> DataFrame:
    """(doc_id, th, template, label, base, start, end, score): verified spans, in words, end exclusive.

    A base phrase's span is a diagonal that has all of its runs.  For other templates, hits on diagonals of which each
    is at most DRIFT from the next form one span.
    """
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    key = ("doc_id", "th", "template", "label", "base", "n_runs")
    votes = hits.groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("seen"))
    whole = votes.where("base and votes = n_runs").select(*key[:-1], F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_runs") + K - 1).alias("end"), F.lit(1.0).alias("score"))
    along = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    cut = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= DRIFT, 0).otherwise(1)
    merged = (
        votes.where("not base")
        .withColumn("cut", cut)
        .withColumn("part", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "part")
        .agg(F.min("lo").alias("start"), (F.max("hi") + K).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("found"))
        .withColumn("score", F.col("found") / F.col("n_runs"))
        .where(F.col("score") >= COVER)
        .select(*key[:-1], "start", "end", "score")
    )
    return whole.unionByName(merged)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """License spans of `docs`; see `spans_of`."""
    return spans_of(hits_of(docs, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: word counts, base places and labels of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = scan(docs)
    per = spans.groupBy("doc_id", "th").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    left = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")).alias("d")
    right = per.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.th") == F.col("p.th"))
    return left.join(right, same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """Words as an array; each template's runs counted by diagonal through list functions; the same rules."""
    values = []
    for kind, items in (("base", PHRASES.items()), ("own", ((v, k) for k, v in TEMPLATES.items()))):
        for text, label in items:
            w = text.split()
            values += [f"('{kind}:{text}','{label}',{str(kind == 'base').lower()},{len(w) - K + 1},{i},'{' '.join(w[i : i + K])}')" for i in range(len(w) - K + 1)]
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t(template, label, base, n_runs, tpos, run) AS (VALUES {", ".join(values)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{az}', '{az.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d),
h AS (SELECT p.doc_id, t.*, i - 1 AS pos, i - 1 - tpos AS diagonal FROM p JOIN t ON t.run = w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
v AS (SELECT doc_id, template, label, base, n_runs, diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi, list(tpos) AS seen FROM h GROUP BY ALL),
c AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER a <= {DRIFT} THEN 0 ELSE 1 END AS cut FROM v WHERE NOT base WINDOW a AS (PARTITION BY doc_id, template ORDER BY diagonal)),
m AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS part FROM c),
s AS (SELECT doc_id, label, true AS base, diagonal AS start, 1.0::DOUBLE AS score FROM v WHERE base AND votes = n_runs
  UNION ALL SELECT doc_id, label, false, min(lo), (len(list_distinct(flatten(list(seen)))) / n_runs::DOUBLE) AS score FROM m GROUP BY doc_id, template, label, n_runs, part HAVING len(list_distinct(flatten(list(seen)))) / n_runs::DOUBLE >= {COVER}),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (doc_id)"""


SQL = _sql()
