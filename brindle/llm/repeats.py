"""Substring deduplication by line and paragraph hashing.

A text's units are its lines of `MIN_WORDS` words or more, and, as passages also stand inside lines and across them,
runs of phrases: a phrase begins with a line, after `.`, `!` or `?`, or at a word in upper case, and a run takes as many
phrases from there as make `RUN_WORDS` words or more, over line ends too.  Units are normalised (lower case, words
joined by single spaces) and get a 128-bit digest.  Digests are grouped over the whole corpus; the occurrence that
ranks first, by doc_id and then by place, stays and the words of all later ones are removed.  So every phrase of a
passage that repeats goes, up to the part phrases at its ends; shorter lines and phrases that no repeated unit holds
stay.  The first occurrence of any phrase is never removed: what removes it stands earlier.

Hot units don't meet in one task: each task keeps what it has seen and marks all but the earliest of its own
occurrences itself, so a digest brings a few rows a task to the grouping, however often it occurs.

The result keeps every row.  Null texts stay null; empty and blank ones stay as they are; very long ones are read
whole.  Rows with a null id rank last.  Rows that repeat both an id and a text are one document: all of them keep the
same units.  Rows that share an id but not the text are told apart by the text's hash.  An empty table gives an empty
result.  `kept` lists the original offsets, in characters, of what remains; further columns go through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, row_batches, table, worker_state, written

MIN_WORDS = 5
RUN_WORDS = 20
CACHED_WORDS, CACHED_UNITS = 1 << 17, 1 << 16
SPANS = "array<struct<start:int,end:int>>"
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so each has an inverse
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
WORD = re.compile(r"\S+")


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


class Words:
    """Hashes of words, and whether they begin or end a phrase; keeps those that it has seen lately."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hash = np.zeros(CACHED_WORDS, U)
        self.opens, self.closes = np.zeros(CACHED_WORDS, bool), np.zeros(CACHED_WORDS, bool)
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = self.place
        new = set(words).difference(place)
        if len(place) + len(new) > len(self.hash):
            place.clear()
            new = set(words)
            if len(new) > len(self.hash):  # one text of so many different words
                self.hash, self.opens, self.closes = np.zeros(len(new), U), np.zeros(len(new), bool), np.zeros(len(new), bool)
        for w in new:
            k = place[w] = len(place)
            self.hash[k], self.opens[k], self.closes[k] = xxhash.xxh3_64_intdigest(w.lower()), w[0].isupper(), w[-1] in ".!?"
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        return self.hash[at], self.opens[at], self.closes[at]

    def _powers(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """At least n powers of each base and of its inverse, modulo 2 ** 64."""
        if not self.powers or len(self.powers[0][0]) < n:
            factors = [(base, pow(base, -1, 1 << 64)) for base in BASES]
            self.powers = [tuple(np.multiply.accumulate(np.append(U(1), np.full(2 * n, x, U))) for x in pair) for pair in factors]
        return self.powers

    def units(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, high, low) of each unit, words counted over the whole text."""
        lines = [x.split() for x in text.split("\n")]
        sizes = np.array([len(x) for x in lines], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        if n < MIN_WORDS:
            none = np.empty(0, np.int64)
            return none, none, none, none
        hashes, opens, closes = self._read([w for x in lines for w in x])
        opens[(ends - sizes)[sizes > 0]] = True
        opens[1:] |= closes[:-1]
        phrase = np.flatnonzero(opens)
        stops = np.append(phrase[1:], n)
        last = np.searchsorted(stops, phrase + RUN_WORDS)
        runs = last < len(stops)
        long_ = sizes >= MIN_WORDS
        start = np.concatenate(((ends - sizes)[long_], phrase[runs]))
        stop = np.concatenate((ends[long_], stops[last[runs]]))
        size = (stop - start).astype(U)
        digests = []
        for seed, (power, inverse) in enumerate(self._powers(n + 1)):
            sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed(hashes + U(seed)) * power[:n])))
            digests.append(mixed((sums[stop] - sums[start]) * inverse[start] + size).view(np.int64))
        return start, stop, digests[0], digests[1]


def unit_digests(text: str) -> list[tuple[int, int, int, int]]:
    """(first word, word after the last, high, low) of each unit."""
    return [*zip(*(x.tolist() for x in Words().units(text)), strict=True)]


def keep_units(text: str, removed: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """The text without the words of the spans in `removed`, and the offsets of the rest, runs joined.

    A word goes with the blanks after it; a line of which nothing is left goes with its end.
    """
    if not removed:
        return text, [{"start": 0, "end": len(text)}]
    gone = np.zeros(max(b for _, b in removed) + 1, np.int64)
    for a, b in removed:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone) > 0
    kept: list[str] = []
    spans: list[dict] = []
    at = word = 0
    for line in text.split("\n"):
        begins = [m.start() for m in WORD.finditer(line)]
        out = gone[word : word + len(begins)]
        out = np.append(out, np.zeros(len(begins) - len(out), bool))
        word += len(begins)
        edges = [0, *begins[1:], len(line)] if begins else [0, len(line)]
        turns = np.flatnonzero(np.diff(out.astype(np.int8))) + 1 if begins else ()
        cuts = [0, *turns, max(1, len(begins))]
        pieces = [(edges[a], edges[b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if not len(out) or not out[a]]
        if pieces:
            kept.append("".join(line[a:b] for a, b in pieces))
        for a, b in pieces:
            if spans and spans[-1]["end"] >= at + a - 1:
                spans[-1]["end"] = at + b
            else:
                spans.append({"start": at + a, "end": at + b})
        at += len(line) + 1
    return "\n".join(kept), spans


def _units(cached: int):
    """Each unit's occurrence; `later` if this task has met an earlier one, which is left out if it is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state("repeats", Words)
        best: dict[bytes, tuple] = {}  # digest to rank of the earliest occurrence
        for b in row_batches(batches, 2 << 20):
            owner, later, rows = [], [], []
            for i, (key, th, text) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                start, stop, high, low = words.units(text or "")
                if not len(start):
                    continue
                if len(best) > cached:
                    best.clear()
                row, take = (key is None, 0 if key is None else key, th), []
                for k, (at, digest) in enumerate(zip(start.tolist(), np.stack((high, low), 1).view("V16").ravel().tolist(), strict=True)):
                    rank = (row, at)
                    known = best.get(digest)
                    if known is None or rank < known:
                        best[digest] = rank
                        later.append(False)
                    elif rank == known:
                        continue
                    else:
                        later.append(True)
                    take.append(k)
                owner.append(np.full(len(take), i, np.int32))
                rows.append(np.stack((start << 32 | stop, high, low))[:, take])
            cols = np.concatenate(rows, 1) if rows else np.empty((3, 0), np.int64)
            take = pa.array(np.concatenate(owner) if owner else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(later, pa.bool_()), *(pa.array(np.ascontiguousarray(c)) for c in cols)],
                ["doc_id", "th", "later", "span", "high", "low"],
            )

    return run


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans) of each document that loses words; `th` is the text's hash.

    A span's first word stands in the upper 32 bits, the word after its last in the lower ones.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    units = written(source.mapInArrow(_units(CACHED_UNITS), f"doc_id {ids}, th bigint, later boolean, span bigint, high bigint, low bigint"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", F.shiftright("span", 32).alias("start"))
    first = F.min(rank).over(Window.partitionBy("high", "low"))
    open_ = units.where("not later").withColumn("first", first).where(~rank.eqNullSafe(F.col("first")))
    gone = open_.select("doc_id", "th", "span").unionAll(units.where("later").select("doc_id", "th", "span"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, offsets: str = "kept") -> DataFrame:
    """All rows and columns of `docs`, `text` without its repeated units, and one more column `offsets` of what is kept.

    A column of `docs` that is called so gives way to it.
    """
    columns = [c for c in docs.columns if c != offsets]
    gone = removed_spans(docs).alias("r")
    left = docs.select(*(f"`{c}`" for c in columns)).withColumn("text", F.col("text").cast("string")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("r.th"))
    joined = left.join(gone, same, "left").select(*(F.col(f"d.`{c}`") for c in columns), F.col("r.spans").alias(offsets))
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("repeats-out")
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in row_batches(batches, 4 << 20):
            texts, lost = b.column(at).to_pylist(), b.column(len(columns)).to_pylist()
            out = [(None, []) if t is None else keep_units(t, [(x >> 32, x & 0xFFFFFFFF) for x in g or ()]) for t, g in zip(texts, lost, strict=True)]
            cols = [b.column(k) for k in range(len(columns))]
            cols[at] = pa.array([t for t, _ in out], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s for _, s in out], spans)], [*columns, offsets])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    return joined.mapInArrow(run, f"{fields}, `{offsets}` {SPANS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: what remains of each document, and where it stood."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("kept", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", spans.alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with repeated units removed and `n_chars` of what remains."""
    left = remove_repeats(docs, free_name(docs.columns, "offsets"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("bigint"))
    return left.select(*(f"`{c}`" for c in docs.columns))


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(line) - 1 AS ofs, regexp_extract_all(line, '^\\s*\\S+\\s*|\\S+\\s*') AS ts FROM l),
x AS (SELECT doc_id, place, ofs, unnest(ts) AS tok, unnest(range(len(ts))) AS k FROM o),
w AS (SELECT *, trim(tok, ' ' || chr(9) || chr(13)) AS raw, row_number() OVER d - 1 AS g, ofs + sum(length(tok)) OVER (PARTITION BY doc_id, place ORDER BY k) AS b FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY place, k)),
p AS (SELECT *, lower(raw) AS word, k = 0 OR regexp_matches(raw, '^\\p{{Lu}}') OR lag(right(raw, 1)) OVER (PARTITION BY doc_id ORDER BY g) IN ('.', '!', '?') AS opens FROM w),
v AS (SELECT doc_id, list(word ORDER BY g) AS words FROM p GROUP BY doc_id),
s AS (SELECT doc_id, g, g + {RUN_WORDS} AS need FROM p WHERE opens),
e AS (SELECT doc_id, g AS stop FROM s UNION ALL SELECT doc_id, len(words) FROM v),
r AS (SELECT s.doc_id, s.g AS start, e.stop FROM s ASOF JOIN e ON s.doc_id = e.doc_id AND s.need <= e.stop),
u AS (SELECT * FROM r UNION SELECT doc_id, min(g), max(g) + 1 FROM p GROUP BY doc_id, place HAVING count(*) >= {MIN_WORDS}),
t AS (SELECT u.*, array_to_string(words[start + 1 : stop], ' ') AS norm FROM u JOIN v USING (doc_id)),
q AS (SELECT doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, g FROM (SELECT doc_id, unnest(range(start, stop)) AS g FROM q) GROUP BY ALL),
f AS (SELECT p.doc_id, place, k, tok, b - length(tok) AS a, b FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.g = p.g WHERE c.g IS NULL
  UNION ALL SELECT doc_id, place, 0, line, ofs, ofs + length(line) FROM o WHERE len(ts) = 0),
h AS (SELECT doc_id, place, string_agg(tok, '' ORDER BY k) AS part FROM f GROUP BY doc_id, place),
j AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY place) AS text FROM h GROUP BY doc_id),
i AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY doc_id ORDER BY a, b) <= 1 THEN 0 ELSE 1 END AS cut FROM f),
m AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY a, b) AS run FROM i),
n AS (SELECT doc_id, run, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM m GROUP BY doc_id, run),
y AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS kept FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.text, '') AS text, coalesce(y.kept, '') AS kept FROM documents d LEFT JOIN j USING (doc_id) LEFT JOIN y USING (doc_id)"""
