"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores.

Labels are given per document, so training first labels tokens.  A word counts as toxic if it is far commoner among
toxic training documents than among clean ones, and so clearly that chance doesn't explain it among as many words as
there are: one test at every size, see `telling`.  Counts come from the training rows, about `TRAIN_DOCS` of either label
at most.  The field is then fitted on windows of words from a bounded sample of training documents (`SAMPLE_DOCS` of
either label, at most).  A chain is a line, whole, however long; forward-backward gives the probability that each of
its words is toxic.  A document's evidence is the logarithm of how unlikely it is that no word is toxic; its score is
a logistic function of that, fitted to the sampled documents at their true rate.  Words above one half are the
offending spans.

Scores depend on texts alone.  Null and empty texts score 0; very long ones are read whole.  If the training rows lack
either label, nothing is learnt and every score is 0.  Repeated rows get equal scores; a label table's repeated ids
count once, as toxic if any of them says so; null labels are ignored.  Empty tables give empty results; further
columns don't matter, and a pipeline stage gives them back.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ease, row_batches, table, worker_state, written

WORD = re.compile(r"\w+")
BLOCK = 64  # words that are scanned one after another; blocks side by side
TRAIN_DOCS = 150_000  # labelled rows of either label whose words are counted, about; more are sampled by hash
SAMPLE_DOCS = 3000  # of either label, whose windows fit the field
WINDOWS = 24_000  # aimed at; a document gives 4 to 40
ODDS, FALSE = 20.0, 10  # how much commoner a toxic word is, and how many words chance alone may let through
DIMENSIONS = 1 << 17
SIDES = {"<": 11, ">": 12}  # start values of the hashes of neighbours
REACH = 7  # words on either side in a training window
FOLDS = 5
CACHED_WORDS, COUNTED_WORDS = 1 << 18, 1 << 16


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept for testing."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _hashes(word: bytes) -> list[int]:
    """Hashes of a word, its end, its length and its beginnings, each kind from a start value of its own."""
    n = len(word)
    return [crc32(word, 1), crc32(word[-3:], 2), min(n, 12) * 7919, *[crc32(word[:k], k) for k in (3, 4, 5, 6) if n > k]]


def word_features(word: str) -> list[int]:
    """Places of a word's own features."""
    return [h % DIMENSIONS for h in _hashes(word.encode())]


def side_feature(side: str, word: str) -> int:
    return crc32(word.encode(), SIDES[side]) % DIMENSIONS


def marginals(score: np.ndarray, mask: np.ndarray, field: dict) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) for each place of a batch of chains, and the expected transitions (n, 2, 2).

    `score` (n, t) is how much more state 1 scores than state 0; `mask` tells places from padding at the end.
    """
    n, t = score.shape
    move = np.exp(field["move"])
    local = np.ones((n, t, 2))
    local[:, :, 1] = np.exp(np.clip(score, -30, 30))
    forward = np.empty((n, t, 2))
    a = local[:, 0] * np.exp(field["start"])
    forward[:, 0] = a / a.sum(1, keepdims=True)
    for k in range(1, t):
        a = (forward[:, k - 1] @ move) * local[:, k]
        a /= a.sum(1, keepdims=True)
        forward[:, k] = np.where(mask[:, k, None], a, forward[:, k - 1])
    back = np.full((n, 2), 0.5)
    p = np.empty((n, t))
    moves = np.zeros((n, 2, 2))
    for k in range(t - 1, -1, -1):
        both = forward[:, k] * back
        p[:, k] = both[:, 1] / both.sum(1)
        if k:
            ahead = local[:, k] * back
            pair = forward[:, k - 1, :, None] * move * ahead[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moves += np.where(mask[:, k, None, None], pair, 0)
            b = ahead @ move.T
            back = np.where(mask[:, k, None], b / b.sum(1, keepdims=True), back)
    return np.where(mask, p, 0.0), moves


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """y[k] = (a[k] * y[k - 1] + b[k]) / (c[k] * y[k - 1] + d[k]) with y[-1] = 1, all of them not negative.

    Blocks are scanned side by side: first what each makes of its first value, as one such fraction, then, from block
    to block, the first values themselves, then all values.
    """
    n = len(a)
    rows = -(-n // BLOCK)
    steps = []
    for x, pad in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        whole = np.full(rows * BLOCK, pad)
        whole[:n] = x
        steps.append(np.ascontiguousarray(whole.reshape(rows, BLOCK).T))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(BLOCK):
        a_, b_, c_, d_ = (x[k] for x in steps)
        p, q, r, s = a_ * p + b_ * r, a_ * q + b_ * s, c_ * p + d_ * r, c_ * q + d_ * s
        if k % 4 == 3:
            size = p + q + r + s
            p, q, r, s = p / size, q / size, r / size, s / size
    firsts, y = [], 1.0
    for p_, q_, r_, s_ in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True):
        firsts.append(y)
        y = (p_ * y + q_) / (r_ * y + s_)
    out = np.empty((BLOCK, rows))
    y = np.array(firsts)
    for k in range(BLOCK):
        a_, b_, c_, d_ = (x[k] for x in steps)
        out[k] = y = (a_ * y + b_) / (c_ * y + d_)
    return out.T.ravel()[:n]


def chances(score: np.ndarray, first: np.ndarray, field: dict) -> np.ndarray:
    """P(toxic) for each place of chains that follow one another; `first` marks where one begins.

    The same as `marginals`, by odds: with two states, each message of forward-backward is one number.
    """
    move, start = np.exp(field["move"]), np.exp(field["start"])
    local = np.exp(np.clip(score, -30, 30))
    go = np.where(first, 0.0, 1.0)
    ahead = scan(local * move[1, 1] * go, local * np.where(first, start[1] / start[0], move[0, 1]), move[1, 0] * go, np.where(first, 1.0, move[0, 0]))
    last = np.append(first[1:], True)[::-1]
    then = np.append(local[1:], 1.0)[::-1]
    go = np.where(last, 0.0, then)
    back = scan(move[1, 1] * go, np.where(last, 1.0, move[1, 0]), move[0, 1] * go, np.where(last, 1.0, move[0, 0]))[::-1]
    odds = ahead * back
    return odds / (1 + odds)


def fit(windows: list[tuple[list[str], list[int]]], epochs: int = 12, seed: int = 5) -> dict:
    """The field's weights from windows of words and their 0/1 labels, by adaptive gradient ascent."""
    field = {"w": np.zeros(DIMENSIONS), "move": np.zeros((2, 2)), "start": np.zeros(2), "bias": 0.0}
    if not windows:
        return field
    t = max(len(words) for words, _ in windows)
    own = {w: word_features(w) for words, _ in windows for w in words}
    width = max(map(len, own.values())) + 2
    spots = np.full((len(windows), t, width), DIMENSIONS, np.int64)
    mask, gold = np.zeros((len(windows), t), bool), np.zeros((len(windows), t))
    for i, (words, tags) in enumerate(windows):
        mask[i, : len(words)], gold[i, : len(words)] = True, tags
        for k, w in enumerate(words):
            f = [*own[w], *([side_feature("<", words[k - 1])] if k else []), *([side_feature(">", words[k + 1])] if k + 1 < len(words) else [])]
            spots[i, k, : len(f)] = f
    w, grown = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-3)
    small = np.zeros(7)
    small_grown = np.full(7, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            m, g, s = mask[pick], gold[pick], spots[pick]
            now = {"move": small[:4].reshape(2, 2), "start": small[4:6]}
            p, moves = marginals(w[s].sum(2) + small[6], m, now)
            miss = np.where(m, g - p, 0.0)
            grad = np.bincount(s.ravel(), np.repeat(miss.ravel(), s.shape[2]), DIMENSIONS + 1) - 2e-3 * w
            grad[DIMENSIONS] = 0
            grown += grad * grad
            w += 0.25 * grad / np.sqrt(grown)
            y = g.astype(int)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1][m[:, 1:]], y[:, 1:][m[:, 1:]]), 1)
            first = np.array([0.0, miss[:, 0].sum()])
            step = np.concatenate(((seen - moves.sum(0)).ravel(), first, [miss.sum()])) - 2e-3 * small
            small_grown += step * step
            small += 0.1 * step / np.sqrt(small_grown)
    return {"w": w[:DIMENSIONS], "move": small[:4].reshape(2, 2), "start": small[4:6], "bias": float(small[6])}


class Tagger:
    """Scores texts with a fitted field; keeps each seen word's three weights."""

    def __init__(self, field: dict | None):
        self.field = field
        self.place: dict[str, int] = {}
        self.weights = np.zeros((1024, 3))

    def _places(self, words: list[str]) -> np.ndarray:
        place = self.place
        new = set(words).difference(place)
        if len(place) + len(new) > CACHED_WORDS:
            place.clear()
            new = set(words)
        if new:
            w, bias = self.field["w"], self.field["bias"]
            while len(place) + len(new) > len(self.weights):
                self.weights = np.concatenate((self.weights, np.zeros_like(self.weights)))
            lower = [x.lower().encode() for x in new]
            own = [_hashes(x) for x in lower]
            starts = np.cumsum([0, *map(len, own[:-1])])
            rows = self.weights[len(place) : len(place) + len(new)]
            rows[:, 0] = np.add.reduceat(w[np.fromiter(chain.from_iterable(own), np.int64) % DIMENSIONS], starts) + bias
            for k, start in enumerate(SIDES.values(), 1):
                rows[:, k] = w[np.array([crc32(x, start) for x in lower], np.int64) % DIMENSIONS]
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of every word of each text, in order."""
        words: list[str] = []
        sizes, lengths = [], []
        for text in texts:
            n = 0
            for line in text.split("\n"):
                found = WORD.findall(line)
                words += found
                n += len(found)
                if found:
                    lengths.append(len(found))
            sizes.append(n)
        if not words or self.field is None:
            return [np.zeros(n) for n in sizes]
        at = self._places(words)
        rows = self.weights[at]
        first = np.zeros(len(words), bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        score = rows[:, 0].copy()
        score[1:] += np.where(first[1:], 0, rows[:-1, 1])
        score[:-1] += np.where(first[1:], 0, rows[1:, 2])
        return np.split(chances(score, first, self.field), np.cumsum(sizes)[:-1])


def evidence(p: np.ndarray) -> float:
    """The logarithm of minus the log-probability that no word is toxic."""
    return float(np.log(-np.log1p(-np.minimum(p, 1 - 1e-9)).sum() + 1e-9))


def document_score(p: np.ndarray, field: dict | None) -> float:
    """How likely a document with these words' probabilities is toxic; 0 without words."""
    if field is None or not len(p):
        return 0.0
    slope, middle = field["score"]
    return float(1 / (1 + np.exp(-np.clip(slope * (evidence(p) - middle), -500, 500))))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic function that fits 0/1 labels `y` to evidence `x`; the slope is positive."""
    a, b = 1.0, -float(np.average(x, weights=weight))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        r, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(r * x).sum() + 0.02 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 0.02, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max())
        a, b = max(0.05, a - step[0]), b - step[1]
    return a, -b / a


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Offsets, in characters, of the words that are rather toxic than not."""
    if not (p > 0.5).any():
        return []
    found = [m.span() for m in WORD.finditer(text)]
    return [{"start": a, "end": b, "p": float(x)} for (a, b), x in zip(found, p, strict=False) if x > 0.5]


def _count_words(only: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        counts: Counter[str] = Counter()
        for b in row_batches(batches):
            for text in b.column(0).to_pylist():
                found = set(WORD.findall((text or "").lower()))
                counts.update(found if only is None else found & only)
            if len(counts) > COUNTED_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array([*counts]), pa.array([*counts.values()], pa.int64())], ["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["word", "n"])

    return run


def _count(texts: DataFrame, only: set[str] | None) -> DataFrame:
    """In how many rows each word is found."""
    return texts.select("text").mapInArrow(_count_words(only), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _windows(lexicon: set[str], each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_batches(batches):
            out = []
            for text in b.column(0).to_pylist():
                lines = [WORD.findall(x) for x in (text or "").lower().split("\n")]
                places = [(k, i) for k, line in enumerate(lines) for i, w in enumerate(line) if w in lexicon]
                plain = [(k, i) for k, line in enumerate(lines) for i in range(0, len(line), 2 * REACH + 1)]
                share = [x[:: -(-len(x) // each)] for x in (places, plain) if x]
                for k, i in dict.fromkeys(y for x in share for y in x):
                    out.append(lines[k][max(0, i - REACH) : i + REACH + 1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["words"])

    return run


def telling(n: int, other: int, toxic: int, clean: int, words: int) -> bool:
    """Whether a word found in `n` of the `toxic` rows and in `other` of the `clean` ones counts as toxic.

    It must be ODDS times as common in toxic rows and next to absent from clean ones.  And so many of its rows being
    toxic must be unlikely by chance: by the Chernoff bound, FALSE of all `words` words at most would get here so.
    """
    if other > 0.02 * n or n / toxic <= ODDS * (other + 0.02 * n) / clean:
        return False
    share, base = n / (n + other), toxic / (toxic + clean)
    apart = share * math.log(share / base) + (0.0 if other == 0 else (1 - share) * math.log((1 - share) / (1 - base)))
    return (n + other) * apart > math.log(words / FALSE)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A field from the training rows of `docs` (those whose id isn't held out) and their labels.

    Collected to the driver are counts of the words that enough of the at most TRAIN_DOCS toxic training rows hold, the
    windows of 2 * SAMPLE_DOCS rows, and a number for each.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = F.lit(1 << 20)
    for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        share = F.when(F.col("toxic") == r["toxic"], F.lit(int((1 << 20) * min(1.0, TRAIN_DOCS / r["n"])))).otherwise(share)
    rank = F.xxhash64("doc_id")
    marked = marked.where(F.pmod(rank, F.lit(1 << 20)) < share)
    ids = docs.select("doc_id").join(F.broadcast(marked), "doc_id")
    have = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = have.get(1, 0), have.get(0, 0)
    if not toxic or not clean:
        return None
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id")
    counts = written(_count(rows.where("toxic = 1"), None), "toxic-words")
    distinct = max(1, counts.count())
    least = math.ceil(max(1.0, math.log(distinct / FALSE)) / math.log((toxic + clean) / toxic))  # for a word that no clean row holds
    bad = {r["word"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}
    discard(counts)
    good = {r["word"]: r["n"] for r in _count(rows.where("toxic = 0"), set(bad)).collect()}
    lexicon = {w for w, n in bad.items() if telling(n, good.get(w, 0), toxic, clean, distinct)}
    del bad, good
    ease(docs.sparkSession)
    picked = [r["doc_id"] for x in (1, 0) for r in ids.where(F.col("toxic") == x).distinct().orderBy(rank, "doc_id").limit(SAMPLE_DOCS).collect()]
    chosen = docs.sparkSession.createDataFrame([(x,) for x in picked], docs.select("doc_id").schema)
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "toxic")
    sizes = [min(toxic, SAMPLE_DOCS), min(clean, SAMPLE_DOCS)]
    each = min(40, max(4, WINDOWS // sum(sizes)))
    found = [r["words"] for r in sample.mapInArrow(_windows(lexicon, each), "words array<string>").collect()]
    field = fit([(words, [int(w in lexicon) for w in words]) for words in sorted(found) if words])
    del found
    ease(docs.sparkSession)  # fitting has left the most
    raw = sorted((r["toxic"], r["x"]) for r in _evidence(sample, field).collect())
    y, x = np.array([float(t) for t, _ in raw]), np.array([v for _, v in raw])
    weight = np.where(y > 0, toxic / max(1, y.sum()), clean / max(1, (1 - y).sum()))
    return field | {"score": calibrate(x, y, weight)}


def _evidence(sample: DataFrame, field: dict) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        tagger = Tagger(shared.value)
        for b in row_batches(batches, 1 << 20):
            x = [evidence(p) for p in tagger.tag([t or "" for t in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.float64())], ["toxic", "x"])

    return sample.mapInArrow(run, "toxic int, x double")


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        tagger = Tagger(shared.value)
        for b in row_batches(batches, 1 << 20):
            texts = [x or "" for x in b.column(1).to_pylist()]
            tags = tagger.tag(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([document_score(p, tagger.field) for p in tags], pa.float64()),
                    pa.array([spans(x, p) for x, p in zip(texts, tags, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))),
                ],
                ["doc_id", "score", "spans"],
            )

    return run


def score(docs: DataFrame, field: dict | None) -> DataFrame:
    """`doc_id`, `score` and `spans` (start, end, p) for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scorer(shared), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: each document's score, learnt from the training rows."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that don't score as toxic."""
    return _keep_rows(docs, train(docs, table(spark, sf_dir, "labels")))


def _keep_rows(docs: DataFrame, field: dict | None) -> DataFrame:
    """Whole rows whose text scores below one half, judged in place: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        tagger = Tagger(shared.value)
        for b in row_batches(batches, 1 << 20):
            tags = tagger.tag([x or "" for x in b.column(at).to_pylist()])
            yield b.filter(pa.array([document_score(p, tagger.field) < 0.5 for p in tags], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
