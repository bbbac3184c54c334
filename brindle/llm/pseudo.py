"""LM scoring by masked pseudo-likelihood, each document judged by what the other documents of the corpus say.

Tokens are words in lower case.  A network with a window of two tokens on either side predicts the token between them:
embeddings, a hidden layer, and a softmax in two steps, first over `CLASSES` classes (words of like endings), then over
the words of the class, both given the window.  The `OWN` most frequent words, cut by a threshold of their counts,
have an embedding and an output each; a class's other words share an embedding and one output, the rest, whose
probability they divide by their own counts in the corpus, smoothed by `LEAST` a word; unseen words of a class share
one such part.  The network's weights are fitted in numpy on every window of every document: the driver starts them on about `SAMPLE`
windows, then `_learn` takes each of the others once, in rounds that grow `GROWTH`-fold.  In a round each task goes
on from the same weights over its own rows, and the results are averaged by their numbers of windows.

What the corpus itself says grows with it and is kept in tables, not in the network: the count of every distinct
word, and, for every window (left, right), the counts of all words that stand in it (`MEMORY` 1; a larger one would
keep the windows whose hash it divides).  There the network's probability p of a word c becomes
(count(left, c, right) + p) / (count(left, ., right) + 1).  The rounds also write every
document's tokens as codes, which the passes below read instead of the texts (without rounds they read the texts).
Windows are counted and looked up in the same shuffle: packed tokens go to buckets by window,
and those of `HOT` windows, whose counts are known by then, by window and word.
Each of `PASSES` passes over the tokens does this for its share of all windows, so that disks hold one share at a time.
The weights depend, slightly, on how the table is dealt over tasks.
A document's own tokens are left out of all these counts, so that text which stands nowhere else scores as unseen and
text that repeats elsewhere scores high.

A document's score is the sum, over its tokens, of the log-probability of each given both sides; `n_recalled` of its
`n_windows` remembered windows hold the same word in another document.  Null and empty texts have no tokens and score
0 with null means.  Very long texts are read whole.  Repeated rows count and score each; further columns don't matter.
An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, row_batches, table, worker_state, written

KNOWN, OWN = 1 << 17, 1 << 11  # words whose counts are broadcast, and those with an output, at most
LEAST = 0.1
CLASSES = 48
SIDE, EMBEDDING, HIDDEN = 2, 16, 24
SAMPLE, BATCH, EPOCHS = 200_000, 1024, 3  # of the start
GROWTH, LARGE_BATCH, RATE, SLICES = 8, 4096, 0.004, 8  # of the rounds over all other windows
MEMORY = 1
HOT = 1000  # one in so many windows or pairs of window and word makes one hot
BUCKET, BUCKETS = 1 << 19, 1024  # tokens of a bucket, until there are so many
PASSES, TASK = 2, 8  # over the texts to settle all windows, each for its own share, as disk holds a share at a time; buckets of a task
HELD = 1 << 21  # rows that a task sums up
RARE = 0xFFFFFFFF  # the code of a word that is not in the vocabulary
ENDING = 3  # letters that give a rare word its class
CACHED_WORDS, CACHED_ENDS = 1 << 18, 1 << 16
STEPS_PER_DOUBLING = 8  # of the histogram of counts
U = np.uint64
MIX = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def read_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, which of them stands at each place of all texts in a row, and texts' numbers of words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(np.append(0, np.cumsum(there))[ends])
    coded = flat.filter(pa.array(there)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), sizes


def listed(words: pa.Array) -> list[str]:
    """As `to_pylist`, without an Arrow scalar for each word."""
    return words.to_numpy(zero_copy_only=False).tolist()


def words_of(text: str | None) -> list[str]:
    words, at, _ = read_words(pa.array([text], pa.string()))
    return listed(words.take(pa.array(at)))


def key_of(word: str) -> int:
    """A word's key, the same as Spark's xxhash64."""
    return xxhash.xxh64_intdigest(word.encode(), 42)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * MIX[1]
    x = (x ^ (x >> U(27))) * MIX[2]
    return x ^ (x >> U(31))


def window_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The window between two words' keys."""
    return mixed(left * MIX[0] + mixed(right))


class Tokens:
    """Words as numbers: keys, inputs of the network, classes, slots within a class and known counts."""

    def __init__(self, vocabulary: list[tuple[str, int]] = (), own: int = 0):
        """`vocabulary` lists (word, count), most frequent first; the first `own` have an output each."""
        ordered = sorted(range(own), key=lambda i: (vocabulary[i][0][::-1]))
        share = -(-own // CLASSES) if own else 1
        self.own, self.edge, self.rest = own, own + CLASSES, share  # `rest` is the slot of a class's other words
        self.bounds = [vocabulary[ordered[k]][0][: -ENDING - 1 : -1] for k in range(share, own, share)]
        self.ends: dict[str, int] = {}
        self.words = pa.array([w for w, _ in vocabulary], pa.string())
        kind = np.array([self.class_of(w) for w, _ in vocabulary], np.int64)
        slot = np.full(len(vocabulary), share, np.int64)
        number = own + kind
        place = np.arange(own)
        kind[ordered], slot[ordered], number[:own] = place // share, place % share, place
        key = np.array([key_of(w) for w, _ in vocabulary], U).view(np.int64)
        self.columns = np.stack((number, kind, slot, np.array([n for _, n in vocabulary], np.int64), key))

    def outputs(self) -> np.ndarray:
        """Which (class, slot) there are."""
        there = np.zeros((CLASSES, self.rest + 1), bool)
        there[: len(self.bounds) + 1, self.rest] = True
        there[self.columns[1, : self.own], self.columns[2, : self.own]] = True
        return there

    def class_of(self, word: str) -> int:
        """The class of a word without an output, by its last letters."""
        end = word[-ENDING:]
        if end not in self.ends:
            if len(self.ends) > CACHED_ENDS:
                self.ends.clear()
            self.ends[end] = bisect_right(self.bounds, end[::-1])
        return self.ends[end]

    def places(self, words: pa.Array) -> np.ndarray:
        """Words' places in the vocabulary, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def read(self, words: pa.Array | list[str], at: np.ndarray | None = None) -> np.ndarray:
        """A column for each word: its input, class, slot, known count (-1: unknown) and key; `at` are their places, if known."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        at = self.places(words) if at is None else at
        rare = listed(words.filter(pa.array(at < 0)))
        return self.columns_of(at, np.array([self.class_of(w) for w in rare], np.int64), np.array([key_of(w) for w in rare], U))

    def columns_of(self, at: np.ndarray, kind: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The same of places in the vocabulary, and of the classes and keys of the words that are not in it, in their order."""
        new = np.flatnonzero(at < 0)
        out = self.columns.take(at, 1, mode="wrap") if len(self.words) else np.empty((5, len(at)), np.int64)
        out[0, new], out[1, new], out[2, new], out[3, new], out[4, new] = self.own + kind, kind, self.rest, -1, key.view(np.int64)
        return out


def _sides(values: np.ndarray, sizes: np.ndarray, edge: int) -> list[np.ndarray]:
    """What stands SIDE to 1 places before and 1 to SIDE places after each token; `edge` beyond a text's ends."""
    place = np.arange(len(values)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(values) + SIDE * (len(sizes) + 1), edge, values.dtype)
    padded[place] = values
    return [padded[place + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))]


def _memory(key: np.ndarray, sizes: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's window, and the places of those that are remembered."""
    sides = _sides(key, sizes, 0)
    window = window_of(sides[SIDE - 1], sides[SIDE])
    return window, np.flatnonzero(window % U(memory) == 0)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by all keys, the first place of each run of equal ones in it, and the runs' lengths."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _gather(memory: int):
    """(word, n): counts of a task; (window, n): windows that a batch holds often."""

    def folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([sums[k].combine_chunks() for k in ("word", "n_sum")], ["word", "n"])

    def words_of(held: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held["word"], pa.nulls(len(held), pa.int64()), held["n"]], ["word", "window", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pseudo-gather")
        held, many = [], 0
        for b in row_batches(batches):
            words, at, sizes = read_words(b.column(0))
            times = np.bincount(at, minlength=len(words))
            held.append(pa.RecordBatch.from_arrays([words, pa.array(times)], ["word", "n"]))
            many += len(words)
            if many > 2 * CACHED_WORDS:
                held = [folded(held)]
                many = len(held[0])
                if many > CACHED_WORDS:
                    yield words_of(held[0])
                    held, many = [], 0
            # a window is as often only between words that are, or a text's ends
            fit = times * HOT >= len(at)
            key = np.zeros(len(words), U)
            key[fit] = np.array([key_of(w) for w in listed(words.filter(pa.array(fit)))], U)
            window, kept = _memory(key[at], sizes, memory)
            beside = _sides(fit[at], sizes, True)
            found, n = np.unique(window[kept[(beside[SIDE - 1] & beside[SIDE])[kept]]], return_counts=True)
            often = n * HOT >= len(at)
            columns = pa.nulls(often.sum(), pa.string()), pa.array(found[often].view(np.int64)), pa.array(n[often])
            yield pa.RecordBatch.from_arrays([*columns], ["word", "window", "n"])
        if held:
            yield words_of(folded(held))

    return run


def _tokens(shared) -> Tokens:
    """The broadcast vocabulary's, made once in a worker."""
    name, *vocabulary = shared.value
    return worker_state(("pseudo-tokens", name), lambda: Tokens(*vocabulary))


def _masses(shared):
    """The smoothed counts of each class's other words, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, mass = _tokens(shared), np.zeros(CLASSES)
        for b in batches:
            at = tokens.places(b.column(0))
            rest = (at < 0) | (at >= tokens.own)
            kinds = np.array([tokens.class_of(w) for w in listed(b.column(0).filter(pa.array(rest)))], np.int64)
            mass += np.bincount(kinds, b.column(1).to_numpy()[rest] + LEAST, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(mass)], ["class", "mass"])

    return run


def _rows_of(tokens: Tokens, columns: np.ndarray, sizes: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Every token's inputs on both sides, class and slot, from its columns; and which of them the start takes, one in `keep`."""
    number, kind, slot = columns[:3].astype("<i4")
    sides = _sides(number, sizes, tokens.edge)
    place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = mixed(place.astype(U) + mixed(columns[4].view(U))) % U(keep) == 0
    return np.stack([*sides, kind, slot], 1), start


def _windows(shared, keep: int):
    """Windows of tokens for the start; one in `keep` of a text, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared)
        for b in row_batches(batches):
            words, at, sizes = read_words(b.column(0))
            rows, start = _rows_of(tokens, tokens.read(words)[:, at], sizes, keep)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows[start]], pa.binary())], ["window"])

    return run


def _learn(shared, state, keep: int, number_of: int, memory: int):
    """Slices of a task's weights after all its windows, the counts of words in hot windows, and its documents' tokens.

    In round 0 the start has had one in `keep` windows of each text already.  Tokens are written as codes, with the keys
    and classes of words that are not in the vocabulary, so that nothing later reads the texts again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (flat, learner, step, hot) = _tokens(shared), state.value
        learner, seen, task = learner.placed(flat, step), 0, TaskContext.get().partitionId()
        rng, ids_type, first = np.random.default_rng(task), pa.null(), (number_of << 50) + (task << 33)

        def rows_of(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.list_(ids_type)]
            return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in zip(_LEARNT_NAMES, types, strict=True)], _LEARNT_NAMES)

        for b in row_batches(batches, 2 << 20):
            ids_type = b.column(1).type
            words, at, sizes = read_words(b.column(0))
            places = tokens.places(words)
            columns = tokens.read(words, places).take(at, 1)
            rows, start = _rows_of(tokens, columns, sizes, keep)
            key = columns[4].view(U)
            code = np.where(places < 0, RARE, places).astype(np.uint32)[at]
            rare = np.flatnonzero(code == RARE)
            data = _packed([sizes.astype(np.uint32), code, key[rare], columns[1, rare].astype(np.uint8)])
            numbers = {"n": len(at), "first": first, "rare": len(rare)}
            ids = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays([b.column(1)]))
            yield rows_of(1, **{k: pa.array([x]) for k, x in numbers.items()}, data=pa.array([data], pa.binary()), ids=ids)
            first += len(sizes)
            if len(hot):
                window, kept = _memory(key, sizes, memory)
                kept = kept[np.isin(window[kept], hot)]
                order, runs, n = _runs(key[kept], window[kept])
                one = kept[order[runs]]
                yield rows_of(len(n), n=pa.array(n), window=pa.array(window[one].view(np.int64)), key=pa.array(key[one].view(np.int64)))
            rows = rows if number_of else rows[~start]
            rows = rows.take(rng.permutation(len(rows)), 0)
            seen += len(rows)
            for part in np.array_split(rows, -(-len(rows) // LARGE_BATCH)) if len(rows) else ():
                learner.learn(part, RATE)
        if seen:
            cuts = [x.tobytes() for x in np.array_split(learner.flat(), SLICES)]
            yield rows_of(SLICES, slice=pa.array(range(SLICES), pa.int32()), task=pa.array([task] * SLICES, pa.int32()), n=pa.array([seen] * SLICES), data=pa.array(cuts, pa.binary()))

    return run


_LEARNT = "slice int, task int, n bigint, data binary, window bigint, key bigint, first bigint, rare bigint, ids array<{}>"
_LEARNT_NAMES = [x.split()[0] for x in _LEARNT.split(", ")]


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each slice over all tasks, weighted by their windows."""
    sums: dict[int, np.ndarray] = {}
    weights: Counter[int] = Counter()
    for b in batches:
        for r in b.to_pylist():
            part = np.frombuffer(r["data"], np.float32).astype(float) * r["n"]
            sums[r["slice"]] = sums[r["slice"]] + part if r["slice"] in sums else part
            weights[r["slice"]] += r["n"]
    data = [(x / weights[k]).tobytes() for k, x in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([*weights.values()], pa.int64()), pa.array(data, pa.binary())], ["slice", "n", "data"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _missed(z: np.ndarray, at: np.ndarray, again: Callable[[np.ndarray], np.ndarray]) -> None:
    """Puts each row's softmax less the one that was to be found, over the number of rows, in the place of `z`.

    All of `z` is at or below 0; `again` gives rows of it anew, for those that lie too far below.
    """
    one = z.dtype.type
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    far = np.flatnonzero(~(total > 1e-25))
    if len(far):
        z[far], total[far] = softmax(again(far)), 1
    np.divide(one(1 / len(z)), total, out=total)
    z *= total[:, None]
    z[np.arange(len(z)), at] -= one(1 / len(z))


def _product(a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """a.T @ b, over so many rows at a time, as they stay in the cache."""
    return sum((a[lo : lo + step].T @ b[lo : lo + step] for lo in range(step, len(a), step)), a[:step].T @ b[:step])


class Learner:
    """A network's weights on their way, by Adam; the weights and their two moments are views of one array."""

    def __init__(self, p: dict[str, np.ndarray], step: int = 0):
        self.numbers = np.zeros((3, sum(x.size for x in p.values())), np.float32)
        self.p, self.step = self._views(p, self.numbers[0]), step
        for k, x in p.items():
            self.p[k][...] = x

    @staticmethod
    def _views(like: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
        parts = np.split(flat, np.cumsum([x.size for x in like.values()])[:-1])
        return {k: part.reshape(x.shape) for (k, x), part in zip(like.items(), parts, strict=True)}

    def learn(self, rows: np.ndarray, rate: float) -> None:
        """A step along the gradient of a minibatch."""
        p, sides, one = self.p, 2 * SIDE, np.float32
        rows = rows.take(np.argsort(rows[:, sides].astype(np.int16), kind="stable"), 0)
        n, kinds = len(rows), rows[:, sides]
        inputs = np.ascontiguousarray(rows[:, :sides].T, np.intp)
        x = np.empty((n, sides, EMBEDDING), one)
        for k, at in enumerate(inputs):
            x[:, k] = p["e"].take(at, 0)
        x = x.reshape(n, -1)
        h = np.empty((n, HIDDEN + 1), one)  # with a last column of ones, for biases
        inner = x @ p["w"]
        inner += p["b"]
        np.tanh(inner, out=inner)
        h[:, :HIDDEN], h[:, HIDDEN] = inner, 1
        # biases keep all sums at or below 0, as no hidden value lies outside -1 to 1
        c = np.vstack([p["c"], p["c0"] - (np.abs(p["c"]).sum(0) + p["c0"]).max()])
        d = np.concatenate([p["d"], (p["d0"] - (np.abs(p["d"]).sum(2) + p["d0"]).max(1, keepdims=True))[..., None]], 2)
        miss = h @ c
        _missed(miss, kinds, lambda far: h[far] @ c)
        ends = np.searchsorted(kinds, np.arange(CLASSES + 1)).tolist()
        cuts = [(k, slice(*cut)) for k, cut in enumerate(pairwise(ends)) if cut[0] < cut[1]]
        within = np.empty((n, d.shape[1]), one)
        for k, cut in cuts:
            np.matmul(h[cut], d[k].T, out=within[cut])
        _missed(within, rows[:, sides + 1], lambda far: np.einsum("ij,ikj->ik", h[far], d[kinds[far]]))
        slope = np.zeros(self.numbers.shape[1], one)
        g = self._views(p, slope)
        part = _product(h, miss)
        g["c"][...], g["c0"][...] = part[:HIDDEN], part[HIDDEN]
        back = miss @ p["c"].T
        part = np.zeros_like(d)
        for k, cut in cuts:
            np.matmul(within[cut].T, h[cut], out=part[k])
            back[cut] += within[cut] @ p["d"][k]
        g["d"][...], g["d0"][...] = part[..., :HIDDEN], part[..., HIDDEN]
        inner *= inner
        np.subtract(1, inner, out=inner)
        back *= inner
        g["w"][...] = _product(back, x).T
        np.matmul(np.ones(n, one), back, out=g["b"])
        back, inputs = (p["w"] @ back.T).reshape(sides, EMBEDDING, n), inputs.ravel()
        for k in range(EMBEDDING):
            g["e"][:, k] = np.bincount(inputs, back[:, k].ravel(), len(p["e"]))
        self.step += 1
        weights, m, v = self.numbers
        more = slope - m
        more *= one(0.1)
        m += more
        slope *= slope
        slope -= v
        slope *= one(0.01)
        v += slope
        np.multiply(v, one(1 / (1 - 0.99**self.step)), out=more)
        np.sqrt(more, out=more)
        more += one(1e-8)
        np.divide(m, more, out=more)
        more *= one(rate / (1 - 0.9**self.step))
        weights -= more

    def flat(self) -> np.ndarray:
        return self.numbers.ravel()

    def placed(self, flat: np.ndarray, step: int) -> Learner:
        """The same kind of learner with other numbers."""
        out = Learner(self.p, step)
        out.numbers[...] = flat.reshape(3, -1)
        return out


def fit(windows: np.ndarray, inputs: int, outputs: np.ndarray, seed: int = 3) -> Learner:
    """The network's weights from rows of (inputs on both sides, class, slot), by Adam on seeded minibatches.

    `outputs` tells which (class, slot) there are; others never get any probability.
    """
    rng = np.random.default_rng(seed)
    one = np.float32
    sides = 2 * SIDE
    kinds = np.bincount(windows[:, sides], minlength=CLASSES) + 1.0
    within = np.full(outputs.shape, 0.1)
    np.add.at(within, (windows[:, sides], windows[:, sides + 1]), 1)
    never = -1e9
    p = {
        "e": rng.normal(0, 0.1, (inputs, EMBEDDING)),
        "w": rng.normal(0, 0.2, (sides * EMBEDDING, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "c": rng.normal(0, 0.1, (HIDDEN, CLASSES)),
        "c0": np.where(outputs.any(1), np.log(kinds / kinds.sum()), never),
        "d": rng.normal(0, 0.05, (*outputs.shape, HIDDEN)),
        "d0": np.where(outputs, np.log(within / within.sum(1, keepdims=True)), never),
    }
    p = {k: x.astype(one) for k, x in p.items()}
    learner = Learner(p)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            learner.learn(windows[order[lo : lo + BATCH]], 0.01 * min(1.0, 2 - 1.9 * (learner.step + 1) * BATCH / max(1, EPOCHS * len(order))))
    return learner


class Network:
    """log P(class, slot | window) for many tokens at a time."""

    def __init__(self, p: dict[str, np.ndarray]):
        w = p["w"].reshape(2 * SIDE, EMBEDDING, HIDDEN)
        self.side = [p["e"] @ x for x in w]  # what an input adds to the hidden layer from each place
        self.side[0] = self.side[0] + p["b"]
        self.kinds = _bounded(p["c"].T, p["c0"])
        self.slots = [_bounded(d, d0) for d, d0 in zip(p["d"], p["d0"], strict=True)]

    def logs(self, sides: list[np.ndarray], kinds: np.ndarray, slots: np.ndarray, step: int = 1 << 13) -> np.ndarray:
        out = np.empty(len(kinds))
        order = np.argsort(kinds.astype(np.int16), kind="stable")
        for lo in range(0, len(kinds), step):
            at = order[lo : lo + step]
            h = self.side[0].take(sides[0][at], 0)
            for t, x in zip(self.side[1:], sides[1:], strict=True):
                h += t.take(x[at], 0)
            np.tanh(h, out=h)
            kind, slot = kinds[at], slots[at]
            part = _picked(h, *self.kinds, kind)
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]):
                part[a:b] += _picked(h[a:b], *self.slots[kind[a]], slot[a:b])
            out[at] = part
        return out


def _bounded(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights and a bias that keeps all sums at or below 0, as no hidden value lies outside -1 to 1."""
    return np.ascontiguousarray(weights.T), bias - (np.abs(weights).sum(1) + bias).max()


def _picked(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place."""
    z = h @ weights
    z += bias
    won = z[np.arange(len(z)), at].copy()
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if not (total > 1e-25).all():  # the bound is too far above these rows
        z = (h @ weights + bias).astype(np.float64)
        top = z.max(1)
        return won - top - np.log(np.exp(z - top[:, None]).sum(1))
    return won - np.log(total)


def _written(df: DataFrame, name: str) -> DataFrame:
    """As `written`; what the way there shuffled goes from the disks then."""
    spark = df.sparkSession
    out = written(df, name)
    del df
    gc.collect()  # frames that Python holds keep their shuffles
    spark._jvm.System.gc()
    return out


def _frequent(words: DataFrame, most: int) -> int:
    """The least count that at most `most` words have; found by a histogram of counts."""
    level = F.floor(F.log2("n") * STEPS_PER_DOUBLING).cast("int")
    left, least = most, None
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low")).collect(), reverse=True):
        left -= r["m"]
        if left < 0:
            break
        least = r["low"]
    return least if least is not None else 1 << 62


def train(docs: DataFrame) -> dict:
    """The network, counts of all words, masses of classes and counts of hot windows, from all rows."""
    spark = docs.sparkSession
    ids = docs.schema["doc_id"].dataType.simpleString() if "doc_id" in docs.columns else "int"
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("int").alias("doc_id"))
    found = written(texts.select("text").mapInArrow(_gather(MEMORY), "word string, window bigint, n bigint"), "found")
    words = _written(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    often = found.where("word is null").groupBy("window").agg(F.sum("n").alias("n")).where(F.col("n") * HOT >= total).collect()
    hot = np.sort(np.array([r["window"] for r in often], np.int64).view(U))
    discard(found)
    known = words.where(F.col("n") >= _frequent(words, KNOWN)).collect()
    vocabulary = sorted(((r["word"], r["n"]) for r in known), key=lambda x: (-x[1], x[0]))
    most = _frequent(words, OWN)
    own = sum(n >= most for _, n in vocabulary)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, own))
    mass = np.full(CLASSES, LEAST)
    for r in words.select("word", "n").mapInArrow(_masses(shared), "class int, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect():
        mass[r["class"]] += r["mass"]
    keep = 8 if total > 8 * SAMPLE else 1  # from more documents, some of each one's windows
    top = 1 << 30
    end = int(min(1.0, SAMPLE * keep / max(1, total)) * top)
    place = F.pmod(F.xxhash64("text"), F.lit(top))
    rows = sorted(bytes(r["window"]) for r in texts.where(place < F.lit(end)).select("text").mapInArrow(_windows(shared, keep), "window binary").collect())
    tokens = Tokens(vocabulary, own)
    learner = fit(np.frombuffer(b"".join(rows), "<i4").reshape(-1, 2 * SIDE + 2), tokens.edge + 1, tokens.outputs())
    ends = [0, end]
    while ends[-1] < top:
        ends.append(min(top, max(ends[-1], 1) * GROWTH))
    pairs, codes, fitted = [], [], len(rows)
    if total > SAMPLE:  # else the start has had all
        for number_of, (low, high) in enumerate(pairwise(ends)):
            state = spark.sparkContext.broadcast((learner.flat(), learner.placed(np.zeros(learner.flat().size), 0), learner.step, hot))
            learnt = written(texts.where(place.between(low, high - 1)).mapInArrow(_learn(shared, state, keep, number_of, MEMORY), _LEARNT.format(ids)), "learnt")
            pairs.append(learnt.where("window is not null").select("window", "key", "n"))
            codes.append(learnt.where("ids is not null").select("first", "n", "rare", "ids", "data"))
            parts = learnt.where("slice is not null").repartition(SLICES, "slice").sortWithinPartitions("slice", "task").mapInArrow(_averaged, "slice int, n bigint, data binary").collect()
            if parts:
                fitted += parts[0]["n"]
                learner = learner.placed(np.concatenate([np.frombuffer(r["data"], float) for r in sorted(parts)]), max(learner.step, 1000))
            state.unpersist()
    model = {"vocabulary": vocabulary, "own": own, "mass": mass, "memory": MEMORY, "network": learner.p, "words": words, "docs": docs, "codes": reduce(DataFrame.unionAll, codes) if codes else None, "total": total, "fitted": fitted}
    return model | {"hot": _hot(pairs, hot, total)}


def _hot(pairs: list[DataFrame], hot: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """The hot windows, their counts, the hot ones of their pairs with words (by hash) and the counts of these."""
    n, m = [], []
    if pairs and len(hot):
        table_ = written(reduce(DataFrame.unionAll, pairs).groupBy("window", "key").agg(F.sum("n").alias("n")), "hot")
        n = sorted((r["window"] % (1 << 64), r["n"]) for r in table_.groupBy("window").agg(F.sum("n").alias("n")).collect())
        often = [(r["window"] % (1 << 64), r["key"] % (1 << 64), r["n"]) for r in table_.where(F.col("n") * HOT >= total).collect()]
        w, k = (np.array([x[i] for x in often], U) for i in range(2))
        m = sorted(zip(window_of(w, k).tolist(), (x[2] for x in often), strict=True))
        discard(table_)
    return tuple(np.array([x[i] for x in part], kind) for part in (n, m) for i, kind in ((0, U), (1, np.int64)))


_LOOKED_UP = "kind tinyint, row bigint, n bigint, part double, key bigint, own bigint, around bigint, windows bigint"
_LOOKED_UP_NAMES = [x.split()[0] for x in _LOOKED_UP.split(", ")]
BASE, ASKED, COUNTED, PLACED = range(4)  # kinds of packs: documents' sums, rare words, windows, hot windows' other words
_PACKED = {  # the columns of each kind
    BASE: (("row", "<u8"), ("n", "<i8"), ("part", "<f8"), ("windows", "<i8"), ("again", "<i8")),
    ASKED: (("row", "<u8"), ("key", "<u8"), ("n", "<i8"), ("own", "<i8")),
    COUNTED: (("group", "<u8"), ("doc", "<u4"), ("code", "<u4"), ("part", "<f4")),
    PLACED: (("group", "<u8"), ("doc", "<u4"), ("code", "<u4"), ("part", "<f4"), ("around", "<i8")),
}
_RARE = (("key", "<u8"), ("own", "<u4"))  # of windows' rare words
_ZSTD = pa.Codec("zstd", 1)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns as bytes, those of a place in the numbers together, as they are much the same."""
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns)
    return _ZSTD.compress(planes, asbytes=True)


def _unpacked(data: bytes, columns: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
    """The columns again, by their names, types and lengths."""
    sizes = [np.dtype(t).itemsize * k for _, t, k in columns]
    planes, at, out = np.frombuffer(_ZSTD.decompress(data, sum(sizes), asbytes=True), np.uint8), 0, {}
    for (name, type_, k), size in zip(columns, sizes, strict=True):
        out[name] = np.ascontiguousarray(planes[at : at + size].reshape(np.dtype(type_).itemsize, k).T).reshape(-1).view(type_)
        at += size
    return out


def _totals(*keys: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """How many rows share each row's keys; with `weights`, of those that count."""
    order, first, n = _runs(*keys)
    if weights is not None and len(order):
        n = np.add.reduceat(weights[order].astype(np.int64), first)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(n, np.diff(np.append(first, len(order))))
    return out


def _nested_totals(keys: tuple[np.ndarray, ...], weights: list[np.ndarray]) -> list[np.ndarray]:
    """As `_totals` by the last key, by the last two and so on, one for each of `weights`, from one order by all keys."""
    order, out = np.lexsort(keys), []
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k, w in zip(reversed(keys), weights, strict=True):
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        n = np.add.reduceat(w[order].astype(np.int64), first) if len(order) else first
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(n, np.diff(np.append(first, len(order))))
        out.append(total)
    return out


_PACKS = "bucket int, kind tinyint, counts boolean, first bigint, n bigint, rare bigint, data binary"
_PACK_NAMES = [x.split()[0] for x in _PACKS.split(", ")]


def _read_texts(tokens: Tokens, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows' numbers and sizes, and tokens' codes and columns, of slices of texts."""
    for b in row_batches(batches, 2 << 20):
        words, at, sizes = read_words(b.column(1))
        places = tokens.places(words)
        yield b.column(0).to_numpy(), sizes, np.where(places < 0, RARE, places).astype(np.uint32)[at], tokens.read(words, places).take(at, 1)


def _read_codes(tokens: Tokens, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same of what `_learn` wrote."""
    for b in batches:
        for r in b.to_pylist():
            x = _unpacked(r["data"], [("size", "<u4", r["docs"]), ("code", "<u4", r["n"]), ("key", "<u8", r["rare"]), ("class", "u1", r["rare"])])
            at = np.where(x["code"] == RARE, -1, x["code"].astype(np.int64))
            yield r["first"] + np.arange(r["docs"]), x["size"].astype(np.int64), x["code"], tokens.columns_of(at, x["class"].astype(np.int64), x["key"])
    give_back()


def _score(read: Callable, shared, memory: int, leave_out: bool, buckets: int, asks: bool, counts: bool, passes: int, which: int):
    """Packs of a task's documents, rare words and windows, which ask for counts, count themselves, or both.

    Only tokens whose windows belong to this pass take part, but all count as their document's own.
    """

    name = uuid.uuid4().hex

    def make() -> tuple:
        model = shared.value
        return Tokens(model["vocabulary"], model["own"]), Network(model["network"]), model["mass"], model["hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, network, mass, (hot, hot_n, often, often_n) = worker_state(("pseudo", name), make)
        for number_of, (ids, sizes, code, (number, kind, slot, known, key)) in enumerate(read(tokens, batches)):
            doc = np.repeat(np.arange(len(sizes)), sizes)
            key = key.view(U)
            window, kept = _memory(key, sizes, memory)
            mine = window % U(passes) == which
            kept = kept[mine[kept]]
            group, part, own = window[kept], np.zeros(len(code)), np.zeros(len(code), np.int64)
            place = _found(hot, group)
            in_hot = np.flatnonzero(place >= 0)
            pair = window_of(group[in_hot], key[kept[in_hot]])
            packs = []
            if asks:
                its = np.flatnonzero(mine)
                part[its] = network.logs([x[its] for x in _sides(number.astype(np.int32), sizes, tokens.edge)], kind[its], slot[its])
                rest = np.flatnonzero(slot == tokens.rest)
                own[rest] = _totals(doc[rest], key[rest])
                less = _totals(doc[rest], kind[rest]) if leave_out else np.zeros(len(rest), np.int64)
                less, rest = less[mine[rest]], rest[mine[rest]]
                part[rest] -= np.log(np.maximum(mass[kind[rest]] - less, LEAST))
                here = rest[known[rest] >= 0]
                part[here] += np.log(np.maximum(known[here] - (own[here] if leave_out else 0), 0) + LEAST)
                rare = np.flatnonzero((known < 0) & mine)
                order, first, times = _runs(key[rare], doc[rare])
                one = rare[order[first]]
                packs.append((ASKED, [ids[doc[one]].view(U), key[one], times, own[one]]))
                # hot pairs' counts are known here
                around, n_pair = hot_n[place[in_hot]], _found(often, pair)
                if leave_out:
                    around = around - _totals(doc[kept[in_hot]], group[in_hot])
                easy = (n_pair >= 0) & (known[kept[in_hot]] >= 0)
                it = kept[in_hot[easy]]
                again = often_n[n_pair[easy]] - (_totals(doc[it], pair[easy]) if leave_out else 0)
                base = np.bincount(doc, part, len(sizes)) + np.bincount(doc[it], _more(again, around[easy], part[it]), len(sizes))
                recalled = np.bincount(doc[it], again > 0, len(sizes)).astype(np.int64)
                packs.append((BASE, [ids.view(U), sizes.astype(np.int64) * (which == 0), base, np.bincount(doc[kept], minlength=len(sizes)), recalled]))
                hard = in_hot[~easy]
                packs.append((PLACED, _sorted(pair[~easy], kept[hard], doc, code, part, around[~easy])))
            elif counts:
                packs.append((PLACED, _sorted(pair, kept[in_hot], doc, code, part, np.zeros(len(pair), np.int64))))
            cold = np.flatnonzero(place < 0)
            packs.append((COUNTED, _sorted(group[cold], kept[cold], doc, code, part)))
            rows: list[tuple] = []
            for k, columns in packs:
                if k in (BASE, ASKED):
                    rows.append((number_of % buckets, k, False, 0, len(columns[0]), 0, _packed([*columns, *(np.empty(0, t) for _, t in _RARE)])))
                    continue
                at_, columns = columns[0], columns[1:]
                group_, ends = columns[0], _edges(columns[0], buckets)
                is_rare = code[at_] == RARE
                rare_ends = np.append(0, np.cumsum(is_rare))[ends]
                rare_columns = key[at_[is_rare]], own[at_[is_rare]].astype(np.uint32)
                steps = np.diff(group_, prepend=U(0))
                for i in np.flatnonzero(np.diff(ends)).tolist():
                    cut, rare_cut = slice(ends[i], ends[i + 1]), slice(rare_ends[i], rare_ends[i + 1])
                    steps[ends[i]] = group_[ends[i]]
                    data = _packed([steps[cut], *(x[cut] for x in columns[1:]), *(x[rare_cut] for x in rare_columns)])
                    rows.append((i, k, counts, int(ids[0]), cut.stop - cut.start, int(rare_cut.stop - rare_cut.start), data))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int8(), pa.bool_(), *[pa.int64()] * 3, pa.binary()), strict=True)], _PACK_NAMES)

    return run


def _found(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each value's place among ordered ones, -1 for others."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def _more(again: np.ndarray, around: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What the counts of a token's window add to its log-probability."""
    again, around = np.maximum(again, 0), np.maximum(around, 0)
    return np.where(again > 0, np.log(again + np.exp(np.maximum(part, -600.0))) - part, 0.0) - np.log(around + 1.0)


def _sorted(group: np.ndarray, at: np.ndarray, doc: np.ndarray, code: np.ndarray, part: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Places in order of their groups, and the columns of a pack in that order."""
    order = np.argsort(group)
    at = at[order]
    return [at, group[order], doc[at].astype(np.uint32), code[at], part[at].astype(np.float32), *(x[order] for x in more)]


def _edges(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of ordered groups begins, and the end."""
    inner = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(ordered, np.array(inner, U)), [len(ordered)]]).astype(np.int64)


def _settled(leave_out: bool):
    """Rows of documents' sums, rare words whose counts are missing yet, and what the windows' counts add."""

    def rows_of(kind: int, row: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        columns |= {"kind": np.full(len(row), kind, np.int8), "row": row.view(np.int64)}
        types = [pa.int8(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(len(row), t) for k, t in zip(_LOOKED_UP_NAMES, types, strict=True)], _LOOKED_UP_NAMES)

    def settle(kind: int, packs: list[dict], sums: list[tuple]) -> Iterator[pa.RecordBatch]:
        """What all tokens of a bucket add."""
        x = {k: np.concatenate([p[k] for p in packs]) for k in packs[0]}
        group, row, own, key, asks = x["group"], x["row"], x["own"], x["word"], x["asks"]
        keys, weights = ((row, key, group), [x["counts"], x["counts"], asks]) if leave_out else ((key, group), [x["counts"]] * 2)
        around, again, *its = _nested_totals(keys, weights)
        around = x["around"] if kind == PLACED else around
        if leave_out:  # rows that don't ask are numbered by themselves
            again = again - its[0]
            around = around if kind == PLACED else around - _totals(row, group, weights=asks)
        new = np.flatnonzero(asks & (around > 0))
        again, around, part, row, rare = again[new], around[new], x["part"][new].astype(float), row[new], x["rare"][new]
        later = rare & (again > 0)
        yield rows_of(3, row[later], key=key[new][later].view(np.int64), own=own[new][later], n=again[later], around=around[later], part=part[later])
        sums.append((row[~later], _more(again, around, part)[~later], (again > 0)[~later].astype(np.int64)))
        if sum(len(x[0]) for x in sums) > HELD:
            sums[:] = [summed(sums)]
            if len(sums[0][0]) > HELD // 2:
                row, more, held = sums.pop()
                yield rows_of(2, row, part=more, n=held)

    def summed(sums: list[tuple]) -> tuple:
        row, more, held = (np.concatenate(x) for x in zip(*sums, strict=True))
        docs, at = np.unique(row, return_inverse=True)
        return docs, np.bincount(at, more, len(docs)), np.bincount(at, held, len(docs)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pseudo-settle")
        last, packs, sums = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] >= COUNTED and (r["bucket"], r["kind"]) != last:
                    if packs:
                        yield from settle(last[1], packs, sums)
                    last, packs = (r["bucket"], r["kind"]), []
                x = _unpacked(r["data"], [*((k, t, r["n"]) for k, t in _PACKED[r["kind"]]), *((f"rare_{k}", t, r["rare"]) for k, t in _RARE)])
                if r["kind"] == BASE:
                    yield rows_of(0, x["row"], n=x["n"], part=x["part"], windows=x["windows"], own=x["again"])
                elif r["kind"] == ASKED:
                    yield rows_of(1, x["row"], key=x["key"].view(np.int64), n=x["n"], own=x["own"])
                else:
                    rare = x["code"] == RARE
                    word, own = x["code"].astype(U), np.zeros(r["n"], np.int64)
                    word[rare], own[rare] = x["rare_key"], x["rare_own"]
                    n = r["n"]
                    pack = {"group": np.cumsum(x["group"], dtype=U), "row": x["doc"].astype(U) + U(r["first"]), "word": word, "own": own, "rare": rare, "part": x["part"]}
                    if r["kind"] == PLACED:
                        pack["around"] = x["around"]
                    packs.append(pack | {"asks": np.full(n, r["asks"]), "counts": np.full(n, r["counts"])})
        if packs:
            yield from settle(last[1], packs, sums)
        if sums:
            row, more, held = summed(sums)
            yield rows_of(2, row, part=more, n=held)
        give_back()

    return run


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["row", "doc_id"])


def score(docs: DataFrame, model: dict, leave_out: bool = True) -> DataFrame:
    """`doc_id`, `n_tokens`, `score`, `mean`, `n_windows` and `n_recalled` for every row of `docs`.

    With `leave_out` the rows of `docs` are rows of the model's corpus, and their own tokens don't count.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("vocabulary", "own", "mass", "network", "hot")})
    row, text = F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")
    total, codes = model["total"], model["codes"]
    corpus, whole = model["docs"] if codes is None else codes, docs is model["docs"] and leave_out
    buckets = max(1, min(-(-total // BUCKET), max(BUCKETS, -(-total // (8 * BUCKET)))))

    def packs(of: DataFrame, asks: bool, counts: bool, which: int) -> DataFrame:
        from_codes = of is codes
        run = _score(_read_codes if from_codes else _read_texts, shared, model["memory"], leave_out, buckets, asks, counts, PASSES, which)
        rows = of.select("first", "n", "rare", F.size("ids").alias("docs"), "data") if from_codes else of.select(row, text, *["doc_id"] * asks)
        return rows.mapInArrow(run, _PACKS).withColumn("asks", F.lit(asks))

    def settled(which: int) -> DataFrame:
        # in the corpus itself each token asks and counts
        dealt = packs(corpus, True, True, which) if whole else packs(docs, True, False, which).unionAll(packs(corpus, False, True, which))
        dealt = dealt.repartition(-(-buckets // TASK), "bucket").sortWithinPartitions("kind", "bucket", "first")
        return _written(dealt.mapInArrow(_settled(leave_out), _LOOKED_UP), "looked-up")

    looked = reduce(DataFrame.unionAll, map(settled, range(PASSES)))
    words = model["words"].select(F.xxhash64("word").alias("key"), F.col("n").alias("word_n")).groupBy("key").agg(F.sum("word_n").alias("word_n"))

    # rare words: their counts come by a join
    count = F.coalesce("word_n", F.lit(0))
    share = F.log((F.greatest(count - F.col("own"), F.lit(0)) if leave_out else count) + F.lit(LEAST))
    rare = looked.where("kind = 1 or kind = 3").join(words, "key", "left").withColumn("share", share)
    p = F.col("part") + F.col("share")
    seen = F.log((F.col("n") + F.exp(F.greatest(p, F.lit(-600.0)))) / (F.col("around") + F.lit(1.0))) - p
    rare = rare.select("row", F.when(F.col("kind") == 1, F.col("n") * F.col("share")).otherwise(seen).alias("part"), (F.col("kind") == 3).cast("bigint").alias("recalled"))
    sums = rare.unionAll(looked.where("kind = 2").select("row", "part", "n")).groupBy("row").agg(F.sum("part").alias("more"), F.sum("recalled").alias("recalled"))
    base = looked.where("kind = 0").groupBy("row").agg(F.sum("n").alias("n_tokens"), F.sum("part").alias("part"), F.sum("windows").alias("n_windows"), F.sum("own").alias("held"))
    # texts are read too, as the passes do: a plan of fewer columns could deal, and so number, the rows in another way
    if whole and codes is not None:
        ids = codes.select("first", F.posexplode("ids").alias("place", "doc_id")).select((F.col("first") + F.col("place")).alias("row"), "doc_id")
    else:
        ids = docs.select(row, text, "doc_id").mapInArrow(_ids, f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    out = ids.join(base, "row").join(sums, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"), "n_windows", (F.col("held") + F.coalesce("recalled", F.lit(0).cast("bigint"))).alias("n_recalled"))
    return out.withColumn("mean", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: every document's pseudo-log-likelihood under the corpus's own model."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))
