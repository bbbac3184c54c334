"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised (lower case, words joined by single spaces) and taken as UTF-8 bytes.
An item's regions are the whole item and overlapping windows of the sizes and strides in `WINDOWS`; the shortest
ones begin so closely that any verbatim part of 51 bytes (size plus stride less one) holds a whole one.  A region of m bytes that occurs
in a text with at most k = EDITS * m edits shares at least m + 1 - q - q * k of its q-grams with it, all on at
most k + 1 neighbouring diagonals.  So shared q-grams are counted in overlapping bands of diagonals, bands that
reach the bound are kept, and a banded alignment verifies each.  Nothing is shuffled: the index of the items is
broadcast in blocks of `BLOCK_BYTES` of their text, each with its own pass over the documents.

Null or empty texts and items match nothing.  Items too short for the bound (under `LEAST` bytes) are found at every
place where they stand exactly, between characters that are neither letters nor digits.  A document counts as clean,
though, if all it holds are short items of fewer than `PASSAGE_WORDS` words, as those are words and no passages.
Repeated rows give repeated results; items with the same text are all reported.  Very long texts are read whole; an
empty table of documents gives an empty result; further columns don't matter, and a pipeline stage gives them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, table, worker_state

Q = 8
EDITS = 0.1
WINDOWS = ((96, 48), (48, 4))  # (size, stride), longest first
LEAST = 40
PASSAGE_WORDS = 3
BORDER = frozenset(range(128)).difference(b"0123456789abcdefghijklmnopqrstuvwxyz")
BLOCK_BYTES = 2 << 20
BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each place as one 64-bit number."""
    n = max(0, len(data) - Q + 1)
    return np.ndarray((n,), "<u8", data, 0, (1,)).copy() if n else np.empty(0, "<u8")


class Index:
    """The q-grams of a block of items, and the regions that they lie in."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, d) for i, d in items if d]
        short: dict[str, list[int]] = {}
        for n, (_, d) in enumerate(self.items):
            if len(d) < LEAST:
                short.setdefault(d.decode("latin-1"), []).append(n)
        self.short = ahocorasick.Automaton()
        for text, numbers in short.items():
            self.short.add_word(text, (len(text), numbers))
        if short:
            self.short.make_automaton()
        codes, item, place, region = [], [], [], []
        for n, (_, d) in enumerate(self.items):
            m = len(d)
            if m < LEAST:
                continue
            region.append((n, 0, m))
            for size, stride in WINDOWS:
                if m > size:
                    region += [(n, s, s + size) for s in sorted({*range(0, m - size, stride), m - size})]
            g = grams(d)
            codes.append(g)
            item.append(np.full(len(g), n))
            place.append(np.arange(len(g)))
        if not codes:
            codes, item, place = [np.empty(0, "<u8")], [np.empty(0, int)], [np.empty(0, int)]
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.code, first = np.unique(code[order], return_index=True)
        self.bounds = np.append(first, len(code))
        self.item, self.place = np.concatenate(item)[order], np.concatenate(place)[order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.slot(self.code)] = True
        self.region = np.array(region, np.int64).reshape(-1, 3)
        m = self.region[:, 2] - self.region[:, 1]
        self.k = np.floor(EDITS * m).astype(np.int64)
        self.need = m + 1 - Q - Q * self.k
        self.reach = max((len(d) for _, d in self.items), default=0)
        self.of_item = np.searchsorted(self.region[:, 0], np.arange(len(self.items) + 1))

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return (code * MIX) >> np.uint64(64 - BITS)

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the data, item, place in the item) of every shared q-gram."""
        g = grams(data)
        at = np.flatnonzero(self.bitmap[self.slot(g)])
        none = np.empty(0, np.int64)
        if not len(at) or not len(self.code):
            return none, none, none
        where = np.minimum(np.searchsorted(self.code, g[at]), len(self.code) - 1)
        same = self.code[where] == g[at]
        at, where = at[same], where[same]
        size = self.bounds[where + 1] - self.bounds[where]
        rows = np.repeat(self.bounds[where] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(at, size), self.item[rows], self.place[rows]

    def dense_hits(self, texts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text that has any, the hits (place, item, place in the item) in bands that could reach a bound.

        The texts are looked at in one piece, with a byte between them that no item holds.  The bands here
        are wide, overlap by half and so hold any region's band; most chance hits end here.
        """
        if not len(self.region):
            return {}
        at, item, place = self.hits(b"\n".join(texts))
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        wide = 1 << int(2 * (self.k.max() + 1)).bit_length()
        rows = (int(sizes.sum()) + self.reach) // wide + 3
        alive = np.zeros(len(at), bool)
        for shift in (0, wide // 2):
            _, back, n = np.unique(item * rows + (at - place + self.reach + shift) // wide, return_inverse=True, return_counts=True)
            alive |= n[back] >= self.need.min()
        at, item, place = at[alive], item[alive], place[alive]
        if not len(at):
            return {}
        text = np.searchsorted(starts, at, side="right") - 1
        order = np.argsort(text, kind="stable")
        found, first = np.unique(text[order], return_index=True)
        return {int(i): (at[x] - starts[i], item[x], place[x]) for i, x in zip(found, np.split(order, first[1:]), strict=True)}

    def candidates(self, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(region, lowest diagonal) of each band of a text's hits that reaches its region's bound, whole items first."""
        diagonal = at - place
        out = []
        for n in np.unique(item).tolist():
            d, p = diagonal[item == n], place[item == n]
            first, last = self.of_item[n : n + 2]
            places = np.sort(p)
            inside = np.searchsorted(places, self.region[first:last, 2] - Q, "right") - np.searchsorted(places, self.region[first:last, 1])
            for r in (first + np.flatnonzero(inside >= self.need[first:last])).tolist():
                _, lo, hi = self.region[r]
                own = (p >= lo) & (p + Q <= hi)
                step = int(self.k[r]) + 1
                bands = d[own] // step
                # a place in the item counts once in a band, however often the text repeats its q-gram
                both = np.unique(np.concatenate((bands, bands - 1)) * self.reach + np.tile(p[own], 2))
                band, count = np.unique(both // self.reach, return_counts=True)
                out += [(r, b * step) for b in band[count >= self.need[r]].tolist()]
        return out

    def verify(self, data: bytes, r: int, diagonal: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the region's best place on diagonals `diagonal` up to 2k + 2 further, within budget."""
        n, lo, hi = self.region[r]
        pattern, k = self.items[n][1][lo:hi], int(self.k[r])
        a = max(0, diagonal + lo - k)
        text = data[a : max(0, diagonal + hi + 3 * k + 2)]
        exact = text.find(pattern)
        if exact >= 0:
            return a + exact, a + exact + len(pattern), 0
        found = align(pattern, text, k, diagonal + lo - a - k)
        return found and (a + found[0], a + found[1], found[2])

    def find_all(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int, bool]]]:
        """What `find` gives for each text."""
        dense = self.dense_hits(texts)
        return [self.find(x, dense.get(i)) for i, x in enumerate(texts)]

    def find(self, data: bytes, hits: tuple | None) -> list[tuple[int, int, int, int, bool]]:
        """(item number, start, end, edits, whole) of verified regions; windows inside a found item are left out."""
        out: list[tuple[int, int, int, int, bool]] = []
        for r, diagonal in self.candidates(*hits) if hits else ():
            n, lo, hi = self.region[r].tolist()
            a, b = diagonal + lo, diagonal + hi + 2 * int(self.k[r]) + 2
            if any(x == n and s - 16 <= a + 16 and b - 16 - 2 * int(self.k[r]) <= e + 16 for x, s, e, *_ in out):
                continue
            if got := self.verify(data, r, diagonal):
                out.append((n, *got, hi - lo == len(self.items[n][1])))
        if len(self.short):
            for last, (size, numbers) in self.short.iter(data.decode("latin-1")):
                a, b = last + 1 - size, last + 1
                if (not a or data[a - 1] in BORDER) and (b == len(data) or data[b] in BORDER):
                    out += [(n, a, b, 0, True) for n in numbers]
        return out

    def is_passage(self, n: int) -> bool:
        d = self.items[n][1]
        return len(d) >= LEAST or d.count(b" ") + 1 >= PASSAGE_WORDS


def align(pattern: bytes, text: bytes, k: int, low: int) -> tuple[int, int, int] | None:
    """The best place of `pattern` in `text` with at most k edits, within 4k + 3 diagonals from `low` on.

    Row by row over the pattern; a row holds the band's cells, and the place where each cell's path began.
    """
    width = 4 * k + 4
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8).astype(np.int16)
    far = 1 << 20
    pad = np.full(len(pattern) + width + max(0, low) + 2 + max(0, -low), -1, np.int16)
    pad[max(0, -low) : max(0, -low) + len(t)] = t[: len(pad) - max(0, -low)]
    start = low + max(0, -low)
    cols = np.arange(width)
    up, above = np.full(width, far), np.zeros(width, np.int64)
    place = low + cols
    cost = np.where((place >= 0) & (place <= len(t)), 0, far)
    begin = place.copy()
    for i, c in enumerate(p.tolist()):
        letters = pad[start + i : start + i + width]
        new = cost + (letters != c)
        src = begin
        up[:-1], above[:-1] = cost[1:] + 1, begin[1:]
        better = up < new
        new = np.where(better, up, new)
        src = np.where(better, above, src)
        run = (new - cols) * (width + 1) + cols  # the cheapest cell to the left, with its column
        best = np.minimum.accumulate(run)
        from_ = best % (width + 1)
        cost, begin = new[from_] + cols - from_, src[from_]
        if cost.min() > k:
            return None
    ends = low + cols + len(p)
    ok = (ends >= 0) & (ends <= len(t))
    if not ok.any():
        return None
    x = int(np.argmin(np.where(ok, cost, far)))
    return (int(begin[x]), int(ends[x]), int(cost[x])) if cost[x] <= k and ok[x] else None


def _finder(shared, column: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("leaks")
        index = shared.value
        for b in row_batches(batches, 1 << 20):
            texts = [normalise(x or "") for x in b.column(column).to_pylist()]
            found = index.find_all(texts)
            if kind == "clean":
                yield b.filter(pa.array([not any(index.is_passage(n) for n, *_ in f) for f in found], pa.bool_()))
                continue
            take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = [(index.items[n][0], *rest) for f in found for n, *rest in f]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), *(pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())))],
                ["doc_id", "item_id", "start", "end", "edits", "whole"],
            )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, BLOCK_BYTES of their text at a time; the items are read as a stream."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        data = normalise(row["text"])
        block.append((row["item_id"], data))
        size += len(data)
        if size >= BLOCK_BYTES:
            yield Index(block)
            block, size = [], 0
    if block:
        yield Index(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits, whole) of each verified region.

    Offsets are bytes of the normalised text; `whole` tells whole items from windows of them.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, item_id bigint, start int, end int, edits int, whole boolean"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark):
        part = texts.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(index), 1, "found"), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, whole, in which no item is found."""
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_finder(shared, docs.columns.index("text"), "clean"), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: where documents hold benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
