"""N-gram Jaccard join with parity sketches: documents whose word shingles are nearly the same, and their groups.

A document's set holds its distinct `SHINGLE`-word shingles, each as a 64-bit hash.  Two documents link if
100 * |A & B| >= PERCENT * |A | B|, which bounds the size of the symmetric difference by their sizes.

Size bands: sets are put in bands by size; a pair belongs to its smaller set's band, whose largest difference D
is known.  Hashes are dealt over p > D parts, and each part keeps the XOR of its hashes.  A shingle changes one
part at most, so a pair in the band agrees in p - D parts at least: joining on (band, part, XOR) finds it.  p has
some parts more than D + 1, so that parts with fewer than two shingles, where chance agreements sit, can be left
out; a set with too many of them keeps them all.  Either set's surplus suffices, so no pair is lost.

Each band also has a bit sketch: every shingle flips one bit, so the Hamming distance is a lower bound of the
difference and most chance pairs end there.  What is left is verified on the texts.

Equal sets are one class and are never paired.  Within a bucket of classes every class is first compared with the
bucket's smallest one; connected classes are contracted, and buckets that still hold several components are
compared with another class that a hash picks; in buckets that hold several even then all pairs across components
are compared, block by block within tasks, so that large groups of near copies give
links in proportion to their size and yet no link that joins two components is missed.  A key's share of all rows
is bounded: a class has a row in each of its parts.  Components come from alternating star contractions.

Linked classes share a component, so each class's links are counted there: within a component of three classes or
more every pair whose sizes allow a link is compared on its shingles, block by block within tasks.  That work grows
with the square of a component's classes, as its links can; rows are one for each class and block.

Null or empty texts, and texts without words, have the empty set and link with nothing.  Rows that share an id
but not the text are separate documents.  A group's id is its smallest non-null doc_id.  Very long texts are read whole;
an empty table gives an empty result; further columns don't matter, and a pipeline stage gives them back.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, row_batches, small_side, table, worker_state, written

SHINGLE = 4
PERCENT = 85
GROWTH = 1.5
SURPLUS = 0.25
ROUNDS = 3  # of star comparisons, the last one being that of all pairs across components
CHUNK = 2048  # classes of a bucket that a task compares with as many others at a time
COUNTED, SET_BYTES = 512, 4 << 20  # classes of a component, and bytes of their sets, in a block whose links are counted
CACHED_WORDS = 1 << 16
U = np.uint64
MIX = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * MIX[1]
    x = (x ^ (x >> U(27))) * MIX[2]
    return x ^ (x >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, U)
    known = worker_state("words")
    new = set(words).difference(known)
    if len(known) + len(new) > CACHED_WORDS:
        known.clear()
        new = set(words)
    for w in new:
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, U)
    for i in range(k):
        out = out * MIX[0] + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out))


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference that linked sets of these sizes can have."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def largest_partner(n: int) -> int:
    return 100 * n // PERCENT


class Band:
    """One size band: its largest size, parts and sketch bits."""

    def __init__(self, number: int, top: int):
        self.number, self.top = number, top
        self.apart = most_apart(top, largest_partner(top))
        self.parts = self.apart + 1 + math.ceil(SURPLUS * self.apart)
        self.log_bits = max(6, (top - 1).bit_length() + 2)  # about one shingle to four bits or more: few cancel out


_bands: list[Band] = []


def bands_of(n: int) -> list[Band]:
    """The bands in which a set of this size can meet a partner: its own, and the one below if its sizes reach it."""
    while not _bands or _bands[-1].top < n:
        last = _bands[-1].top if _bands else 0
        _bands.append(Band(len(_bands), max(last + 1, int(last * GROWTH))))
    lo, hi = 0, len(_bands) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _bands[mid].top >= n else (mid + 1, hi)
    below = [_bands[lo - 1]] if lo and largest_partner(_bands[lo - 1].top) >= n else []
    return [b for b in (*below, _bands[lo]) if b.apart]


def signatures(h: np.ndarray, band: Band) -> np.ndarray:
    """The join keys of a set's parts in a band."""
    n = len(h)
    part = ((h >> U(32)) * U(band.parts)) >> U(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    size = np.diff(np.append(first, n))
    fold, number = np.bitwise_xor.reduceat(h, first), part[first]
    sparse = band.parts - len(first) + int((size < 2).sum())
    if sparse + min(band.apart, most_apart(n, largest_partner(n))) < band.parts:
        fold, number = fold[size > 1], number[size > 1]
    elif len(first) < band.parts:
        none = np.setdiff1d(np.arange(band.parts, dtype=U), number)
        fold, number = np.append(fold, np.zeros(len(none), U)), np.append(number, none)
    return mixed(fold + mixed(number * MIX[0] + U(band.number + 1)))


def sketch(h: np.ndarray, band: Band) -> bytes:
    """The parities of the band's bits."""
    bit = (h * MIX[0]) >> U(64 - band.log_bits)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=1 << band.log_bits).astype(np.uint8) & 1).tobytes()


def class_of(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes(), len(h)) - (1 << 63)


_FEATURES = "n bigint, cls bigint, sketches array<struct<band:int,bits:binary>>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())]))
    for b in row_batches(batches, 2 << 20):
        sets = [shingles(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array([class_of(h) if len(h) else None for h in sets], pa.int64()),
                pa.array([[{"band": x.number, "bits": sketch(h, x)} for x in bands_of(len(h))] if len(h) else [] for h in sets], kind),
            ],
            ["doc_id", "th", "n", "cls", "sketches"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # classes that this task has given already
    for b in row_batches(batches, 2 << 20):
        keys, owners = [np.empty(0, U)], [np.empty(0, np.int64)]
        for text in b.column(0).to_pylist():
            h = shingles(text)
            if len(h) and (c := class_of(h)) not in seen:
                seen.add(c)
                for band in bands_of(len(h)):
                    keys.append(signatures(h, band))
                    owners.append(np.full(len(keys[-1]), c))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "cls"])


def _near(sizes: tuple[int, int], sketches: tuple[dict, dict]) -> bool:
    """Whether the sizes allow a link and the sketches don't rule it out."""
    a, b = sorted(sizes)
    if PERCENT * b > 100 * a:
        return False
    shared = sketches[0].keys() & sketches[1].keys()
    return bool(shared) and all((sketches[0][x] ^ sketches[1][x]).bit_count() <= most_apart(a, b) for x in shared)


def _numbers(sketches: list[dict]) -> dict[int, int]:
    return {s["band"]: int.from_bytes(s["bits"], "big") for s in sketches}


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in row_batches(batches, 4 << 20):
        a, c, na, nb, sa, sb = (x.to_pylist() for x in b.columns)
        ok = [_near((na[i], nb[i]), (_numbers(sa[i]), _numbers(sb[i]))) for i in range(len(a))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: OrderedDict[int, np.ndarray] = OrderedDict()

    def shingles_of(c: int, text: str) -> np.ndarray:
        if c not in held:
            held[c] = shingles(text)
            while len(held) > 32:
                held.popitem(last=False)
        return held[c]

    for batch in row_batches(batches, 4 << 20):
        ok = []
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p, q = shingles_of(a, x), shingles_of(b, y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components in each sorted run of equal (key, i, j)."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        out = []
        left = [(c, root, n, _numbers(s)) for _, i, j, block, c, root, n, s in rows if block == i]
        right = left if rows[0][1] == rows[0][2] else [(c, root, n, _numbers(s)) for _, i, j, block, c, root, n, s in rows if block == j]
        for x, (c, root, n, s) in enumerate(left):
            for d, other, m, t in right[x + 1 :] if right is left else right:
                if root != other and _near((n, m), (s, t)):
                    out.append((min(c, d), max(c, d)))
        return out

    rows: list[tuple] = []
    for b in batches:
        found: set[tuple[int, int]] = set()
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[0][:3] != row[:3]:
                found.update(pairs(rows))
                rows = []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])
    if rows:
        last = pairs(rows)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in last], pa.int64()), pa.array([p[1] for p in last], pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in row_batches(batches, 2 << 20):
        sets = [shingles(x).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["cls", "hashes"])


def _between(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """How many links each set has with those of the other list, or within its own; lists are in order of size."""
    own, others = right is None, left if right is None else right
    flat = np.unique(np.concatenate(left + ([] if own else others)), return_inverse=True)[1].ravel()
    ends = np.cumsum([len(h) for h in left])
    first = 0 if own else ends[-1]
    sizes = np.array([len(h) for h in others])
    starts = np.append(0, np.cumsum(sizes))
    codes, marked = flat[first:], np.zeros(flat.max() + 1, np.uint8)
    counts = np.zeros(len(left), np.int64), np.zeros(len(others), np.int64)
    for x, h in enumerate(left):
        n = len(h)
        lo = x + 1 if own else np.searchsorted(sizes, -(-PERCENT * n // 100))
        hi = np.searchsorted(sizes, largest_partner(n), "right")
        if lo < hi:
            mine = flat[ends[x] - n : ends[x]]
            marked[mine] = 1
            both = np.add.reduceat(marked[codes[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            marked[mine] = 0
            linked = 100 * both >= PERCENT * (n + sizes[lo:hi] - both)
            counts[0][x] += linked.sum()
            counts[1][lo:hi] += linked
    return counts


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, n_links) for the classes of each sorted run of equal (root, i, j)."""

    def counted(rows: list[tuple]) -> pa.RecordBatch:
        _, i, j = rows[0][:3]
        sides = [sorted(((c, np.frombuffer(h, U)) for *_, block, c, h in rows if block == x), key=lambda y: len(y[1])) for x in sorted({i, j})]
        classes, n = [c for side in sides for c, _ in side], np.empty(0, np.int64)
        if all(sides):
            sets = [[h for _, h in side] for side in sides]
            a, b = _between(sets[0], sets[1] if len(sets) > 1 else None)
            n = np.append(a, b) if len(sets) > 1 else a + b
        return pa.RecordBatch.from_arrays([pa.array(classes[: len(n)], pa.int64()), pa.array(n)], ["cls", "n_links"])

    rows: list[tuple] = []
    for b in row_batches(batches, 2 << 20):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[0][:3] != row[:3]:
                yield counted(rows)
                rows = []
            rows.append(row)
    if rows:
        yield counted(rows)


def contract(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) but the roots: alternating large-star and small-star steps.

    Steps go on until nothing changes, and a root is its component's smallest node.  After a number of `rounds`, nodes
    with the same root are connected, though not all connected nodes may share one.
    """
    edges = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct()
    mark = None
    for _ in count() if rounds is None else range(rounds):
        both = edges.unionAll(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = large.where("node <> root").distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e"))
        edges = written(small.select("e.*").where("node <> root").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("node").agg(F.min("root").alias("root"))


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str, sifted: bool = False) -> DataFrame:
    """The pairs (a, b) of classes that link, verified on the texts of a document of each."""
    if not sifted:
        a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketches").alias("sa"))
        b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketches").alias("sb"))
        pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sift, "a bigint, b bigint")
    pairs = written(pairs, f"{name}-pairs")
    involved = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct()
    texts = written(_texts(involved, classes, docs, name), f"{name}-texts")
    one = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return written(both.mapInArrow(_verify, "a bigint, b bigint"), f"{name}-links")


def _texts(involved: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(cls, text) of a document of each of the classes `involved`."""
    chosen = written(classes.join(involved, "cls").select("cls", "first.*"), f"{name}-chosen")
    chosen = small_side(chosen, chosen.count(), 40).alias("c")
    text = F.col("text").cast("string")
    d = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.th") == F.col("c.th"))
    return d.join(chosen, same).select("cls", "text").dropDuplicates(["cls"])


def _link_counts(member: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, n_links): with how many other classes each class of a component of several links."""
    sizes = member.join(classes.select("cls", "n"), "cls").groupBy("root").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("bytes"))
    sizes = sizes.select("root", "g", F.greatest(F.ceil(F.col("g") / COUNTED), F.ceil(F.col("bytes") * 8 / SET_BYTES)).cast("int").alias("blocks"))
    held = written(member.select("cls", "root").join(sizes.where("g > 1"), "root"), "members")
    several = held.where("g > 2")
    sets = _texts(several.select("cls"), classes, docs, "count").mapInArrow(_sets, "cls bigint, hashes binary")
    dealt = several.join(sets, "cls").withColumn("block", _salted(F.col("cls"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "hashes")
    parts = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_count_links, "cls bigint, n_links bigint")
    return parts.groupBy("cls").agg(F.sum("n_links").alias("n_links")).unionAll(held.where("g = 2").select("cls", F.lit(1).cast("bigint")))


def _salted(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), blocks).cast("int")


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `join` starts from: the rows with their classes, the classes, and (cls, low, root) of each class."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = written(docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_features, f"doc_id {ids}, th bigint, {_FEATURES}"), "sets")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.min("doc_id").alias("low"), F.min(F.struct("n", "sketches")).alias("x"))
    classes = written(classes.select("cls", "first", "low", "x.n", "x.sketches"), "classes")
    buckets = Window.partitionBy("key")
    keys = docs.select(text.alias("text")).mapInArrow(_keys, "key bigint, cls bigint")
    keys = keys.withColumns({"pivot": F.min("cls").over(buckets), "top": F.max("cls").over(buckets)})
    shared = written(keys.where("pivot <> top").select("key", "cls", "pivot").distinct(), "buckets")

    star = shared.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
    links = _linked(star, classes, docs, "star")

    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    held = shared.select("key", "cls")
    for seed in range(1, ROUNDS + 1):
        roots = contract(links, rounds=2)
        held = held.select("key", "cls").join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
        pick = F.min_by(F.struct("cls", "root"), F.xxhash64("cls", F.lit(seed))).alias("pick")
        split = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("g"), pick).where("lo <> hi")
        held = written(held.join(split.select("key", "g", "pick"), "key"), f"held-{seed}")
        if seed == ROUNDS:
            break
        new = held.where(F.col("root") != F.col("pick.root")).select(F.least("cls", "pick.cls").alias("a"), F.greatest("cls", "pick.cls").alias("b")).distinct()
        new = written(new.join(tried, ["a", "b"], "left_anti"), f"star-{seed}")
        tried = tried.unionAll(new)
        links = links.unionAll(_linked(new, classes, docs, f"star-{seed}"))

    blocks = F.ceil(F.col("g") / CHUNK).cast("int")
    open_ = held.withColumn("blocks", blocks).withColumn("block", _salted(F.col("cls"), F.col("blocks")))
    open_ = open_.join(classes.select("cls", "n", "sketches"), "cls")
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "root", "n", "sketches")
    across = open_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across, "a bigint, b bigint").distinct()
    more = _linked(across.join(tried, ["a", "b"], "left_anti"), classes, docs, "across", sifted=True)

    edges = written(links.unionAll(more).distinct(), "edges")
    roots = contract(edges)
    member = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    return rows, classes, written(member, "roots")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, class_id, root, n_links, component_id) for every row of `docs`.

    `th` is the text's hash; `class_id` the class of equal sets (null for the empty set); `root` the smallest class
    of the component; `n_links` the number of other classes that its class links with; `component_id` the smallest
    doc_id that links reach.
    """
    rows, classes, member = components(docs)
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    counts = _link_counts(member, classes, docs)
    found = member.join(lowest, "root").join(counts, "cls", "left").select(F.col("cls").alias("class_id"), "root", "component_id", "n_links")
    out = rows.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id")).join(found, "class_id", "left")
    return out.select("doc_id", "th", "n_shingles", "class_id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: every document's set size and component."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest doc_id (nulls last, then by text hash).

    Rows with the empty set all stay.  Of rows that repeat an id and a text one stays.
    """
    rows, _, member = components(docs)
    found = written(rows.select("doc_id", "th", "cls").join(member.select("cls", "root"), "cls").select("doc_id", "th", "root"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    gone = found.join(first, "root").where(rank != F.col("first")).select("doc_id", "th").distinct()
    gone = small_side(gone, gone.count(), 24).alias("g")
    text = F.xxhash64(F.col("d.text").cast("string"))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (text == F.col("g.th"))
    kept = docs.alias("d").join(gone, same, "left_anti")
    again = found.groupBy("doc_id", "th").count().where("count > 1").alias("a")
    firsts = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).alias("f")
    if again.join(firsts, F.col("a.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("a.th") == F.col("f.th")), "left_semi").isEmpty():
        return kept
    th, n = (free_name(docs.columns, x) for x in ("_th", "_n"))
    marked = kept.withColumn(th, F.xxhash64(F.col("text").cast("string"))).withColumn(n, F.row_number().over(Window.partitionBy("doc_id", th).orderBy(th)))
    empty = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^ \\t-\\r]")
    return marked.where((F.col(n) == 1) | empty).drop(n, th)
