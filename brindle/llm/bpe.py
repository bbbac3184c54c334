"""Byte pair encoding and decoding with a given vocabulary of the tokenizers library.

Encoding is backtracking: for each position the longest token that starts there comes from an Aho-Corasick
automaton over the mirrored tokens; a token is taken if it may stand beside the one before it, which a table
of pair compatibility tells, else the next shorter token is tried, else the token before it is given up.
A position that was given up once is never entered again, so the work is linear in the length of a word.
Decoding looks up each id's place in one block of token texts (an offset table).

Texts are normalised (NFC, lower case) and split as the vocabulary's file demands.  Special tokens are found
in the raw text.  Null texts count as empty and give no ids.  Repeated rows give repeated results.  Very long texts are
read whole, a piece at a time; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, table, worker_state

END = "Ā"  # stands for the end of a word after its last byte
PIECE = 1 << 20  # characters of a text that are split into words at a time, cut before white space
CACHED_WORDS = 1 << 18
CACHED_PAIRS = 1 << 18


def load(path: str) -> dict:
    """What an encoder needs of a vocabulary file."""
    with open(path, "rb") as f:
        return parse(f.read())


def parse(data: bytes) -> dict:
    spec = json.loads(data)
    model = spec["model"]
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "suffix": model["end_of_word_suffix"],
    }


@lru_cache(1)
def _byte_letters() -> dict[str, str]:
    """The letter that byte-level vocabularies write for each byte, to the byte's own Latin-1 letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(others)}


def _ranges(kinds: str, end: int) -> str:
    """A character class body of the code points below `end` whose general category begins with one of `kinds`."""
    out, start = [], None
    for x in range(end + 1):
        inside = x < end and unicodedata.category(chr(x)).startswith(tuple(kinds.split()))
        if inside and start is None:
            start = x
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{x - 1:04x}")
            start = None
    return "".join(out)


@lru_cache(2)
def _splitter(end: int) -> re.Pattern:
    """The words of normalised texts whose code points are all below `end`, 65,536 at most."""
    letters, numbers = _ranges("L", end), _ranges("N", end)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


@lru_cache(1)
def _unsure() -> re.Pattern:
    """Code points that this Python's tables don't know, or that its patterns are slow with."""
    far = "".join(chr(x) for x in range(0xF900, 0xFB00) if unicodedata.normalize("NFC", chr(x)) > "\uffff")
    return re.compile(f"[{far}{_ranges('Cn', 0x10000)}\\U00010000-\\U0010ffff]")


@lru_cache(1)
def _library():
    """The library's own normaliser and splitter, for texts with code points of newer Unicode versions."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    words = Regex("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
    return normal.normalize_str, pre_tokenizers.Split(words, "removed", invert=True).pre_tokenize_str


_SIGMA_LOWER = str.maketrans({"Σ": "σ"})  # each character on its own: no final sigma


def split_words(text: str) -> list[str]:
    """The normalised text's words."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _unsure().search(text):
            normalise, split = _library()
            return [w for w, _ in split(normalise(text))]
        return _splitter(0x10000).findall(unicodedata.normalize("NFC", text).translate(_SIGMA_LOWER).lower())
    return _splitter(0x100).findall(text.lower())


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, spec: dict):
        letters = _byte_letters()
        suffix = spec["suffix"]

        def inner(token: str) -> str:
            ended = token.endswith(suffix) and len(token) > len(suffix)
            body = token[: -len(suffix)] if ended else token
            return "".join(letters[c] for c in body) + (END if ended else "")

        ids = spec["vocab"]
        self.special = spec["special"]
        self.special_rx = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.merge: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            left, right, both = ids[a], ids[b], ids[a + b]
            self.merge[left, right] = rank
            self.made_by[both] = (rank, left, right)
        self.fits: dict[int, bool] = {}  # by both ids in one number
        whole = {}
        for token in sorted(ids, key=len):
            t = ids[token]
            if t not in self.made_by or self._is_whole(t, whole):
                whole[t] = inner(token)
        places = {text: t for t, text in whole.items()}
        self.shorter: dict[int, int] = {}
        mirrored = ahocorasick.Automaton()
        for text, t in places.items():
            mirrored.add_word(text[::-1], t)
            self.shorter[t] = next((places[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in places), -1)
        mirrored.make_automaton()
        self.mirrored, self.width, self.places = mirrored, {t: len(x) for t, x in whole.items()}, places
        self.words: dict[str, bytes] = {}
        texts = {t: token for token, t in (ids | self.special).items()}
        raw = [(texts.get(t, "") + " ").encode() for t in range(max(texts) + 1)]
        self.block = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def _is_whole(self, t: int, whole: dict[int, str]) -> bool:
        """Whether encoding the token's own text gives this token."""
        _, left, right = self.made_by[t]
        return left in whole and right in whole and self._stays_apart(left, right, False)

    def _stays_apart(self, left: int, right: int, at_top: bool = True) -> bool:
        """Whether merges in order of rank never join the end of `left` with the beginning of `right`.

        While both sides grow from single bytes to whole tokens, the two parts that touch can merge if
        their merge comes before either part's next one; of equal ranks the leftmost merges first.
        """
        lefts, rights = [left], [right]
        while lefts[-1] in self.made_by:
            lefts.append(self.made_by[lefts[-1]][2])
        while rights[-1] in self.made_by:
            rights.append(self.made_by[rights[-1]][1])
        never = len(self.merge)
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            up = self.made_by[lefts[i - 1]][0] if i else never
            across = self.made_by[rights[j - 1]][0] if j else never
            rank = self.merge.get((lefts[i], rights[j]), never)
            if not i and not j:
                return rank == never or not at_top
            if rank < up and rank <= across:
                return False
            if up <= across:
                i -= 1
            else:
                j -= 1

    def pair_fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self._stays_apart(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word, given as its bytes' Latin-1 letters and END."""
        if (one := self.places.get(word)) is not None:
            return [one]
        n = len(word)
        longest = [-1] * n
        for end, t in self.mirrored.iter(word[::-1]):
            if longest[n - 1 - end] < self.width[t]:
                longest[n - 1 - end] = self.width[t]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, t = 0, self._longest(word, 0, longest)
        while True:
            while t >= 0 and (dead[at + self.width[t]] or (out and not self.pair_fits(out[-1], t))):
                t = self.shorter[t]
            if t >= 0:
                out.append(t)
                at += self.width[t]
                if at == n:
                    return out
                t = self._longest(word, at, longest)
            elif not out:
                raise ValueError("the vocabulary can't spell this word")
            else:
                dead[at] = 1
                t = out.pop()
                at -= self.width[t]
                t = self.shorter[t]

    def _longest(self, word: str, at: int, longest: list[int]) -> int:
        return self.places[word[at : at + longest[at]]] if longest[at] > 0 else -1

    def _plain(self, text: str) -> Iterator[bytes]:
        """The ids of a text without special tokens, a piece at a time."""
        words = self.words
        at, end = 0, len(text)
        while at < end:
            cut = end
            if end - at > PIECE:
                space = re.compile(r"\s").search(text, at + PIECE)
                cut = space.start() if space else end
            parts = split_words(text[at:cut])
            at = cut
            new = set(parts).difference(words)
            if len(words) + len(new) > CACHED_WORDS:
                words.clear()
                new = set(parts)
            for w in new:
                ids = self.encode_word(w.encode().decode("latin-1") + END)
                words[w] = np.array(ids, "<u4").tobytes()
            yield b"".join(map(words.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self.special_rx is None or "<|" not in text and not self.special_rx.search(text):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.special_rx.finditer(text):
            out += [*self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join((*out, *self._plain(text[at:])))

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The UTF-8 bytes of the decoded text in pieces: token texts with a space between them."""
        all_ids = np.frombuffer(ids, "<u4")
        for lo in range(0, len(all_ids), 1 << 16):
            part = all_ids[lo : lo + (1 << 16)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            where = np.repeat(self.starts[part] - ends + sizes, sizes)
            where += np.arange(len(where))
            data = self.block[where].tobytes()
            yield data[:-1] if lo + len(part) == len(all_ids) else data


def _codec(name: str, spec) -> Codec:
    """This worker's codec: built once from the bytes of the vocabulary's file, which take less room than its values."""
    return worker_state(("bpe", name), lambda: Codec(parse(spec.value)))


def _mapper(name: str, spec, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, spec)
        for b in row_batches(batches, 1 << 20):
            ids, counts, sums, decoded = [], [], [], []
            for text in b.column(1).to_pylist():
                code = codec.encode(text or "")
                counts.append(len(code) // 4)
                if digests:
                    sums.append(hashlib.sha256(code).hexdigest())
                    h = hashlib.sha256()
                    for part in codec.decode(code):
                        h.update(part)
                    decoded.append(h.hexdigest())
                else:
                    ids.append(code)
                    decoded.append(b"".join(codec.decode(code)).decode())
            first = pa.array(sums, pa.string()) if digests else pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), first, pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def tokenize(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids` and `decoded` of every row of `docs`.

    `vocabulary` is the path of a vocabulary file that the driver can read; its bytes are broadcast, a few megabytes.  `ids` is binary (little-endian unsigned 32-bit integers) and `decoded`
    the text; with `digests` both are the lowercase hex SHA-256 of that instead.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids {'string' if digests else 'binary'}, decoded string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _mapper(vocabulary, spec, digests), schema
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: digests of each text's ids and of what they decode to."""
    out = tokenize(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
