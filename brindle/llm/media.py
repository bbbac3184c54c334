"""Media columns: bytes stored as Ogg bitstreams, read back with every page verified.

The container follows RFC 3533.  A stored value multiplexes two logical streams: serial 1 holds the payload
as 8-bit mono samples in packets, with granule positions that count samples; serial 2 describes the payload.
Null texts count as empty.  Null media, and media that fail a check, read back as null payloads with the
reason in `error`.  Equal inputs give equal media.  Very long texts are stored whole, in as many pages as they need; an
empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_batches, table

HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, ABOUT = 1, 2
RATE, PACKET, BLOCK = 8000, 5000, 64
_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


class OggError(ValueError):
    """A bitstream that breaks the format or fails a checksum."""


def page_crc(*parts: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04C11DB7, most significant bit first, start 0) of the joined parts.

    zlib has the mirrored form of it, so bytes are mirrored on the way in and the sum on the way out.
    """
    crc = 0xFFFFFFFF
    for part in parts:
        crc = zlib.crc32(part.translate(_MIRROR), crc)
    return int.from_bytes((crc ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_MIRROR), "big")


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; its first packet has the first page to itself."""
    pages: list[bytes] = []
    for group, start in ((packets[:1], 0), (packets[1:], 1)):
        lacing = b"".join(_lacing(len(p)) for p in group)
        body = b"".join(group)
        ends = np.flatnonzero(np.frombuffer(lacing, np.uint8) < 255)
        at = 0
        for lo in range(0, len(lacing), 255):
            part = lacing[lo : lo + 255]
            size = sum(part)
            done = int(np.searchsorted(ends, lo + len(part)))
            before = int(np.searchsorted(ends, lo))
            flags = (CONTINUED if lo and lacing[lo - 1] == 255 else 0) | (0 if pages else FIRST)
            if start + done == len(packets) and lo + 255 >= len(lacing):
                flags |= LAST
            granule = granules[start + done - 1] if done > before else -1
            head = (b"OggS", 0, flags, granule, serial, len(pages))
            data = body[at : at + size]
            crc = page_crc(HEADER.pack(*head, 0, len(part)), part, data)
            pages.append(HEADER.pack(*head, crc, len(part)) + part + data)
            at += size
    return pages


def encode(data: bytes) -> bytes:
    """An Ogg file of `data`, padded with bytes 0 to a positive multiple of 64."""
    payload = data + bytes(-len(data) % BLOCK if data else BLOCK)
    chunks = [payload[x : x + PACKET] for x in range(0, len(payload), PACKET)]
    counts = [0, *(min(x + PACKET, len(payload)) for x in range(0, len(payload), PACKET))]
    samples = stream_pages(SAMPLES, [b"PCM8" + struct.pack("<IQ", RATE, len(payload)), *chunks], counts)
    about = stream_pages(ABOUT, [b"ABOUT", struct.pack("<Q", len(data))], [0, 0])
    return b"".join((samples[0], about[0], *about[1:], *samples[1:]))


def read_streams(media: bytes) -> dict[int, dict]:
    """Each logical stream by serial: its packets, the granule position of each page, and page count."""
    streams: dict[int, dict] = {}
    at, end = 0, len(media)
    while at < end:
        if end - at < HEADER.size:
            raise OggError("a page header is cut short")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one must begin")
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        size = sum(lacing)
        if len(lacing) < n or start + size > end:
            raise OggError("a page is cut short")
        body = media[start : start + size]
        if page_crc(media[at : at + 22], b"\0\0\0\0", media[at + 26 : at + HEADER.size], lacing, body) != crc:
            raise OggError("a page checksum differs")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError("a stream has no first page, or two")
        s = streams.setdefault(serial, {"packets": [], "open": [], "granules": [], "ended": False})
        if number != len(s["granules"]) or s["ended"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise OggError("pages of a stream are missing or out of order")
        ends = np.cumsum(np.frombuffer(lacing, np.uint8), dtype=np.int64)
        prior = 0
        for x in ends[np.frombuffer(lacing, np.uint8) < 255].tolist():
            s["packets"].append(b"".join((*s["open"], body[prior:x])))
            s["open"] = []
            prior = x
        if n and lacing[-1] == 255:
            s["open"].append(body[prior:])
        s["granules"].append(granule)
        s["ended"] = bool(flags & LAST)
        at = start + size
    for s in streams.values():
        if s["open"] or not s["ended"]:
            raise OggError("a stream has no last page")
    return streams


def decode(media: bytes) -> dict:
    """Payload, page timestamps in microseconds, and features of what `encode` stored."""
    streams = read_streams(media)
    if not {SAMPLES, ABOUT} <= streams.keys() or len(streams[ABOUT]["packets"]) != 2:
        raise OggError("a logical stream is missing")
    head, *chunks = streams[SAMPLES]["packets"]
    if head[:4] != b"PCM8" or len(head) != 16:
        raise OggError("the samples have another mapping")
    rate, count = struct.unpack("<IQ", head[4:])
    payload = b"".join(chunks)
    granules = [g for g in streams[SAMPLES]["granules"] if g >= 0]
    if len(payload) != count or granules[-1] != count:
        raise OggError("samples and granule positions differ")
    values = np.frombuffer(payload, np.uint8)
    steps = np.count_nonzero(np.diff((values >= 128).view(np.int8)))
    times = [g * 1_000_000 // rate for g in granules[1:]]
    pages = sum(len(s["granules"]) for s in streams.values())
    packets = sum(len(s["packets"]) for s in streams.values())
    feature = (
        f"streams={len(streams)};pages={pages};packets={packets};rate={rate};end_us={times[-1]};"
        f"sum={int(values.sum(dtype=np.int64))};peak={int(values.max())};crossings={int(steps)}"
    )
    return {
        "payload": payload,
        "n_bytes": struct.unpack("<Q", streams[ABOUT]["packets"][1])[0],
        "page_end_us": times,
        "feature": feature,
    }


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in row_batches(batches):
        media = [encode(x or b"") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in row_batches(batches):
        rows = []
        for x in b.column(1).to_pylist():
            try:
                rows.append({**decode(x), "error": None} if x is not None else {"error": "null"})
            except OggError as e:
                rows.append({"error": str(e)})
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pa.array([r.get("payload") for r in rows], pa.binary()),
                pa.array([r.get("n_bytes") for r in rows], pa.int64()),
                pa.array([r.get("page_end_us") for r in rows], pa.list_(pa.int64())),
                pa.array([r.get("feature") for r in rows], pa.string()),
                pa.array([r["error"] for r in rows], pa.string()),
            ],
            ["doc_id", "media", "payload", "n_bytes", "page_end_us", "feature", "error"],
        )


def to_media(docs: DataFrame) -> DataFrame:
    """`doc_id` and `media`, the text's UTF-8 bytes as an Ogg file, for every row of `docs`."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    data = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return data.mapInArrow(_encode_batches, f"doc_id {ids}, media binary")


def from_media(stored: DataFrame) -> DataFrame:
    """`doc_id`, `media`, `payload`, `n_bytes`, `page_end_us`, `feature` and `error` for every row."""
    ids = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(
        _decode_batches,
        f"doc_id {ids}, media binary, payload binary, n_bytes bigint, page_end_us array<bigint>, feature string, error string",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: digests of what each text's media read back."""
    read = from_media(to_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
