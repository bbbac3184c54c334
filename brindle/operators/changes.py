"""The change log: what changed since, what awaits synchronising, remote batches and pruning."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CommitConflict
from ..sources.database import KEYS, VERSIONS, Batch, Database
from .relations import latest

SLICES = 1 << 14
TRIES = 20


def changes_since(changes: DataFrame, lsn: int) -> DataFrame:
    return changes.where(F.col("lsn") > lsn).orderBy("lsn", "ord")


def sync_state(changes: DataFrame) -> DataFrame:
    """The newest change of each record."""
    return latest(changes, ["collection", "record_id"], [F.desc("lsn"), F.desc("ord")])


def locally_changed(changes: DataFrame) -> DataFrame:
    """Records that await synchronising, oldest first."""
    return sync_state(changes).where("dirty and origin <> 'remoteSync'").orderBy("lsn", "ord")


def nth(df: DataFrame, column: str, n: int, bounds: tuple[int, int] | None = None) -> tuple[int, int]:
    """The n-th smallest value (from 1) of a whole-number column, and how many are smaller; there are n at least.

    Each pass counts the rows in SLICES slices of what is left, so no rows are sorted or moved.
    """
    low, high = bounds or df.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // SLICES)
        inside = df.where(F.col(column).between(low, high))
        counts = inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("bigint").alias("slice")).count()
        for r in sorted(counts.collect(), key=lambda r: r["slice"]):
            if below + r["count"] >= n:
                low, high = low + r["slice"] * width, min(high, low + (r["slice"] + 1) * width - 1)
                break
            below += r["count"]
    return low, below


def pruned(changes: DataFrame, most: int, order: list[str], dirty: str = "dirty") -> DataFrame:
    """At most `most` records: the oldest clean ones by `order` (two whole-number columns) go, dirty ones never do.

    The cut is a place in the order of clean records that counting finds; a filter then does the rest.
    """
    clean = changes.where(~F.col(dirty))
    first, second = order
    at = F.when(~F.col(dirty), F.col(first))
    total, have, low, high = changes.agg(F.count(F.lit(1)), F.count(at), F.min(at), F.max(at)).first()
    extra = total - most
    if extra <= 0 or not have:
        return changes
    top, below = nth(clean, first, min(extra, have), (low, high))
    last, _ = nth(clean.where(F.col(first) == top), second, min(extra, have) - below)
    newer = (F.col(first) > top) | (F.col(first) == top) & (F.col(second) > last)
    return changes.where(F.col(dirty) | newer)


def first_unseen(records: DataFrame, key: str, order: list[Column], seen: DataFrame | None) -> DataFrame:
    """The first record of each idempotency key that isn't in `seen`."""
    first = latest(records.where(F.col(key).isNotNull()), [key], order).unionByName(records.where(F.col(key).isNull()))
    return first if seen is None else first.join(seen.select(F.col(key).alias("_seen")), F.col(key) == F.col("_seen"), "left_anti")


class Sync:
    """Sync-state transitions of a database's change log."""

    def __init__(self, db: Database):
        self.db = db
        self.keys = db._collection(KEYS, "id", "id string")
        self.versions = db._collection(VERSIONS, "id", "id string, version string")

    def _replace(self, new: Callable[[DataFrame], DataFrame], watermark: bool = False) -> int:
        """Replace the log by what `new` makes of it; again if a commit came between."""
        for _ in range(TRIES):
            manifest = self.db.log.manifest()
            old = self.db.changes(manifest=manifest)
            left = new(old)
            cut = None
            if watermark:
                cut = old.join(left.select("lsn", "ord"), ["lsn", "ord"], "left_anti").agg(F.max("lsn")).first()[0]
            try:
                return self.db.commit({}, replace_changes=left, expect=manifest["lsn"], watermark=cut)
            except CommitConflict:
                continue
        raise CommitConflict("the change log is written all the time")

    def _wanted(self, ids: list | DataFrame) -> list[DataFrame]:
        """Distinct ids as frames of `record_id`, or of `collection` and `record_id`."""
        if isinstance(ids, DataFrame):
            return [ids.select(*(F.col(c).cast("string").alias(c) for c in ("collection", "record_id") if c in ids.columns)).distinct()]
        plain = list(dict.fromkeys(str(i) for i in ids if not isinstance(i, tuple)))
        pairs = list(dict.fromkeys((i[0], str(i[1])) for i in ids if isinstance(i, tuple)))
        text, tables = pa.string(), []
        if plain:
            tables.append(pa.table({"record_id": pa.array(plain, text)}))
        if pairs:
            tables.append(pa.table({"collection": pa.array([c for c, _ in pairs], text), "record_id": pa.array([i for _, i in pairs], text)}))
        return [self.db.spark.createDataFrame(t) for t in tables]

    def _mark(self, ids: list | DataFrame, **columns: Column) -> int:
        """Rewrite the records of `ids`: plain ids match in any collection, (collection, id) pairs exactly.

        A frame of ids has `record_id`, and `collection` for pairs.  The log is joined with the ids, as there can be as
        many of them as of records.
        """
        wanted = self._wanted(ids)

        def marked(log: DataFrame) -> DataFrame:
            joined, hit = log, F.lit(False)
            for k, part in enumerate(wanted):
                joined = joined.join(part.withColumn(f"_hit{k}", F.lit(True)), part.columns, "left")
                hit = hit | F.col(f"_hit{k}").isNotNull()
            return joined.select(*(F.when(hit, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in log.columns))

        return self._replace(marked)

    def synchronizing(self, ids: list | DataFrame) -> int:
        return self._mark(ids, phase=F.lit("synchronizing"))

    def synced(self, ids: list | DataFrame) -> int:
        return self._mark(ids, phase=F.lit("synced"), dirty=F.lit(False))

    def failed(self, ids: list | DataFrame, error: str) -> int:
        return self._mark(ids, phase=F.lit("failed"), retries=F.col("retries") + 1, error=F.lit(error))

    def is_duplicate(self, key: str) -> bool:
        """Whether a remote record with this idempotency key was applied, however long ago."""
        return self.keys.get(key) is not None

    def remote_version(self, collection: str, key: object) -> object:
        """The remote's version of a record as last told, None if it never was."""
        row = self.versions.get(f"{collection}/{key}")
        return None if row is None else json.loads(row["version"])

    def set_remote_version(self, collection: str, key: object, version: object) -> int:
        return self.db.apply(Batch().put(VERSIONS, f"{collection}/{key}", self._version(collection, key, version)))

    @staticmethod
    def _version(collection: str, key: object, version: object) -> dict:
        return {"id": f"{collection}/{key}", "version": json.dumps(version, default=str)}

    def apply_remote(self, records: list[dict]) -> list:
        """Commit remote puts and deletes once for each idempotency key; gives the ids that it wrote."""
        wanted = [r["idempotency_key"] for r in records if r.get("idempotency_key")]
        seen = {r["id"] for r in self.keys.get_many(wanted)} if wanted else set()
        batch, ids = Batch(), []
        for r in records:
            key = r.get("idempotency_key")
            if key in seen and key is not None:
                continue
            batch.ops.append((r["collection"], r["kind"], r["record_id"], r.get("value")))
            batch.notes[r["collection"], r["record_id"]] = {"idempotency_key": key, "remote_version": json.dumps(r.get("remote_version"))}
            if key:
                seen.add(key)
                batch.put(KEYS, key, {"id": key})
            if r.get("remote_version") is not None:
                batch.put(VERSIONS, f"{r['collection']}/{r['record_id']}", self._version(r["collection"], r["record_id"], r["remote_version"]))
            ids.append(r["record_id"])
        self.db.apply(batch, origin="remoteSync", dirty=False)
        return ids

    def apply_remote_deletion(self, ids: list) -> list[tuple[str, str]]:
        """Delete what the remote deleted, as clean remote changes; gives the (collection, id) pairs.

        If any id is a pair only pairs count; else each id means the records of the change log that have it.
        """
        pairs = [i for i in ids if isinstance(i, tuple)]
        if not pairs and ids:
            known = sync_state(self.db.changes()).where(F.col("record_id").isin([str(i) for i in ids])).select("collection", "record_id")
            pairs = sorted((r["collection"], r["record_id"]) for r in known.collect() if r["collection"] in self.db.collections)
        batch = Batch()
        for name, key in pairs:
            c = self.db.collections[name]
            batch.delete(name, int(key) if c.kind[c.key].dataType.typeName() in ("byte", "short", "integer", "long") else key)
        self.db.apply(batch, origin="remoteSync", dirty=False)
        return pairs

    def prune(self, most: int = 1000) -> int:
        return self._replace(lambda log: pruned(log, most, ["lsn", "ord"]), watermark=True)
