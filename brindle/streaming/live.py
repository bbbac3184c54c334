"""Live queries.

`diff` compares two versions of a result by key.  `LiveQuery` registers on a database and, for every commit that
touches its collection, gives added, updated and removed rows of its result between two snapshots.
`stream_changes` reads a directory of change records with Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations
from ..plans.query import Query
from ..sources.database import CHANGE, ChangeSet, Collection, Database

MOST_KEYS = 1000  # of a commit that are looked at one by one


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) for rows that were added, updated or removed; equal rows give nothing.  One shuffle join."""
    a = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    b = new.select(F.col(key).alias("_k"), F.struct(*columns).alias("_new"))
    change: Column = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return a.join(b, "_k", "full").select(F.col("_k").alias(key), change.alias("change")).where("change is not null")


class LiveQuery:
    """Deltas of a query's result; `listener` gets (lsn, frame of key and change, frame of the new result).

    A commit that names its keys is judged by those keys alone: their rows before and after, both by a filter that
    reaches the scan.  If none of them is or was a match, nothing changed.  Without a window their rows are the whole
    delta; a window is compared before and after, as a change of one row moves others.  Distributed writes and clears
    compare whole results.  With `latest`, all commits of a turn of the database are told as one.
    """

    def __init__(self, collection: Collection, shape: Callable[[Query], Query], listener: Callable[[int, DataFrame, DataFrame], None], latest: bool = False):
        self.collection, self.shape, self.listener, self.latest = collection, shape, listener, latest
        self.closed = False
        self.pending: ChangeSet | None = None
        self.counters = {"keys": 0, "windows": 0, "whole": 0, "skipped": 0}

    def start(self) -> DataFrame:
        db = self.collection.db
        first = self.window(db.log.manifest())
        db.listeners.append(self._committed)
        return first

    def _query(self, manifest: dict) -> Query:
        return self.shape(Query(self.collection.frame(manifest=manifest)))

    def window(self, manifest: dict) -> DataFrame:
        return self._query(manifest).find_all()

    def _committed(self, told: ChangeSet) -> None:
        if self.closed or self.collection.name not in told.tables:
            return
        if not self.latest:
            self._tell(told)
            return
        if self.pending is not None:  # one step from before the first to after the last of them
            both = None if None in (self.pending.changes, told.changes) else (*self.pending.changes, *told.changes)
            told = ChangeSet(told.lsn, told.tables, both, self.pending.before, told.after)
        self.pending = told
        self.collection.db.at_turn_end(self._flush)

    def _flush(self) -> None:
        told, self.pending = self.pending, None
        if told is not None and not self.closed:
            self._tell(told)

    def _tell(self, told: ChangeSet) -> None:
        old, new = self._query(told.before), self._query(told.after)
        keys = None if told.changes is None else list(dict.fromkeys(k for t, k, _ in told.changes if t == self.collection.name))
        if keys is None or None in keys or len(keys) > MOST_KEYS:
            self.counters["whole"] += 1
            change = self._difference(old.find_all(), new.find_all())
        else:
            near = [q.matching().where(F.col("_key").isin(keys)) for q in (old, new)]
            if new.size is None and not new.skip:
                self.counters["keys"] += 1
                change = self._difference(*near)
            elif all(x.isEmpty() for x in near):
                self.counters["skipped"] += 1
                change = self._difference(near[0], near[1].where("false"))
            else:
                self.counters["windows"] += 1
                change = self._difference(old.find_all(), new.find_all())
        self.listener(told.lsn, change, new.find_all())

    @staticmethod
    def _difference(old: DataFrame, new: DataFrame) -> DataFrame:
        return diff(old, new, "_key", [c for c in new.columns if c in old.columns])

    def stop(self) -> None:
        self.closed = True
        listeners = self.collection.db.listeners
        if self._committed in listeners:
            listeners.remove(self._committed)


def live_count(db: Database) -> int:
    """How many live queries a database has."""
    return sum(isinstance(getattr(x, "__self__", None), LiveQuery) for x in db.listeners)


def watch_related(collections: list[Collection], ask: Callable[[], DataFrame], listener: Callable[[DataFrame], None]) -> Callable[[], None]:
    """Ask now and after each commit that touches any of the collections; gives a function that stops it.

    With `children`, `parent` or the ids of a `Links` table as the question, it watches a relation from both sides.
    """
    names = {c.name for c in collections}
    listener(ask())

    def committed(told: ChangeSet) -> None:
        if names & set(told.tables):
            listener(ask())

    listeners = collections[0].db.listeners
    listeners.append(committed)
    return lambda: listeners.remove(committed) if committed in listeners else None


def watch_children(parents: Collection, children: Collection, field: str, parent_id: object, listener: Callable[[DataFrame], None]) -> Callable[[], None]:
    return watch_related([parents, children], lambda: children.where({field: parent_id}).find_all(), listener)


def watch_parent(parents: Collection, children: Collection, field: str, child_id: object, listener: Callable[[DataFrame], None]) -> Callable[[], None]:
    return watch_related([parents, children], lambda: relations.parent(children.frame(), "_key", child_id, field, parents.frame(), "_key"), listener)


def watch_join_ids(links: Collection, sides: list[Collection], left: object, listener: Callable[[DataFrame], None]) -> Callable[[], None]:
    return watch_related([links, *sides], lambda: links.right_ids(left), listener)


def coalesced(changes: DataFrame) -> DataFrame:
    """One record for each (lsn, collection, record): the last one."""
    return changes.groupBy("lsn", "collection", "record_id").agg(F.max_by(F.struct("kind", "value"), "ord").alias("last")).select("lsn", "collection", "record_id", "last.kind", "last.value")


def stream_changes(spark: SparkSession, path: str, schema: str = CHANGE) -> DataFrame:
    """Change records as they are written below `path`."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
