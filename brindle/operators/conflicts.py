"""Conflict resolution between a local and a remote version, on Python dicts and on frames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConflictError


@dataclass(frozen=True)
class Version:
    value: dict | object
    deleted: bool = False
    sequence: int | None = None
    version: object = None


def last_write_wins(local: Version, remote: Version, base: Version | None = None) -> Version:
    """The later of two by sequence, else by whole-number or time versions; ties and unknowns go to the remote."""
    for a, b in ((local.sequence, remote.sequence), (local.version, remote.version)):
        if a is not None and b is not None and type(a) is type(b) and isinstance(a, (int, dt.datetime)):
            return remote if b >= a else local
    return remote


def field_merge(local: Version, remote: Version, base: Version | None = None) -> Version:
    """All fields of both, the remote's where both have one; a delete on either side deletes."""
    if local.deleted or remote.deleted:
        return Version(None, True, remote.sequence, remote.version)
    if not isinstance(local.value, dict) or not isinstance(remote.value, dict):
        return last_write_wins(local, remote)
    return Version({**local.value, **remote.value}, False, remote.sequence, remote.version)


_GONE = object()


def three_way_merge(local: Version, remote: Version, base: Version | None = None) -> Version:
    """Per field: the side that changed it, the remote if both did; removing a field is a change."""
    if base is None or not all(isinstance(x.value, dict) for x in (local, remote, base)) or local.deleted or remote.deleted:
        return field_merge(local, remote)
    out = {}
    for name in dict.fromkeys((*base.value, *local.value, *remote.value)):
        old, mine, theirs = (x.value.get(name, _GONE) for x in (base, local, remote))
        pick = theirs if theirs is not old and theirs != old else mine
        if pick is not _GONE:
            out[name] = pick
    return Version(out, False, remote.sequence, remote.version)


class Resolvers:
    """Resolvers by name; the last one registered under a name counts."""

    DEFAULTS: dict[str, Callable] = {"lastWriteWins": last_write_wins, "fieldLevelMerge": field_merge, "threeWayMerge": three_way_merge}

    def __init__(self) -> None:
        self.known = dict(self.DEFAULTS)

    def register(self, name: str, resolver: Callable) -> None:
        if not name:
            raise ConflictError("a resolver needs a name")
        self.known[name] = resolver

    def restore_defaults(self) -> None:
        self.known = dict(self.DEFAULTS)

    def resolve(self, name: str, local: Version, remote: Version, base: Version | None = None) -> Version:
        if name not in self.known:
            raise ConflictError(f"no resolver {name}")
        return self.known[name](local, remote, base)


def remote_wins(local_seq: Column, remote_seq: Column, local_version: Column | None = None, remote_version: Column | None = None) -> Column:
    """Whether the remote is the later one: by sequence, else by versions of one type, else it wins."""
    versions = F.lit(None).cast("boolean") if local_version is None or remote_version is None else remote_version >= local_version
    return F.coalesce(remote_seq >= local_seq, versions, F.lit(True))


def lww_column(local: Column, remote: Column, local_seq: Column, remote_seq: Column, local_version: Column | None = None, remote_version: Column | None = None) -> Column:
    """Last write wins for one column of joined versions."""
    return F.when(remote_wins(local_seq, remote_seq, local_version, remote_version), remote).otherwise(local)


def merge_column(local: Column, remote: Column, local_there: Column, remote_there: Column) -> Column:
    """Field-level merge of one column by presence."""
    return F.when(remote_there, remote).when(local_there, local)


def three_way_column(base: Column, local: Column, remote: Column) -> Column:
    """Three-way merge of one column: the remote where it changed, else the local."""
    return F.when(~remote.eqNullSafe(base), remote).otherwise(local)


def three_way_presence(base: tuple[Column, Column], local: tuple[Column, Column], remote: tuple[Column, Column]) -> tuple[Column, Column]:
    """Three-way merge of one field that may be missing, as (value, there): removing it is a change like any other."""
    changed = (remote[1] != base[1]) | (remote[1] & ~remote[0].eqNullSafe(base[0]))
    there = F.when(changed, remote[1]).otherwise(local[1])
    return F.when(there, F.when(changed, remote[0]).otherwise(local[0])), there
