"""Schema versions and migrations: additive steps bump the version, rewriting steps rebuild a collection's rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MigrationError
from ..functions.values import ABSENT
from ..sources.database import Collection, Database


@dataclass(frozen=True)
class Step:
    """`upgrade` maps a collection's frame to its new frame, in Spark's own expressions; none: an additive step."""

    from_version: int
    to_version: int
    collection: Collection | None = None
    upgrade: Callable[[DataFrame], DataFrame] | None = None


class Migrations:
    def __init__(self, db: Database):
        self.db = db

    def version(self) -> int:
        return self.db.log.manifest()["meta"].get("schema_version", 0)

    def stamp(self, version: int) -> None:
        if version != self.version():
            self.db.commit({}, meta={"schema_version": version})

    def requires_upgrade(self, version: int) -> bool:
        return self.version() < version

    def step(self, step: Step) -> None:
        """One step, in one commit with its version."""
        writes = {}
        try:
            if step.upgrade:
                c = step.collection
                rows = step.upgrade(c.frame()).withColumns({"_op": F.lit("put"), "_ord": F.lit(0)})
                fields = [f for f in rows.schema.fields if f.name not in (ABSENT, "_op", "_ord")]
                writes[c.name] = (T.StructType([*(f for f in fields if f.name == "_key"), *(f for f in fields if f.name != "_key")]), rows)
            self.db.commit(writes, meta={"schema_version": step.to_version})
        except Exception as e:
            raise MigrationError(f"step {step.from_version} to {step.to_version}") from e

    def migrate(self, plan: list[Step]) -> tuple[int, int]:
        """Run the steps that start at the present version, in their order; (applied, reached)."""
        applied = 0
        for s in plan:
            if s.from_version == self.version():
                self.step(s)
                applied += 1
        return applied, self.version()
