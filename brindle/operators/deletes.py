"""Deletes that follow relationships, and many-to-many links, on a database: one atomic commit each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ABSENT
from ..sources.database import RESERVED, Collection, Database, json_of
from ..sources.scratch import kept
from .relations import Relationship, check_cycles, delete_plan, right_ids


class Relations:
    """The declared relationships of a database."""

    def __init__(self, db: Database):
        self.db, self.declared = db, {}

    def declare(self, relation: Relationship) -> Relationship:
        check_cycles([r for r in self.declared.values() if r.name != relation.name], relation)
        self.declared[relation.name] = relation
        return relation

    def delete(self, table: str, key: object, hooks: dict | None = None) -> int:
        """Delete a record and all that its relationships say, links included, in one commit.

        Rows are found by joins and written as tombstones, or as rows whose foreign key is an explicit null; nothing
        is collected.  Of links, those of the deleted record itself go, not those of records that a cascade deletes.
        """
        db = self.db
        manifest = db.log.manifest()
        frames = {name: (c.frame(manifest=manifest), "_key") for name, c in db.collections.items() if not name.startswith(RESERVED)}
        start = db.spark.createDataFrame([(key,)], T.StructType([T.StructField("id", db.collections[table].kind[db.collections[table].key].dataType)]))
        plan = kept(delete_plan(frames, [*self.declared.values()], table, start, hooks, kept))
        writes, records = {}, []
        for name in sorted(r["table"] for r in plan.select("table").distinct().collect()):
            c, (frame, _) = db.collections[name], frames[name]
            acts = plan.where(F.col("table") == name).groupBy(F.col("id").alias("_id")).agg(F.collect_set("action").alias("_acts"))
            known = [f.name for f in c.kind.fields if f.name in frame.columns]
            rows = frame.withColumn("_previous", json_of(frame, known)).join(acts, frame["_key"].cast("string") == acts["_id"])
            for f in c.kind.fields:
                hit = F.array_contains("_acts", f"setNull:{f.name}")
                rows = rows.withColumn(f.name, F.when(hit, F.lit(None).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")))
                rows = rows.withColumn(ABSENT, F.when(hit, F.array_remove(ABSENT, f.name)).otherwise(F.col(ABSENT)))
            rows = rows.withColumns({"_op": F.when(F.array_contains("_acts", "delete"), "delete").otherwise("put"), "_ord": F.lit(0)})
            kind = T.StructType([T.StructField("_key", frame.schema["_key"].dataType), *c.kind.fields])
            records.append(db.records_of(c, rows, F.col("_op"), F.col("_previous")))
            writes[name] = (kind, rows.select("_key", *(f"`{f.name}`" for f in c.kind.fields), ABSENT, "_op", "_ord"))
        for c in db.collections.values():
            if isinstance(c, Links) and table in (c.left, c.right):
                side = "left" if table == c.left else "right"
                gone = c.frame(manifest=manifest).where(F.col(side) == F.lit(str(key)))
                records.append(db.records_of(c, gone, F.lit("delete"), json_of(gone, c.kind.names)))
                writes[c.name] = (c.stored(), gone.withColumns({"_op": F.lit("delete"), "_ord": F.lit(0)}))
        log = reduce(DataFrame.unionAll, records).withColumn("ord", F.monotonically_increasing_id()) if records else ()
        return db.commit(writes, log, expect=manifest["lsn"])


class Links(Collection):
    """A many-to-many table between two collections; adding twice is adding once."""

    def __init__(self, db: Database, name: str, left: str, right: str):
        super().__init__(db, name, "id", T.StructType.fromDDL("id string, left string, right string"))
        self.left, self.right = left, right
        db.collections[name] = self

    def _id(self, left: object, right: object) -> str:
        return f"{len(str(left))}:{left}:{right}"

    def add(self, left: object, right: object) -> int:
        return self.bulk_write([{"id": self._id(left, right), "left": str(left), "right": str(right)}])

    def add_all(self, pairs: DataFrame) -> int:
        """Add all pairs of a frame (left, right), distributed; repeated ones count once."""
        left, right = F.col("left").cast("string"), F.col("right").cast("string")
        key = F.concat_ws(":", F.length(left).cast("string"), left, right)
        return self.merge(pairs.select(key.alias("id"), left.alias("left"), right.alias("right")).dropDuplicates(["id"]))

    def remove(self, left: object, right: object) -> int:
        return self.bulk_write(deletes=[self._id(left, right)])

    def right_ids(self, left: object) -> DataFrame:
        return right_ids(self.frame(), "left", "right", str(left))

    def left_ids(self, right: object) -> DataFrame:
        return right_ids(self.frame(), "right", "left", str(right))
