"""Relationships as joins, and deletes that follow them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOperation, RelationshipViolation
from ..functions.predicates import Eq

BROADCAST_IDS = 100_000
SALTS = 16
BEHAVIOURS = ("cascade", "restrict", "setNull", "none", "applicationControlled")


@dataclass(frozen=True)
class Relationship:
    name: str
    parent: str
    child: str
    foreign_key: str = ""
    on_delete: str = "none"

    @property
    def field(self) -> str:
        return self.foreign_key or f"{self.parent}Id"


def children(child: DataFrame, field: str, parent_id: object) -> DataFrame:
    """Rows whose foreign key is the parent's id."""
    return child.where(Eq(field, parent_id).column(child))


def parent(child: DataFrame, child_key: str, child_id: object, field: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """The parent of one child: no row if the child, its foreign key or the parent is absent."""
    one = child.where(Eq(child_key, child_id).column(child)).select(F.col(field).alias("_fk"))
    return parents.join(one, parents[parent_key] == one["_fk"], "left_semi")


def load_all_children(ids: DataFrame, id_column: str, child: DataFrame, field: str, key: str, columns: list[str]) -> DataFrame:
    """A row for each distinct non-null id, with its children in key order; none is an empty array.

    Children carry the asked columns only and are gathered in SALTS parts of each parent before its parts meet, so a
    parent with very many children is dealt over several tasks until its one array is made.
    """
    wanted = ids.select(F.col(id_column).alias("parent_id")).where("parent_id is not null").distinct()
    item = F.struct(F.col(key), *(F.col(c) for c in columns if c != key)).alias("_item")
    rows = child.where(F.col(field).isNotNull()).select(F.col(field).alias("_parent"), item, F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("_salt"))
    parts = rows.groupBy("_parent", "_salt").agg(F.collect_list("_item").alias("_part"))
    lists = parts.groupBy("_parent").agg(F.sort_array(F.flatten(F.collect_list("_part"))).alias("children"))
    none = F.array().cast(lists.schema["children"].dataType)
    return wanted.join(lists, F.col("parent_id") == F.col("_parent"), "left").select("parent_id", F.coalesce("children", none).alias("children"))


def group_children(child: DataFrame, field: str, *aggregates: Column) -> DataFrame:
    """Aggregates of the children of each parent; children without a parent's id don't count."""
    return child.where(F.col(field).isNotNull()).groupBy(field).agg(*aggregates)


def without_links(links: DataFrame, side: str, gone: DataFrame, key: str) -> DataFrame:
    """What is left of a many-to-many table when the records of `gone` are deleted."""
    return links.join(gone.select(F.col(key).alias("_gone")), F.col(side) == F.col("_gone"), "left_anti")


def right_ids(links: DataFrame, left: str, right: str, value: object) -> DataFrame:
    """The other side's ids in a many-to-many table."""
    return links.where(Eq(left, value).column(links)).select(F.col(right).alias("id")).distinct()


def multi_get(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows by id in the order asked for: absent ids are skipped, repeated ones repeat.

    A list of up to BROADCAST_IDS ids is broadcast and also filters the scan; a longer one is left to the join's own choice.
    """
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"_pos int, _id {df.schema[key].dataType.simpleString()}")
    if len(ids) <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, df[key] == wanted["_id"]).orderBy("_pos").drop("_id")


def key_range(df: DataFrame, key: str, start: object = None, end: object = None, start_open: bool = False, end_open: bool = False) -> DataFrame:
    """Rows whose key lies between the bounds; inverted bounds give none."""
    k, keep = F.col(key), F.lit(True)
    if start is not None:
        keep = keep & (k > start if start_open else k >= start)
    if end is not None:
        keep = keep & (k < end if end_open else k <= end)
    return df.where(keep)


def orphans(df: DataFrame, field: str, parents: DataFrame | None, key: str) -> DataFrame:
    """Rows without a parent row; without a parent table all of them."""
    return df if parents is None else df.join(parents.select(F.col(key).alias("_parent")), F.col(field) == F.col("_parent"), "left_anti")


def check_cycles(relations: list[Relationship], new: Relationship) -> None:
    """An error if cascades would come back to a collection, itself included."""
    if new.on_delete not in BEHAVIOURS:
        raise InvalidOperation(f"unknown delete behaviour {new.on_delete}")
    edges: dict[str, set[str]] = {}
    for r in (*relations, new):
        if r.on_delete == "cascade":
            edges.setdefault(r.parent, set()).add(r.child)
    path: set[str] = set()

    def visit(at: str) -> None:
        if at in path:
            raise InvalidOperation(f"cascades from {at} come back to it")
        path.add(at)
        for x in edges.get(at, ()):
            visit(x)
        path.discard(at)

    visit(new.parent)


def delete_plan(tables: dict[str, tuple[DataFrame, str]], relations: list[Relationship], table: str, ids: DataFrame, hooks: dict | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(table, id, action) for all that a delete of `ids` (column id) leads to: a frontier of semi-joins per level.

    `tables` maps names to (frame, key).  Restricted children raise before anything is planned.  Ids are strings
    in the result, as tables' keys may differ in type.  `keep` holds a frontier that further relationships start
    from, so that none is computed twice; by default in the executors' memory and on their disks.
    """
    keep = keep or DataFrame.persist
    onward = {r.parent for r in relations if r.on_delete != "none" and r.child in tables}
    out: DataFrame | None = None
    frontier = [(table, ids.select("id").distinct())]
    while frontier:
        name, gone = frontier.pop(0)
        part = gone.select(F.lit(name).alias("table"), F.col("id").cast("string").alias("id"), F.lit("delete").alias("action"))
        out = part if out is None else out.unionAll(part)
        for r in relations:
            if r.parent != name or r.on_delete == "none" or r.child not in tables:
                continue
            frame, key = tables[r.child]
            hit = frame.join(gone.select(F.col("id").alias("_gone")), F.col(r.field) == F.col("_gone"), "left_semi").select(F.col(key).alias("id"))
            if r.on_delete == "restrict":
                first = hit.first()
                if first is not None:
                    raise RelationshipViolation(f"{r.child} {first['id']} depends on {name}")
            elif r.on_delete == "cascade":
                hit = hit.distinct()
                frontier.append((r.child, keep(hit) if r.child in onward else hit))
            elif r.on_delete == "setNull":
                out = out.unionAll(hit.select(F.lit(r.child), F.col("id").cast("string"), F.lit(f"setNull:{r.field}")))
            else:
                hook = (hooks or {}).get(r.name)
                if hook is None:
                    raise InvalidOperation(f"{r.name} needs an application hook")
                out = out.unionAll(hook(hit))
    return out.distinct()


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`: the newest version, or the first of repeated records."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
