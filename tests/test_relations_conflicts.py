"""Relations, delete plans and conflict resolution."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.errors import ConflictError, InvalidOperation, RelationshipViolation
from brindle.operators import relations as r
from brindle.operators.conflicts import Resolvers, Version, field_merge, last_write_wins, three_way_merge


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([("p1", "a1", "T1"), ("p2", "a1", "T2"), ("p3", "a2", "T3"), ("p4", None, "T4")], "id string, authorId string, title string")


def test_lookups(spark, posts):
    authors = spark.createDataFrame([("a1", "A"), ("a2", "B"), ("a3", "C")], "id string, name string")
    assert [x["title"] for x in r.children(posts, "authorId", "a1").orderBy("id").collect()] == ["T1", "T2"]
    assert r.parent(posts, "id", "p1", "authorId", authors, "id").first()["name"] == "A"
    assert r.parent(posts, "id", "p4", "authorId", authors, "id").first() is None
    got = {x["parent_id"]: [c["title"] for c in x["children"]] for x in r.load_all_children(authors, "id", posts, "authorId", "id", ["title"]).collect()}
    assert got == {"a1": ["T1", "T2"], "a2": ["T3"], "a3": []}
    assert [x["id"] for x in r.multi_get(authors, "id", ["a2", "zz", "a2"]).collect()] == ["a2", "a2"]
    assert r.key_range(authors, "id", "a3", "a1").count() == 0


def test_delete_plans(spark, posts):
    ids = spark.createDataFrame([("a1",)], "id string")
    tables = {"posts": (posts, "id")}
    cascade = [r.Relationship("x", "author", "posts", on_delete="cascade")]
    plan = {(x["table"], x["id"], x["action"]) for x in r.delete_plan(tables, cascade, "author", ids).collect()}
    assert plan == {("author", "a1", "delete"), ("posts", "p1", "delete"), ("posts", "p2", "delete")}
    with pytest.raises(RelationshipViolation):
        r.delete_plan(tables, [r.Relationship("x", "author", "posts", on_delete="restrict")], "author", ids)
    with pytest.raises(InvalidOperation):
        r.delete_plan(tables, [r.Relationship("x", "author", "posts", on_delete="applicationControlled")], "author", ids)
    hooked = r.delete_plan(tables, [r.Relationship("x", "author", "posts", on_delete="applicationControlled")], "author", ids, {"x": lambda hit: hit.select(F.lit("posts"), "id", F.lit("keep"))})
    assert hooked.where("action = 'keep'").count() == 2


def test_cycles():
    a, b = r.Relationship("ab", "a", "b", on_delete="cascade"), r.Relationship("ba", "b", "a", on_delete="cascade")
    r.check_cycles([], a)
    for known, new in (([a], b), ([], r.Relationship("aa", "a", "a", on_delete="cascade"))):
        with pytest.raises(InvalidOperation):
            r.check_cycles(known, new)


def test_conflicts():
    v = Version
    assert last_write_wins(v(1, sequence=2), v(2, sequence=2)).value == 2
    assert last_write_wins(v(1, sequence=3), v(2, sequence=2)).value == 1
    assert last_write_wins(v(1, version=dt.datetime(2026, 1, 2)), v(2, version=dt.datetime(2026, 1, 1))).value == 1
    assert field_merge(v({"a": 1, "b": 1}), v({"b": 2})).value == {"a": 1, "b": 2}
    assert field_merge(v({"a": 1}, deleted=True), v({"b": 2})).deleted
    base = v({"a": 1, "b": 1, "c": 1, "d": 1})
    got = three_way_merge(v({"a": 2, "b": 1, "c": 5, "d": 1}), v({"a": 1, "b": 3, "c": 6}), base)
    assert got.value == {"a": 2, "b": 3, "c": 6}
    known = Resolvers()
    known.register("mine", lambda a, b, c: a)
    assert known.resolve("mine", v(1), v(2)).value == 1
    known.restore_defaults()
    with pytest.raises(ConflictError):
        known.resolve("mine", v(1), v(2))
