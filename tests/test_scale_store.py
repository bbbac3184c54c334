"""Many commits, several writers, crashes, overlays, live results by key, pages under a limit."""

import threading

import pytest
from pyspark.sql import functions as F

from brindle.errors import AlreadyOpen, CommitConflict
from brindle.functions.ordering import SortSpec
from brindle.operators import changes
from brindle.operators.conflicts import Version, three_way_presence
from brindle.operators.deletes import Links
from brindle.operators.review import Conflicts
from brindle.plans.query import Query
from brindle.sources import database
from brindle.sources.database import FOLD, Database
from brindle.streaming.live import LiveQuery, live_count, watch_children, watch_join_ids


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


@pytest.fixture
def users(db):
    return db.collection("users", "id", "id string, name string, age bigint")


def test_segments_grow_with_the_logarithm(db, users):
    for i in range(40):
        users.bulk_write([{"id": f"k{i % 7}", "age": i}])
    m = db.log.manifest()
    assert len(m["tables"]["users"]["segments"]) < 2 * FOLD and len(m["changes"]) < 2 * FOLD
    assert {r["_key"]: r["age"] for r in users.frame().collect()} == {f"k{i % 7}": i for i in range(33, 40)}
    assert db.changes().count() == 40 and users.get("k4")["age"] == 39


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    both = [Database(spark, path) for _ in range(2)]
    tables = [d.collection("c", "id", "id string, a bigint, b bigint") for d in both]
    tables[0].put({"id": "k", "a": 0, "b": 0})

    def write(table, name):
        for i in range(1, 4):
            table.put({"id": "k", name: i})

    threads = [threading.Thread(target=write, args=x) for x in zip(tables, "ab", strict=True)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert tables[0].get("k") == {"id": "k", "a": 3, "b": 3} and both[0].lsn() == 7


def test_marking_keeps_what_was_committed_meanwhile(db, users, monkeypatch):
    users.put({"id": "a"})
    sync, whole, once = changes.Sync(db), db.changes, []

    def late(*args, **kwargs):
        out = whole(*args, **kwargs)
        if not once:
            once.append(users.put({"id": "b"}))
        return out

    monkeypatch.setattr(db, "changes", late)
    sync.synced(["a"])
    monkeypatch.undo()
    assert {(r["record_id"], r["dirty"]) for r in db.changes().collect()} == {("a", False), ("b", True)}


def test_marks_of_many_records(db, spark):
    """Thousands of pairs; ids that repeat, are unknown or of another collection neither add nor change records."""
    n = 3000
    for name in "ab":
        db.collection(name, "id", "id bigint").merge(spark.range(n))
    db.collections["b"].clear()
    db.collections["b"].merge(spark.range(5))
    before = db.changes().count()
    changes.Sync(db).failed([*(("a", i) for i in range(n) if i % 3 == 0), ("a", 0), ("c", 1), ("a", n), "4", 4], "net")
    log = db.changes()
    marked = log.where("phase = 'failed'")
    assert log.count() == before == 2 * n + 6 and marked.where("collection = 'a'").count() == n // 3 + 1
    assert [(r["record_id"], r["retries"]) for r in marked.where("collection = 'b'").collect()] == [("4", 1)] * 2
    assert marked.where("retries <> 1 or error <> 'net'").count() == 0 and log.where("record_id is null").count() == 1
    changes.Sync(db).synced([])
    assert db.changes().where("dirty").count() == before


def test_marks_by_a_frame(db, spark):
    """Frames of plain ids and of pairs, with ids that repeat; a frame of the log itself."""
    for name in "ab":
        db.collection(name, "id", "id bigint").merge(spark.range(4))
    sync = changes.Sync(db)
    ids = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("a", None)], "collection string, record_id bigint")
    sync.failed(ids, "net")
    sync.synced(ids.drop("collection").where("record_id > 1"))
    sync.synchronizing(db.changes().where("phase = 'synced'"))
    found = {(r["collection"], r["record_id"]): (r["phase"], r["retries"], r["dirty"]) for r in db.changes().collect()}
    new, gone = ("pending", 0, True), ("synchronizing", 0, False)
    assert found == {("a", "0"): new, ("a", "1"): ("failed", 1, True), ("a", "2"): gone, ("a", "3"): gone, ("b", "0"): new, ("b", "1"): new, ("b", "2"): ("synchronizing", 1, False), ("b", "3"): gone}
    assert db.changes().count() == 8


def test_sync_states_over_many_suppliers(spark, tmp_path):
    """A thousand suppliers are told apart as the SQL of the query does."""
    from brindle.catalog import QUERIES

    rows = spark.range(1000).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "1 AS s_nationkey", "0.5D AS s_acctbal")
    rows.write.parquet(f"file://{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"file://{tmp_path}/nation.parquet")
    found = {r["record_id"]: (r["phase"], r["retries"]) for r in QUERIES["q_sync_states"](spark, str(tmp_path)).collect()}
    assert found == {str(i): ("failed", 1) if i % 3 == 0 else ("pending", 0) for i in range(1, 1000, 2)}


def test_optimistic_transactions_conflict(db, users):
    users.put({"id": "a", "age": 1})
    slow = db.transaction(optimistic=True)
    slow.get("users", "a")
    users.put({"id": "a", "age": 2})
    slow.put("users", {"id": "a", "age": 9})
    with pytest.raises(CommitConflict):
        slow.commit()
    assert users.get("a")["age"] == 2


def test_overlay(db, users):
    users.bulk_write([{"id": "a", "age": 1}, {"id": "b", "age": 2}])
    with db.transaction() as t:
        t.put("users", {"id": "c", "age": 3})
        assert t.delete("users", "a") and not t.delete("users", "z")
        assert t.get_many("users", ["c", "a", "b"]) == [{"id": "c", "age": 3}, {"id": "b", "age": 2}]
        assert sorted(r["_key"] for r in t.get_all("users").collect()) == ["b", "c"]
        assert [r["_key"] for r in t.where("users", {"age": 1}).find_all().collect()] == ["a"]
    assert users.delete("b") and not users.delete("b")


def test_double_open_and_crashed_compaction(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/db"
    first = Database(spark, path, exclusive=True)
    with pytest.raises(AlreadyOpen):
        Database(spark, path, exclusive=True)
    c = first.collection("c", "id", "id int")
    c.bulk_write([{"id": i} for i in range(5)])
    monkeypatch.setattr(first.log, "commit", lambda m: (_ for _ in ()).throw(OSError("killed")))
    monkeypatch.setattr(first.log, "unmark", lambda name: None)
    with pytest.raises(OSError):
        first.compact()
    assert first.state == "failed"
    first.close()
    second = Database(spark, path, exclusive=True)
    assert second.state == "recovering" and second.recover() and second.state == "idle"
    assert second.collection("c", "id", "id int").frame().count() == 5
    second.compact()
    assert second.state == "committed" and second.stats()["bytes"] > 0
    second.close()


def test_layout_and_slow_operations(db, users, monkeypatch):
    monkeypatch.setattr(database, "SLOW_SECONDS", -1.0)
    users.bulk_write([{"id": f"u{i}", "name": f"n{i % 3}", "age": i} for i in range(30)])
    users.declare("name", "age")
    db.compact()
    segment = db.log.manifest()["tables"]["users"]["segments"]
    assert [s["layout"] for s in segment] == [["name", "age"]]
    assert users.where({"name": "n1"}).range("age", 5, 20).count() == 5
    assert {x["what"] for x in db.slow} == {"commit", "compact"} and len(db.slow) <= database.SLOW_KEPT


def test_pruning_moves_the_watermark(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", keep_changes=10)
    c = db.collection("c", "id", "id string")
    sync = changes.Sync(db)
    for i in range(6):
        sync.apply_remote([{"collection": "c", "kind": "put", "record_id": f"{i}-{k}", "value": {"id": f"{i}-{k}"}} for k in range(3)])
    c.put({"id": "mine"})
    sync.prune(4)
    left = db.changes().collect()
    assert len(left) == 4 and "mine" in {r["record_id"] for r in left} and db.watermark() == 5
    for i in range(20):
        sync.apply_remote([{"collection": "c", "kind": "put", "record_id": f"x{i}", "value": {"id": f"x{i}"}}])
    assert db.changes().count() < 10 + FOLD and db.watermark() > 5


def test_nth(spark):
    values = [5, 5, 7, 1, 10**12, -3, 7, 7, 2]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    for n in range(1, 10):
        top, below = changes.nth(df, "x", n)
        assert top == sorted(values)[n - 1] and below == sum(v < top for v in values)


def test_live_results_by_key(db):
    c = db.collection("c", "id", "id string, v bigint")
    c.bulk_write([{"id": x, "v": k} for k, x in enumerate("abcdef")])
    got = []
    live = LiveQuery(c, lambda q: q.range("v", min=3), lambda lsn, d, w: got.append((sorted(map(tuple, d.collect())), w.count())))
    top = LiveQuery(c, lambda q: q.range("v", min=3).sort([SortSpec("v")]).limit(1), lambda *x: None)
    live.start()
    top.start()
    assert live_count(db) == 2
    c.put({"id": "a", "v": 9})
    c.put({"id": "b", "v": 2})
    c.delete("f")
    c.clear()
    assert got == [([("a", "added")], 4), ([], 4), ([("f", "removed")], 3), ([(x, "removed") for x in "ade"], 0)]
    assert live.counters == {"keys": 3, "windows": 0, "whole": 1, "skipped": 0} and top.counters["skipped"] == 1
    live.stop()
    top.stop()
    assert live_count(db) == 0


def test_relation_watches(db):
    a, b = db.collection("a", "id", "id string"), db.collection("b", "id", "id string, aId string")
    links = Links(db, "l", "a", "b")
    kids, ids = [], []
    stops = [watch_children(a, b, "aId", "1", lambda d: kids.append(d.count())), watch_join_ids(links, [a, b], "1", lambda d: ids.append(d.count()))]
    a.put({"id": "1"})
    b.put({"id": "x", "aId": "1"})
    links.add("1", "x")
    for stop in stops:
        stop()
    b.put({"id": "y", "aId": "1"})
    assert kids == [0, 0, 1] and ids == [0, 0, 0, 1]


def test_pages_respect_the_limit(spark):
    q = Query(spark.range(10).withColumnRenamed("id", "_key")).limit(5)
    seen, at, sizes = [], None, []
    while not sizes or at is not None:
        rows, at = q.find_page(at, 2)
        seen += [r["_key"] for r in rows]
        sizes.append(len(rows))
    assert seen == [0, 1, 2, 3, 4] and sizes == [2, 2, 1]
    assert Query.last_plan()["limit"] == 5


def test_local_versions_and_removed_fields(db, users, spark):
    users.put({"id": "a", "name": "x"})
    review = Conflicts(db)
    assert review.local_version("users", "a") == Version({"id": "a", "name": "x"}, False, 1)
    assert review.local_version("users", "z").deleted
    here, gone, null = (F.lit(1), F.lit(True)), (F.lit(None).cast("int"), F.lit(False)), (F.lit(None).cast("int"), F.lit(True))
    for base, local, remote, want in ((here, here, gone, (None, False)), (here, gone, here, (None, False)), (here, null, here, (None, True)), (gone, here, gone, (1, True))):
        value, there = three_way_presence(base, local, remote)
        assert tuple(spark.range(1).select(value, there).first()) == want


def test_listeners_are_told_without_the_lock(db, users):
    seen = []

    def told(change):
        other = threading.Thread(target=lambda: seen.append(db._lock.acquire(timeout=5) and (db._lock.release() or change.lsn)))
        other.start()
        other.join()
        if change.lsn == 1:
            users.put({"id": "nested"})

    db.listeners.append(told)
    users.put({"id": "a"})
    users.bulk_write([{"id": "b"}])
    assert seen == [1, 2, 3]
