"""Commits, snapshots, transactions, sync, attachments, migrations and live queries on a small database."""

import pytest
from pyspark.sql import functions as F

from brindle.errors import AttachmentError, CommitConflict, InvalidOperation, KeyExists, KeyNotFound, MigrationError, ReadOnly, SchemaValidation, UpgradeRequired
from brindle.functions.ordering import SortSpec
from brindle.operators import changes
from brindle.operators.attachments import Attachments
from brindle.operators.migrations import Migrations, Step
from brindle.sources.database import Database, FieldSpec, RowSchema
from brindle.streaming.live import LiveQuery, stream_changes


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


@pytest.fixture
def users(db):
    return db.collection("users", "id", "id string, name string, age bigint")


def test_put_merges_and_bulk_replaces(db, users):
    users.put({"id": "a", "name": "Ann", "age": 3})
    users.put({"id": "a", "age": 4})
    assert users.get("a") == {"id": "a", "name": "Ann", "age": 4}
    users.bulk_write([{"id": "a", "age": 5}, {"id": "b", "name": None}])
    assert users.get("a") == {"id": "a", "age": 5}
    assert users.get("b") == {"id": "b", "name": None}
    assert users.bulk_write() == 0
    assert [r["_key"] for r in users.where({"name": None}).find_all().collect()] == ["b"]
    users.delete("a")
    assert users.get("a") is None and users.get_many(["b", "x", "b"]) == [users.get("b")] * 2


def test_modes_patch_and_errors(db, users):
    users.put({"id": "a"}, "insertOnly")
    with pytest.raises(KeyExists):
        users.put({"id": "a"}, "insertOnly")
    with pytest.raises(KeyNotFound):
        users.put({"id": "z"}, "updateOnly")
    with pytest.raises(KeyNotFound):
        users.patch("z", {"age": 1})
    with pytest.raises(SchemaValidation):
        users.put({"id": "a", "other": 1})
    users.patch("a", {"age": 1})
    last = changes.changes_since(db.changes(), 0).collect()[-1]
    assert last["changed"] == ["age"] and last["previous"] == '{"id": "a"}'
    with pytest.raises(InvalidOperation):
        db.collection("__brindle_x", "id", "id string")


def test_schema_defaults(db):
    c = db.collection("d", "id", "id string, a string, b string", RowSchema([FieldSpec("a", "string", True), FieldSpec("b", "string", default="x", has_default=True)]))
    with pytest.raises(SchemaValidation):
        c.put({"id": "1"})
    c.put({"id": "1", "a": "y"})
    c.put({"id": "2", "a": "y", "b": None})
    assert c.get("1")["b"] == "x" and c.get("2")["b"] is None


def test_snapshots_compaction_vacuum(db, users):
    users.put({"id": "a", "age": 1})
    pinned = db.snapshot()
    users.put({"id": "a", "age": 2})
    users.put({"id": "b"})
    db.compact()
    db.vacuum()
    assert users.get("a", pinned)["age"] == 1 and users.frame(pinned).count() == 1
    assert users.get("a")["age"] == 2 and users.get("b") == {"id": "b"}
    db.release(pinned)
    assert db.vacuum()
    assert users.frame().count() == 2


def test_transactions(db, users):
    with pytest.raises(ZeroDivisionError), db.transaction() as t:
        t.put("users", {"id": "a"})
        raise ZeroDivisionError
    assert db.lsn() == 0
    with db.transaction() as t:
        t.put("users", {"id": "a", "age": 1})
        t.patch("users", "a", {"age": 2})
        assert t.get("users", "a")["age"] == 2 and users.get("a") is None
    assert db.lsn() == 1 and users.get("a")["age"] == 2
    with pytest.raises(InvalidOperation):
        t.get("users", "a")


def test_commit_is_exclusive(db, users):
    users.put({"id": "a"})
    with pytest.raises(CommitConflict):
        db.log.commit(db.log.manifest())
    assert users.get("a") == {"id": "a"}
    with pytest.raises(ReadOnly):
        Database(db.spark, db.log.path, read_only=True).transaction()


def test_crash_before_commit_leaves_nothing(db, users, monkeypatch):
    users.put({"id": "a"})
    monkeypatch.setattr(db.log, "commit", lambda m: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        users.put({"id": "b"})
    monkeypatch.undo()
    assert users.frame().count() == 1 and db.vacuum() and users.frame().count() == 1


def test_merge_frame_and_ranges(db, users, spark):
    users.bulk_write([{"id": "a", "name": "x", "age": 1}, {"id": "b", "age": 2}])
    users.merge(spark.createDataFrame([("a", 9), ("c", 3)], "id string, age bigint"))
    assert users.get("a") == {"id": "a", "name": "x", "age": 9} and users.get("c") == {"id": "c", "age": 3}
    assert users.delete_range("a", "b") == 2 and users.frame().count() == 1
    users.clear()
    assert users.frame().count() == 0 and db.tables() == ["users"]


def test_sync(db, users):
    users.put({"id": "a"})
    users.put({"id": "b"})
    sync = changes.Sync(db)
    sync.synced(["a"])
    sync.failed([("users", "b")], "net")
    left = changes.locally_changed(db.changes()).collect()
    assert [(r["record_id"], r["retries"], r["phase"]) for r in left] == [("b", 1, "failed")]
    remote = [{"collection": "users", "kind": "put", "record_id": "c", "value": {"id": "c"}, "idempotency_key": "k"}] * 2
    assert sync.apply_remote(remote) == ["c"] and sync.apply_remote(remote) == []
    sync.prune(1)
    assert [r["record_id"] for r in db.changes().collect()] == ["b"]


def test_attachments(db):
    db.collection("parents", "id", "id string").put({"id": "p"})
    files = Attachments(db)
    a = files.create("parents", "p", "f", "abc")
    files.create("parents", "p", "g", "abc")
    with pytest.raises(AttachmentError):
        files.create("parents", "q", "f", "abc")
    assert files.ref_counts().first()["refs"] == 2
    files.set_state(a["id"], "failed")
    assert files.failed().first()["retryCount"] == 1 and files.pending().count() == 1
    db.collections["parents"].delete("p")
    assert files.orphaned().count() == 2


def test_migrations(db, users):
    users.put({"id": "a", "age": 1})
    m = Migrations(db)
    plan = [Step(0, 1), Step(1, 2, users, lambda d: d.withColumn("age", F.col("age") + 1))]
    assert m.migrate(plan) == (2, 2) and users.get("a")["age"] == 2 and m.migrate(plan) == (0, 2)
    with pytest.raises(UpgradeRequired):
        Database(db.spark, db.log.path, schema_version=1)
    with pytest.raises(MigrationError):
        m.step(Step(2, 3, users, lambda d: d.withColumn("x", F.col("nowhere"))))
    assert m.version() == 2


def test_live_window(db):
    items = db.collection("items", "id", "id string, n bigint")
    items.bulk_write([{"id": "a", "n": 10}, {"id": "b", "n": 20}, {"id": "c", "n": 30}])
    seen = []
    live = LiveQuery(items, lambda q: q.sort([SortSpec("n")]).limit(2), lambda lsn, d, w: seen.append((sorted((r[0], r[1]) for r in d.collect()), [r["_key"] for r in w.collect()])))
    assert [r["_key"] for r in live.start().collect()] == ["a", "b"]
    items.put({"id": "c", "n": 5})
    assert seen == [([("b", "removed"), ("c", "added")], ["c", "a"])]
    items.put({"id": "c", "n": 5})
    assert seen[-1] == ([], ["c", "a"])
    live.stop()
    items.put({"id": "d", "n": 1})
    assert len(seen) == 2


def test_change_stream(db, users, tmp_path):
    users.put({"id": "a"})
    users.put({"id": "b"})
    got = []
    q = stream_changes(db.spark, f"{db.log.path}/data/changes-*").writeStream.foreachBatch(lambda d, _: got.extend(r["record_id"] for r in d.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(got) == ["a", "b"]
