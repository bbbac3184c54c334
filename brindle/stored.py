"""Queries that write to a database of their own and read back: commits, transactions, sync, deletes, live results.

Each has the same question in DuckDB's SQL.  A database lies in the session's shared folder and goes with the process.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .functions.ordering import SortSpec
from .functions.values import MIXED
from .operators import changes
from .operators.attachments import Attachments
from .operators.conflicts import Version
from .operators.deletes import Links, Relations
from .operators.migrations import Migrations, Step
from .operators.relations import Relationship
from .operators.review import Conflicts
from .plans.query import Query
from .sources.database import Collection, Database, FieldSpec, RowSchema
from .sources.scratch import fresh_dir
from .streaming.feed import Subscription
from .streaming.live import LiveQuery

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
CUSTOMERS = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double"
NATIONS = "n_nationkey int, n_name string, n_regionkey int"
SUPPLIERS = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"


def stored(sql: str):
    """Register a function of a new database and a table reader with its SQL."""

    def add(f: Callable[[Database, Callable[[str], DataFrame]], DataFrame]):
        def run(t):
            spark = t("nation").sparkSession
            return f(Database(spark, fresh_dir(spark, "db")), t)

        return query(sql, f.__name__)(run)

    return add


def fill(db: Database, name: str, fields: str, rows: DataFrame, schema: RowSchema | None = None) -> Collection:
    """A collection of these rows; the first field is the key."""
    made = db.collection(name, fields.split()[0], fields, schema)
    made.merge(rows.select(*(x.split()[0] for x in fields.split(", "))))
    return made


def listed(db: Database, rows: list[tuple], fields: str) -> DataFrame:
    return db.spark.createDataFrame(rows, fields)


@stored("SELECT c_custkey, CASE WHEN o.k IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal, c_name FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON k = c_custkey")
def q_upsert_merge(db, t):
    """A delta frame without all columns merged over a collection: what it doesn't name stays."""
    customers = fill(db, "customers", CUSTOMERS, t("customer"))
    counts = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customers.merge(t("customer").join(counts, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", (F.col("c_acctbal") + F.col("n")).alias("c_acctbal")))
    return customers.frame().select("c_custkey", "c_acctbal", "c_name")


@stored("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'three' WHEN 5 THEN NULL ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (3, 5) THEN -1 ELSE n_regionkey END AS n_regionkey, n_nationkey IN (3, 5) AS gone FROM nation WHERE n_nationkey NOT IN (7, 8)")
def q_bulk_write(db, t):
    """Whole rows replace records, so fields that they lack are missing, and keys are deleted, in one commit."""
    nations = fill(db, "nations", NATIONS, t("nation"))
    nations.bulk_write([{"n_nationkey": 3, "n_name": "three"}, {"n_nationkey": 5, "n_name": None}], [7, 8])
    return nations.frame().select("n_nationkey", "n_name", F.coalesce("n_regionkey", F.lit(-1)).alias("n_regionkey"), F.array_contains("_absent", "n_regionkey").alias("gone"))


@stored("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'patched' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 100, 'new', -1")
def q_transaction_reads_its_writes(db, t):
    """All rows as a transaction sees them before it commits; it is rolled back afterwards."""
    nations = fill(db, "nations", NATIONS, t("nation"))
    work = db.transaction()
    work.patch(nations.name, 1, {"n_name": "patched"})
    work.put(nations.name, {"n_nationkey": 100, "n_name": "new"})
    work.delete(nations.name, 2)
    seen = work.get_all(nations.name).select("n_nationkey", "n_name", F.coalesce("n_regionkey", F.lit(-1)).alias("n_regionkey"))
    work.rollback()
    return seen


@stored("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'put' WHEN n_nationkey = 6 THEN 'patched' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 9")
def q_put_patch_delete(db, t):
    nations = fill(db, "nations", NATIONS, t("nation"))
    nations.put({"n_nationkey": 4, "n_name": "put"})
    nations.patch(6, {"n_name": "patched"})
    nations.delete(9)
    nations.delete(99)
    return nations.frame().select("n_nationkey", "n_name", "n_regionkey")


@stored("SELECT 'pinned' AS state, count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS dear FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'now', count(*), sum(o_totalprice > 100000 AND o_orderkey % 2 = 1)::BIGINT FROM orders")
def q_snapshot_read(db, t):
    """A pinned snapshot keeps its rows while later commits, a compaction and a vacuum go on."""
    orders = fill(db, "orders", ORDERS, t("orders").where("o_orderkey % 2 = 0"))
    pinned = db.snapshot()
    orders.merge(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("o_totalprice")))
    db.compact()
    db.vacuum()
    count = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("dear")]
    return orders.frame(pinned).agg(*count).select(F.lit("pinned").alias("state"), "*").unionAll(orders.frame().agg(*count).select(F.lit("now"), "*"))


@stored("SELECT o_orderkey FROM orders WHERE o_orderkey < 100 OR o_orderkey > 400")
def q_delete_range(db, t):
    orders = fill(db, "orders", ORDERS, t("orders"))
    orders.delete_range(100, 400)
    return orders.frame().select("o_orderkey")


@stored("SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey < 2")
def q_clear(db, t):
    regions = fill(db, "regions", "id int, name string", t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    regions.clear()
    regions.merge(t("region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return regions.frame().select("id", "name")


@stored("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 150000 AND 250000 AND o_orderkey % 10 <> 0")
def q_index_scan(db, t):
    """A base laid out by the declared fields, newer rows over it, filtered by equality and range."""
    orders = fill(db, "orders", ORDERS, t("orders"))
    orders.declare("o_orderstatus", "o_totalprice")
    db.compact("orders")
    orders.merge(t("orders").where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("gone").alias("o_orderstatus")))
    return orders.query().filter("o_orderstatus", "F").range("o_totalprice", 150000.0, 250000.0).matching().select("o_orderkey", "o_totalprice")


@stored("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 10")
def q_index_scan_window(db, t):
    orders = fill(db, "orders", ORDERS, t("orders"))
    orders.declare("o_orderstatus", "o_totalprice")
    db.compact("orders")
    return orders.query().filter("o_orderstatus", "O").sort([SortSpec("o_totalprice", True)]).offset(10).limit(30).find_all().select("o_orderkey", "o_totalprice")


@stored("SELECT n_nationkey AS id, n_name || '-' || (19 - (19 - n_nationkey) % 5)::VARCHAR AS name FROM nation WHERE n_nationkey < 5")
def q_many_commits(db, t):
    """Twenty commits to five records: segments are folded, the newest versions count."""
    names = {r["n_nationkey"]: r["n_name"] for r in t("nation").collect()}
    c = db.collection("c", "id", "id int, name string")
    for i in range(20):
        c.bulk_write([{"id": i % 5, "name": f"{names[i % 5]}-{i}"}])
    return c.frame().select("id", "name")


@stored("SELECT 'put' AS kind, false AS replaced, count(*) AS n FROM orders UNION ALL SELECT 'put', true, count(*) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'delete', true, count(*) FROM orders WHERE o_orderkey BETWEEN 50 AND 150")
def q_change_log(db, t):
    """Distributed writes and range deletes are logged like single ones, with what they replaced."""
    db.keep_changes = 1 << 40
    orders = fill(db, "orders", ORDERS, t("orders"))
    orders.merge(t("orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")))
    orders.delete_range(50, 150)
    log = changes.changes_since(db.changes(), 0)
    return log.groupBy("kind", F.col("previous").isNotNull().alias("replaced")).agg(F.count(F.lit(1)).alias("n"))


@stored("SELECT s_suppkey::VARCHAR AS record_id, CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'pending' END AS phase, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS retries FROM supplier WHERE s_suppkey % 2 <> 0")
def q_sync_states(db, t):
    suppliers = fill(db, "suppliers", SUPPLIERS, t("supplier"))
    ids = t("supplier").select(F.lit(suppliers.name).alias("collection"), F.col("s_suppkey").alias("record_id"))
    sync = changes.Sync(db)
    sync.synchronizing(ids.drop("collection").limit(1))
    sync.failed(ids.where("record_id % 3 = 0"), "no network")
    sync.synced(ids.drop("collection").where("record_id % 2 = 0"))
    return changes.locally_changed(db.changes()).select("record_id", F.when(F.col("phase") == "synchronizing", "pending").otherwise(F.col("phase")).alias("phase"), "retries")


@stored("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'remote' ELSE n_name END AS n_name, n_nationkey < 3 AS clean FROM nation WHERE n_nationkey <> 10")
def q_apply_remote(db, t):
    """Remote records count once for each idempotency key, also over batches, and are logged clean."""
    nations = fill(db, "nations", NATIONS, t("nation"))
    sync = changes.Sync(db)
    batch = [{"collection": "nations", "kind": "put", "record_id": k, "value": {"n_nationkey": k, "n_name": "remote"}, "idempotency_key": f"k{k}", "remote_version": k} for k in range(3)]
    again = [{**r, "value": {"n_nationkey": r["record_id"], "n_name": "again"}} for r in batch]
    sync.apply_remote([*batch, *again, {"collection": "nations", "kind": "delete", "record_id": 10, "idempotency_key": "k10"}])
    sync.apply_remote(again)
    state = changes.sync_state(db.changes()).select(F.col("record_id").cast("int").alias("id"), (~F.col("dirty")).alias("clean"))
    return nations.frame().join(state, F.col("n_nationkey") == F.col("id")).select("n_nationkey", "n_name", "clean")


@stored("SELECT n_nationkey, n_nationkey IN (1, 2) AS seen, CASE WHEN n_nationkey = 1 THEN 17 ELSE -1 END AS version FROM nation WHERE n_nationkey NOT IN (5, 6)")
def q_remote_deletion(db, t):
    """Remote deletions by plain ids; duplicates and remote versions by lookup."""
    nations = fill(db, "nations", NATIONS, t("nation"))
    sync = changes.Sync(db)
    sync.apply_remote([{"collection": "nations", "kind": "put", "record_id": k, "value": {"n_nationkey": k}, "idempotency_key": f"k{k}"} for k in (1, 2)])
    sync.set_remote_version("nations", 1, 17)
    sync.apply_remote_deletion([5, "6", 777])
    told = [(r["n_nationkey"], sync.is_duplicate(f"k{r['n_nationkey']}"), sync.remote_version("nations", r["n_nationkey"])) for r in nations.frame().where("n_nationkey < 3").collect()]
    known = listed(db, told, "id int, seen boolean, version int")
    return nations.frame().join(known, F.col("n_nationkey") == F.col("id"), "left").select("n_nationkey", F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce("version", F.lit(-1)).alias("version"))


@stored("SELECT record_id FROM (SELECT s_suppkey::VARCHAR AS record_id, row_number() OVER (ORDER BY s_suppkey % 4 = 0 DESC, s_suppkey DESC) AS r FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 4 = 0) WHERE r <= greatest(40, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0))")
def q_prune_log(db, t):
    """The oldest clean records go until forty are left; what awaits synchronising never goes."""
    db.keep_changes = 1 << 40
    suppliers = fill(db, "suppliers", SUPPLIERS, t("supplier"))
    sync = changes.Sync(db)
    sync.synced(t("supplier").where("s_suppkey % 4 <> 0").select(F.lit(suppliers.name).alias("collection"), F.col("s_suppkey").alias("record_id")))
    sync._replace(lambda log: log.withColumn("ord", F.col("record_id").cast("bigint")))
    sync.prune(40)
    return db.changes().select("record_id")


@stored(
    """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n))
SELECT 'regions' AS name, count(*) AS n, 0::BIGINT AS nulls FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nations', count(*), 0 FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT 'customers', count(*), 0 FROM customer WHERE c_custkey NOT IN (SELECT * FROM c) UNION ALL SELECT 'orders', count(*), 0 FROM orders WHERE o_custkey NOT IN (SELECT * FROM c)
UNION ALL SELECT 'suppliers', count(*), sum(s_nationkey IN (SELECT * FROM n))::BIGINT FROM supplier"""
)
def q_cascade_delete(db, t):
    """One commit deletes a region, its nations, their customers and orders, and sets suppliers' nations to null."""
    made = {"regions": fill(db, "regions", "r_regionkey int, r_name string", t("region")), "nations": fill(db, "nations", NATIONS, t("nation")), "customers": fill(db, "customers", CUSTOMERS, t("customer")), "orders": fill(db, "orders", ORDERS, t("orders")), "suppliers": fill(db, "suppliers", SUPPLIERS, t("supplier"))}
    rules = Relations(db)
    for parent, child, key, then in (("regions", "nations", "n_regionkey", "cascade"), ("nations", "customers", "c_nationkey", "cascade"), ("customers", "orders", "o_custkey", "cascade"), ("nations", "suppliers", "s_nationkey", "setNull")):
        rules.declare(Relationship(f"{parent}-{child}", parent, child, key, then))
    rules.delete("regions", 1)
    out = None
    for name, c in made.items():
        null = F.count_if(F.col("s_nationkey").isNull()) if name == "suppliers" else F.lit(0).cast("bigint")
        part = c.frame().agg(F.count(F.lit(1)).alias("n"), null.alias("nulls")).select(F.lit(name).alias("name"), "n", "nulls")
        out = part if out is None else out.unionAll(part)
    return out


@stored("SELECT DISTINCT l_partkey AS left_id, l_suppkey AS right_id FROM lineitem WHERE l_partkey <= 20 AND l_partkey <> 7 AND l_suppkey <> 3 UNION SELECT 1, 9999")
def q_links(db, t):
    """A many-to-many table: added twice is added once; links go with either of their ends."""
    parts = fill(db, "parts", "p_partkey bigint, p_name string", t("part"))
    suppliers = fill(db, "suppliers", SUPPLIERS, t("supplier"))
    links = Links(db, "made_by", parts.name, suppliers.name)
    pairs = t("lineitem").where("l_partkey <= 20").select(F.col("l_partkey").cast("string").alias("left"), F.col("l_suppkey").cast("string").alias("right"))
    links.add_all(pairs)
    links.add_all(pairs.where("left = '1'"))
    links.add(1, 9999)
    links.add(1, 9998)
    links.remove(1, 9998)
    rules = Relations(db)
    rules.delete(parts.name, 7)
    rules.delete(suppliers.name, 3)
    return links.frame().select(F.col("left").cast("bigint").alias("left_id"), F.col("right").cast("bigint").alias("right_id"))


@stored("SELECT 1 AS step, n_nationkey::INT AS id, 'added' AS change FROM nation WHERE n_nationkey = 90 UNION ALL SELECT 1, 90, 'added' UNION ALL SELECT 2, 3, 'updated' UNION ALL SELECT 3, 1, 'removed' UNION ALL SELECT 3, 24, 'added' UNION ALL SELECT 5, 90, 'removed'")
def q_live_apply(db, t):
    """What each commit did to a live result: added, updated and removed keys; a commit beside it or without effect gives none."""
    nations = db.collection("nations", "id", "id int, name string, region int")
    nations.bulk_write([{"id": r["n_nationkey"], "name": r["n_name"], "region": 1 if r["n_nationkey"] < 20 else 2} for r in t("nation").collect()])
    got = []
    live = LiveQuery(nations, lambda q: q.filter("region", 1), lambda lsn, change, result: got.extend((lsn, r["_key"], r["change"]) for r in change.collect()))
    live.start()
    base = db.lsn()
    nations.bulk_write([{"id": 90, "name": "new", "region": 1}])
    nations.put({"id": 3, "name": "three"})
    nations.bulk_write([{"id": 1, "region": 2}, {"id": 24, "region": 1}])
    nations.put({"id": 23, "name": "beside"})
    nations.delete(90)
    nations.put({"id": 3, "name": "three"})
    live.stop()
    return listed(db, [(lsn - base, k, c) for lsn, k, c in got], "step int, id int, change string")


@stored(
    """WITH o AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier), n AS (SELECT id, CASE WHEN id = 5 THEN 1e9 ELSE v END AS v FROM o WHERE id <> 4 UNION ALL SELECT 1000000, 2e9),
x AS (SELECT * FROM o ORDER BY v DESC, id LIMIT 5 OFFSET 1), y AS (SELECT * FROM n ORDER BY v DESC, id LIMIT 5 OFFSET 1)
SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM x FULL JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.v <> y.v"""
)
def q_live_window(db, t):
    """Three commits in one turn, told once to a listener that wants the latest state of a window."""
    c = db.collection("c", "id", "id bigint, v double")
    c.merge(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")))
    got = []
    live = LiveQuery(c, lambda q: q.sort([SortSpec("v", True)]).offset(1).limit(5), lambda lsn, change, result: got.append([(r["_key"], r["change"]) for r in change.collect()]), latest=True)
    live.start()
    with db.turn():
        c.put({"id": 5, "v": 1e9})
        c.delete(4)
        c.put({"id": 1_000_000, "v": 2e9})
    return listed(db, got[0] if len(got) == 1 else [], "id bigint, change string")


@stored("SELECT * FROM (VALUES (1, 'a', '1', 'put'), (1, 'a', '2', 'put'), (2, 'a', '1', 'delete'), (2, 'b', '9', 'put'), (3, 'b', NULL, 'delete')) v(step, name, id, kind)")
def q_change_sets(db, t):
    """One change set a commit: the last kind of each key, at the place of its first."""
    for name in ("a", "b"):
        db.collection(name, "id", "id string, v string")
    sub = Subscription(db)
    with db.transaction() as w:
        w.put("a", {"id": "1", "v": "x"})
        w.put("a", {"id": "2", "v": "x"})
    with db.transaction() as w:
        w.put("a", {"id": "1", "v": "y"})
        w.put("b", {"id": "9", "v": "y"})
        w.delete("a", "1")
    db.collections["b"].clear()
    rows = []
    while told := sub.poll():
        rows += [(told.lsn, name, key, kind) for name, key, kind in told.changes]
    return listed(db, rows, "step int, name string, id string, kind string")


@stored("SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer")
def q_migrate(db, t):
    """Two of three steps rewrite rows; running the plan again does nothing."""
    customers = fill(db, "customers", CUSTOMERS, t("customer"))
    plan = [Step(0, 1), Step(1, 2, customers, lambda d: d.withColumn("c_name", F.upper("c_name"))), Step(2, 3, customers, lambda d: d.withColumn("c_acctbal", F.col("c_acctbal") + 1))]
    work = Migrations(db)
    work.migrate(plan)
    work.migrate(plan)
    return customers.frame().select("c_custkey", "c_name", "c_acctbal")


@stored("SELECT * FROM (VALUES ('pending', 1, 0), ('failed', 1, 2), ('completed', 1, 0), ('orphaned', 2, 2), ('shared', 2, 0)) v(what, n, retries)")
def q_attachments(db, t):
    """States, retries, orphans and shared content of attachments."""
    fill(db, "docs", "id string, lang string", t("documents").where("doc_id < 3").select(F.col("doc_id").cast("string").alias("id"), "lang"))
    files = Attachments(db)
    made = [files.create("docs", str(k % 2), f"f{k}", f"hash{k // 2}")["id"] for k in range(3)]
    files.set_state(made[1], "failed")
    files.set_state(made[1], "failed")
    files.set_state(made[2], "completed")
    db.collections["docs"].delete("0")
    left = files.orphaned().agg(F.count(F.lit(1)), F.sum("retryCount")).first()
    rows = [(name, f.count(), f.agg(F.coalesce(F.sum("retryCount"), F.lit(0))).first()[0]) for name, f in (("pending", files.pending()), ("failed", files.failed()), ("completed", files.completed()))]
    return listed(db, [*rows, ("orphaned", left[0], left[1] + 2), ("shared", files.blob_ref_count("hash0"), 0)], "what string, n int, retries int")


@stored("SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'theirs' WHEN 2 THEN 'mine' WHEN 3 THEN 'merged' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 4")
def q_resolve_conflicts(db, t):
    """Conflicts decided against the record as it stands: a later and an earlier remote, a three-way merge, a delete."""
    nations = fill(db, "nations", NATIONS, t("nation"))
    review = Conflicts(db)
    nations.patch(2, {"n_name": "mine"})
    rows = {r["n_nationkey"]: {k: r[k] for k in ("n_nationkey", "n_name", "n_regionkey")} for r in nations.frame().collect()}
    review.resolve_remote("nations", 1, Version({**rows[1], "n_name": "theirs"}, sequence=1 << 40))
    review.resolve_remote("nations", 2, Version({**rows[2], "n_name": "theirs"}, sequence=0))
    nations.patch(3, {"n_name": "merged"})
    review.resolve_remote("nations", 3, Version({**rows[3], "n_regionkey": 99}), Version(rows[3]), "threeWayMerge")
    review.resolve_remote("nations", 4, Version(None, True), resolver="fieldLevelMerge")
    return nations.frame().select("n_nationkey", "n_name", "n_regionkey")


@stored("SELECT (pos // 4)::INT AS page, n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) - 1 AS pos FROM nation) WHERE pos < 10")
def q_pages(db, t):
    """All pages of a query with a limit, each by the row that the last one ended with."""
    q = Query(t("nation"), "n_nationkey").sort([SortSpec("n_regionkey", True)]).limit(10)
    rows, at, page = [], None, 0
    while page == 0 or at is not None:
        found, at = q.find_page(at, 4)
        rows += [(page, r["n_nationkey"]) for r in found]
        page += 1
    return listed(db, rows, "page int, n_nationkey int")


@stored("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation")
def q_schema_defaults(db, t):
    """Missing fields get their defaults when rows are put, nulls never do."""
    schema = RowSchema([FieldSpec("n_name", "string", required=True), FieldSpec("n_regionkey", "int", default=-1, has_default=True)])
    nations = db.collection("nations", "n_nationkey", NATIONS, schema)
    with db.transaction() as w:
        for r in t("nation").collect():
            w.put("nations", {"n_nationkey": r["n_nationkey"], "n_name": r["n_name"], **({"n_regionkey": r["n_regionkey"]} if r["n_nationkey"] % 2 else {})})
    return nations.frame().select("n_nationkey", "n_name", "n_regionkey")


@stored("SELECT s_suppkey AS id, s_suppkey % 4 AS kind FROM supplier WHERE s_suppkey % 4 = 1 OR (s_suppkey % 4 = 0 AND s_suppkey <= 40)")
def q_mixed_kinds(db, t):
    """Whole numbers, doubles, texts and nulls in one field: an upper bound keeps numbers up to it and nulls, not other kinds."""
    c = db.collection("c", "id", f"id bigint, n {MIXED}")
    kinds = [int, lambda i: None, float, str]
    c.bulk_write([{"id": r["s_suppkey"], "n": kinds[r["s_suppkey"] % 4](r["s_suppkey"])} for r in t("supplier").select("s_suppkey").collect()])
    return c.query().range("n", max=40).matching().select("id", (F.col("id") % 4).alias("kind"))
