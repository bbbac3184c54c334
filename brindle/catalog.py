"""The engine's queries on the driver's tables, each beside the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.ordering import SortSpec
from .functions.values import ABSENT, presence_counts
from .operators import changes, conflicts, relations
from .operators.attachments import ref_counts
from .plans.query import Query
from .sources.database import FieldSpec, RowSchema
from .streaming.live import coalesced, diff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str, name: str = ""):
    """Register a function of a table reader with its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: read(spark, sf_dir, t))
        SQL[key] = sql
        return f

    return add


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_flagship(t):
    q = Query(t("orders"), "o_orderkey").where({"o_orderstatus": "F"}).range("o_totalprice", 100000.0, 200000.0)
    return q.sort([SortSpec("o_totalprice", True)]).limit(20).find_all().select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(t):
    return Query(t("orders"), "o_orderkey").filter("o_orderstatus", "F").matching().select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def q_filter_range(t):
    return Query(t("orders"), "o_orderkey").range("o_totalprice", 100000.0, 200000.0).matching().select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def q_filter_prefix(t):
    return Query(t("part"), "p_partkey").prefix("p_name", "red").matching().select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20 AND starts_with(l_linestatus, 'F')")
def q_filter_and(t):
    q = Query(t("lineitem"), "l_orderkey").filter("l_returnflag", "R").range("l_quantity", 10.0, 20.0).prefix("l_linestatus", "F")
    return q.matching().select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE false")
def q_type_strict(t):
    """A whole number equals no double: the filter is constant and nothing is read."""
    return Query(t("orders"), "o_orderkey").filter("o_totalprice", 5).matching().select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL")
def q_range_by_rank(t):
    """Doubles rank above whole numbers, so a whole lower bound keeps all that aren't null."""
    return Query(t("orders"), "o_orderkey").range("o_totalprice", min=5).matching().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
def q_sort_limit(t):
    return Query(t("orders"), "o_orderkey").sort([SortSpec("o_totalprice", True)]).offset(5).limit(20).find_all().select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
def q_multi_sort(t):
    return Query(t("customer"), "c_custkey").sort([SortSpec("c_mktsegment"), SortSpec("c_acctbal", True)]).limit(50).find_all().select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def q_first(t):
    return Query(t("customer"), "c_custkey").sort([SortSpec("c_acctbal", True)]).limit(1).find_all().select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def q_key_order(t):
    return Query(t("orders"), "o_orderkey").limit(100).find_all().select("o_orderkey")


@query("SELECT c_name FROM customer ORDER BY strlen(c_name), c_name LIMIT 30")
def q_string_key_order(t):
    return Query(t("customer"), "c_name").limit(30).find_all().select("c_name")


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
def q_count(t):
    return Query(t("lineitem"), "l_orderkey").range("l_discount", 0.05, 0.07).matching().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def q_distinct(t):
    return Query(t("orders"), "o_orderkey").filter("o_orderstatus", "O").distinct("o_orderpriority")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 75) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def q_third_page(t):
    """The page after the 50th row, by a keyset condition on the whole sort tuple."""
    q = Query(t("orders"), "o_orderkey").sort([SortSpec("o_totalprice")])
    last = q.limit(50).find_all().collect()[-1]
    return Query(q.df.where(q.after(last)), "o_orderkey", specs=q.specs, size=25).find_all().select("o_orderkey", "o_totalprice")


@query("SELECT pos, c_custkey, c_name FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 999999999)) v(pos, id) JOIN customer ON c_custkey = id")
def q_multi_get(t):
    return relations.multi_get(t("customer"), "c_custkey", [7, 3, 7, 999999999]).select(F.col("_pos").alias("pos"), "c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17")
def q_point_get(t):
    return Query(t("orders"), "o_orderkey").filter("o_orderkey", 17).limit(1).find_all().select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 10 AND o_orderkey <= 500")
def q_key_range_scan(t):
    return relations.key_range(t("orders"), "o_orderkey", 10, 500, start_open=True).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def q_children(t):
    return relations.children(t("orders"), "o_custkey", 7).select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")
def q_parent(t):
    return relations.parent(t("customer"), "c_custkey", 7, "c_nationkey", t("nation"), "n_nationkey").select("n_nationkey", "n_name")


@query("SELECT c_custkey AS parent_id, count(o_orderkey) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q_load_all_children(t):
    out = relations.load_all_children(t("customer"), "c_custkey", t("orders"), "o_custkey", "o_orderkey", [])
    kids = F.col("children.o_orderkey")
    return out.select("parent_id", F.size("children").cast("bigint").alias("n"), F.array_min(kids).alias("lo"), F.array_max(kids).alias("hi"))


@query("SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey")
def q_group_by_fk(t):
    return relations.group_children(t("orders"), "o_custkey", F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_partkey = 5")
def q_m2n_right_ids(t):
    return relations.right_ids(t("lineitem"), "l_partkey", "l_suppkey", 5)


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey = 3")
def q_m2n_left_ids(t):
    return relations.right_ids(t("lineitem"), "l_suppkey", "l_partkey", 3)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_orphans(t):
    return relations.orphans(t("documents").select("doc_id"), "doc_id", t("labels"), "doc_id")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def q_join_cleanup(t):
    gone = t("supplier").where("s_acctbal < 0").select("s_suppkey")
    return relations.without_links(t("lineitem"), "l_suppkey", gone, "s_suppkey").select("l_orderkey", "l_partkey").distinct()


@query(
    """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n))
SELECT 'region' AS "table", '1' AS id, 'delete' AS action UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'delete' FROM n UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'delete' FROM c
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'delete' FROM o UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 'setNull:s_nationkey' FROM s"""
)
def q_cascade_plan(t):
    tables = {"region": (t("region"), "r_regionkey"), "nation": (t("nation"), "n_nationkey"), "customer": (t("customer"), "c_custkey"), "orders": (t("orders"), "o_orderkey"), "supplier": (t("supplier"), "s_suppkey")}
    made = relations.Relationship
    rules = [made("a", "region", "nation", "n_regionkey", "cascade"), made("b", "nation", "customer", "c_nationkey", "cascade"), made("c", "customer", "orders", "o_custkey", "cascade"), made("d", "nation", "supplier", "s_nationkey", "setNull")]
    return relations.delete_plan(tables, rules, "region", t("region").where("r_regionkey = 1").select(F.col("r_regionkey").alias("id")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q_latest_per_key(t):
    return relations.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def _log(t) -> DataFrame:
    """Events as a change log: event_id is the sequence number."""
    return t("events").select(F.col("event_id").alias("lsn"), F.lit(0).alias("ord"), F.col("event_type").alias("collection"), F.col("user_id").alias("record_id"), (F.col("event_id") % 3 == 0).alias("dirty"), F.when(F.col("event_id") % 5 == 0, "remoteSync").otherwise("local").alias("origin"), F.lit("put").alias("kind"), F.col("props").alias("value"))


LOG = "SELECT event_id AS lsn, event_type AS collection, user_id AS record_id, event_id % 3 = 0 AS dirty, CASE WHEN event_id % 5 = 0 THEN 'remoteSync' ELSE 'local' END AS origin, props AS value FROM events"


@query(f"SELECT lsn, collection, record_id FROM ({LOG}) WHERE lsn > 500")
def q_changes_since(t):
    return changes.changes_since(_log(t), 500).select("lsn", "collection", "record_id")


@query(f"SELECT lsn, collection, record_id FROM (SELECT *, row_number() OVER (PARTITION BY collection, record_id ORDER BY lsn DESC) AS r FROM ({LOG})) WHERE r = 1 AND dirty AND origin <> 'remoteSync'")
def q_pending(t):
    return changes.locally_changed(_log(t)).select("lsn", "collection", "record_id")


@query(f"SELECT lsn FROM ({LOG}) WHERE dirty OR lsn NOT IN (SELECT lsn FROM ({LOG}) WHERE NOT dirty ORDER BY lsn LIMIT (SELECT greatest(0, count(*) - 700) FROM events))")
def q_log_prune(t):
    return changes.pruned(_log(t), 700, ["lsn", "ord"]).select("lsn")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id || '/' || event_type ORDER BY event_id) AS r FROM events) WHERE r = 1 AND user_id || '/' || event_type NOT IN (SELECT user_id || '/' || event_type FROM events WHERE event_id < 50)")
def q_dedupe_first(t):
    keyed = t("events").withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return changes.first_unseen(keyed, "k", [F.asc("event_id")], keyed.where("event_id < 50").select("k")).select("event_id")


@query(f"SELECT lsn, collection, record_id, 'put' AS kind, value FROM ({LOG})")
def q_feed(t):
    """The change feed: a record for each (sequence, collection, key)."""
    return coalesced(_log(t))


def _versions(t) -> DataFrame:
    """Base, local and remote versions of orders by arithmetic on their keys."""
    k, p, s = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    return t("orders").select(
        k.alias("id"), p.alias("bp"), s.alias("bs"), F.when(k % 2 == 0, p + 1).otherwise(p).alias("lp"), F.when(k % 3 == 0, F.lit("X")).otherwise(s).alias("ls"),
        F.when(k % 5 == 0, p + 2).otherwise(p).alias("rp"), F.when(k % 7 == 0, F.lit("Y")).otherwise(s).alias("rs"), (k % 4).alias("lseq"), (k % 6).alias("rseq"),
    )


VERSIONS = """SELECT o_orderkey AS id, o_totalprice AS bp, o_orderstatus AS bs, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS lp, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS ls,
CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS rp, CASE WHEN o_orderkey % 7 = 0 THEN 'Y' ELSE o_orderstatus END AS rs, o_orderkey % 4 AS lseq, o_orderkey % 6 AS rseq FROM orders"""


@query(f"SELECT id, CASE WHEN rseq >= lseq THEN rp ELSE lp END AS price, CASE WHEN rseq >= lseq THEN rs ELSE ls END AS status FROM ({VERSIONS})")
def q_lww_merge(t):
    v = _versions(t)
    pick = lambda a, b: conflicts.lww_column(F.col(a), F.col(b), F.col("lseq"), F.col("rseq"))
    return v.select("id", pick("lp", "rp").alias("price"), pick("ls", "rs").alias("status"))


@query(f"SELECT id, CASE WHEN id % 3 <> 0 THEN rp ELSE lp END AS price FROM ({VERSIONS})")
def q_field_merge(t):
    v = _versions(t)
    return v.select("id", conflicts.merge_column(F.col("lp"), F.col("rp"), F.lit(True), F.col("id") % 3 != 0).alias("price"))


@query(f"SELECT id, CASE WHEN rp <> bp THEN rp ELSE lp END AS price, CASE WHEN rs <> bs THEN rs ELSE ls END AS status FROM ({VERSIONS})")
def q_three_way_merge(t):
    v = _versions(t)
    pick = lambda x: conflicts.three_way_column(F.col("b" + x), F.col("l" + x), F.col("r" + x))
    return v.select("id", pick("p").alias("price"), pick("s").alias("status"))


def _old_new(t) -> tuple[DataFrame, DataFrame]:
    c = t("customer").select("c_custkey", "c_acctbal")
    return c.where("c_custkey % 10 <> 0"), c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))


OLD_NEW = "o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0)"
DIFF = "SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'updated' END AS change FROM {a} a FULL JOIN {b} b USING (c_custkey) WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal <> b.c_acctbal"


@query(f"WITH {OLD_NEW} {DIFF.format(a='o', b='n')}")
def q_live_diff(t):
    return diff(*_old_new(t), "c_custkey", ["c_acctbal"])


@query(f"WITH {OLD_NEW}, x AS (SELECT * FROM o ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5), y AS (SELECT * FROM n ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5) {DIFF.format(a='x', b='y')}")
def q_window_diff(t):
    old, new = (Query(d, "c_custkey").sort([SortSpec("c_acctbal", True)]).offset(5).limit(20).find_all() for d in _old_new(t))
    return diff(old, new, "c_custkey", ["c_acctbal"])


def _sparse(t) -> DataFrame:
    """Events whose value is missing for every fourth row and null for every sixth."""
    gone = F.col("event_id") % 4 == 0
    return t("events").select("event_id", F.when(~gone & (F.col("event_id") % 6 != 0), F.col("value")).alias("value"), F.when(gone, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")).alias(ABSENT))


SPARSE = "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 6 <> 0 THEN value END AS value, event_id % 4 = 0 AS gone FROM events"


@query(f"SELECT event_id FROM ({SPARSE}) WHERE value IS NULL AND NOT gone")
def q_eq_null(t):
    return Query(_sparse(t), "event_id").filter("value", None).matching().select("event_id")


@query(f"SELECT event_id FROM ({SPARSE}) WHERE NOT gone AND (value IS NULL OR value <= 20)")
def q_range_keeps_null(t):
    return Query(_sparse(t), "event_id").range("value", max=20.0).matching().select("event_id")


@query(f"SELECT event_id, row_number() OVER (ORDER BY gone DESC, value DESC NULLS LAST, event_id) AS pos FROM ({SPARSE}) ORDER BY pos LIMIT 60")
def q_missing_order(t):
    """Missing fields come first in a descending sort, nulls last."""
    q = Query(_sparse(t), "event_id").sort([SortSpec("value", True)]).limit(60)
    from .functions.ordering import order_by

    top = q.find_all()
    return top.select("event_id", F.row_number().over(Window.orderBy(*order_by(top, q.specs, "event_id"))).cast("bigint").alias("pos"))


@query(f"SELECT event_id, CASE WHEN gone THEN -1.0 ELSE value END AS value FROM ({SPARSE})")
def q_defaults_missing(t):
    schema = RowSchema([FieldSpec("value", "double", default=-1.0, has_default=True)])
    return schema.fill_frame(_sparse(t)).select("event_id", "value")


@query("SELECT count(DISTINCT event_id) FILTER (event_id % 4 <> 0) AS present, count(*) FILTER (event_id % 4 = 0) AS missing FROM events")
def q_presence_counts(t):
    return presence_counts(_sparse(t), "value")


@query("SELECT md5(text) AS content, count(*) AS refs FROM documents GROUP BY 1")
def q_refcounts(t):
    return ref_counts(t("documents").select(F.md5("text").alias("content")), "content")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1') INTERSECT SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000")
def q_multi_index(t):
    """What an intersection of index scans gives: one conjunctive scan."""
    return Query(t("orders"), "o_orderkey").filter("o_orderstatus", "F").prefix("o_orderpriority", "1").range("o_totalprice", min=150000.0).matching().select("o_orderkey")



from . import stored as _stored  # noqa: E402, F401  registers the queries that write
