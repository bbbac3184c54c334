"""Times the headline queries and the store's own operations at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from brindle.catalog import QUERIES
from brindle.functions.ordering import SortSpec
from brindle.plans.query import Query
from brindle.session import session
from brindle.sources.database import Database
from brindle.streaming.live import LiveQuery

HEADLINE = [
    "q_flagship", "q_filter_eq", "q_filter_range", "q_filter_prefix", "q_filter_and", "q_sort_limit", "q_multi_sort", "q_count", "q_distinct", "q_load_all_children",
    "q_cascade_plan", "q_latest_per_key", "q_live_diff", "q_log_prune", "q_multi_index",
]


def best(run: Callable[[], object], times: int = 3) -> float:
    """Seconds of the fastest run; the first one also compiles code and opens files."""
    took = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return round(min(took), 4)


def store(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, float]:
    """Single records, batches, pages, snapshots and live results on a collection of all orders, compacted once."""
    db = Database(spark, f"file://{folder}/db", keep_changes=1 << 40)
    orders = db.collection("orders", "o_orderkey", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*orders.kind.names)
    out = {"store_merge_all": best(lambda: orders.merge(rows), 1)}
    orders.declare("o_orderstatus", "o_totalprice")
    out["store_compact"] = best(lambda: db.compact("orders"), 1)
    out["store_get"] = best(lambda: orders.get(17))
    out["store_put"] = best(lambda: orders.put({"o_orderkey": 17, "o_totalprice": 1.0}))
    out["store_bulk_500"] = best(lambda: orders.bulk_write([{"o_orderkey": k, "o_custkey": 1, "o_orderstatus": "F", "o_totalprice": 2.0} for k in range(500)]))
    out["store_index_scan"] = best(lambda: orders.query().filter("o_orderstatus", "F").range("o_totalprice", 150000.0, 160000.0).count())
    out["store_page_50"] = best(lambda: orders.query().sort([SortSpec("o_totalprice", True)]).find_page(None, 50))
    pinned = db.snapshot()
    out["store_snapshot_count"] = best(lambda: Query(orders.frame(pinned)).count())
    seen: list[int] = []
    live = LiveQuery(orders, lambda q: q.range("o_totalprice", min=400000.0), lambda lsn, change, result: seen.append(len(change.collect())))
    live.start()
    out["store_put_with_live_query"] = best(lambda: orders.put({"o_orderkey": 18, "o_totalprice": 500000.0 + len(seen)}))
    live.stop()
    for k in range(30):
        orders.bulk_write([{"o_orderkey": k, "o_custkey": k}])
    out["store_get_after_30_commits"] = best(lambda: orders.get(17))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        times[name] = best(lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    value = round(sum(times.values()), 3)
    folder = tempfile.mkdtemp()
    try:
        times |= store(spark, sf_dir, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, best of 3 each, summed; store operations beside them", "value": value, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
