"""The golden rows and the edges of filters, sorts, windows, pages and cursors."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brindle.errors import InvalidOperation, SchemaValidation
from brindle.functions.ordering import SortSpec
from brindle.functions.values import Big, kind_of
from brindle.plans.query import Query

#: Key, name, age, nick; None is a missing nick.
GOLDEN = [("r0", "ada", 36, "g3"), ("r1", "bob", 20, "g1"), ("r2", "carol", 30, None), ("r3", "dan", 5, "g4"), ("r4", "eve", 60, "g9"), ("r5", "ann", 10, "g0"), ("r6", "amy", 42, "g2"), ("r7", "aaron", 15, "g5"), ("r8", "beatrice", 25, "g6"), ("r9", "brad", 0, "g7")]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(k, n, a, x, [] if x else ["nick"]) for k, n, a, x in GOLDEN]
    return Query(spark.createDataFrame(rows, "_key string, name string, age bigint, nick string, _absent array<string>").cache())


def keys(q):
    return " ".join(r["_key"] for r in q.find_all().collect())


def test_golden_predicates(golden):
    assert keys(golden.filter("nick", "g3")) == "r0"
    assert keys(golden.range("age", 10, 19)) == "r5 r7"
    assert keys(golden.range("age", min=40)) == "r4 r6"
    assert keys(golden.prefix("name", "a")) == "r0 r5 r6 r7"
    assert keys(golden) == "r0 r1 r2 r3 r4 r5 r6 r7 r8 r9"


def test_golden_sorts(golden):
    age, nick = SortSpec("age"), SortSpec("nick", True)
    assert keys(golden.sort([age])) == "r9 r3 r5 r7 r1 r8 r2 r0 r6 r4"
    assert keys(golden.sort([SortSpec("age", True)])) == "r4 r6 r0 r2 r8 r1 r7 r5 r3 r9"
    assert keys(golden.sort([age, nick])) == "r9 r3 r5 r7 r1 r8 r2 r0 r6 r4"
    assert keys(golden.sort([nick])) == "r2 r4 r9 r8 r7 r3 r0 r6 r1 r5"


def test_missing_is_not_null(golden):
    assert keys(golden.filter("nick", None)) == ""
    assert keys(golden.range("nick", max="g1")) == "r1 r5"
    assert keys(golden.filter("nowhere", None)) == ""


def test_strict_types(golden):
    assert keys(golden.filter("age", 5.0)) == keys(golden.filter("age", Big(5))) == keys(golden.range("age", min=1.5)) == ""
    assert len(keys(golden.range("age", max=1.5)).split()) == 10
    assert keys(golden.filter("age", 5)) == "r3"
    assert keys(golden.filter("age", 36).filter("age", 20)) == ""
    with pytest.raises(SchemaValidation):
        kind_of(object())


def test_windows_pages_cursors(golden):
    q = golden.sort([SortSpec("nick", True)])
    whole = keys(q).split()
    assert keys(q.offset(3).limit(2)).split() == whole[3:5]
    assert keys(q.limit(0)) == keys(q.offset(99)) == ""
    assert q.limit(1).count() == 10
    seen, at = [], None
    while True:
        rows, at = q.find_page(at, 3)
        seen += [r["_key"] for r in rows]
        if at is None:
            break
    assert seen == whole
    assert len(q.find_page(None, 0)[0]) == 1
    cursor, seen = q.cursor(4), []
    while (page := cursor.next())[0]:
        seen += [r["_key"] for r in page[0]]
    assert seen == whole and cursor.next() == ([], None)
    cursor.dispose()
    with pytest.raises(InvalidOperation):
        cursor.next()


def test_key_orders(spark):
    words = spark.createDataFrame([(x,) for x in ("u10", "u9", "é", "z", "")], "_key string")
    assert [r[0] for r in Query(words).find_all().collect()] == ["", "z", "u9", "é", "u10"]
    numbers = spark.createDataFrame([(x,) for x in (-1, 3, 0, -5)], "_key bigint")
    assert [r[0] for r in Query(numbers).find_all().collect()] == [0, 3, -5, -1]


def test_nan_and_null(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "_key int, x double")
    q = Query(d)
    assert [r[0] for r in q.filter("x", float("nan")).find_all().collect()] == []
    assert [r[0] for r in q.range("x", max=5.0).find_all().collect()] == [2, 3]
    assert {r[0] for r in q.distinct("x").collect()} >= {None, 1.0}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(low=st.integers(0, 60), high=st.integers(0, 60), desc=st.booleans(), skip=st.integers(0, 5), size=st.integers(0, 12))
def test_against_model(golden, low, high, desc, skip, size):
    rows = sorted((r for r in GOLDEN if low <= r[2] <= high), key=lambda r: (-r[2] if desc else r[2], r[0]))
    assert keys(golden.range("age", low, high).sort([SortSpec("age", desc)]).offset(skip).limit(size)).split() == [r[0] for r in rows[skip : skip + size]]


def test_filters_reach_the_scan(spark):
    plan = Query(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey").filter("o_orderstatus", "F").matching().select("o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]
