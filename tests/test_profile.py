"""Profiles: exact counts, the cut-off for value sets, types without an order, reuse."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.operators import suite
from plumbline.sources import store
from plumbline.sources import tables as T
from tests.conftest import spec


def by_column(df):
    return {r.column: r for r in df.collect()}


@pytest.mark.parametrize("approximate", [False, True])
def test_counts_bounds_and_values(spark, approximate):
    n = F.col("id")
    df = spark.range(2000).select(
        n.alias("key"),
        (n % 20).cast("int").alias("twenty"),
        (n % 21).cast("int").alias("more"),
        F.when(n % 4 == 0, F.concat(F.lit("v"), n % 3)).alias("some"),
        F.lit(None).cast("double").alias("nothing"),
        (n % 7).cast("decimal(10,2)").alias("amount"),
    )
    got = by_column(P.profile(df, "t", approximate=approximate))
    assert list(got["key"])[4:7] == [2000, 2000, got["key"].distinct]
    assert got["key"].distinct == 2000 if not approximate else abs(got["key"].distinct - 2000) < 200
    assert (got["key"].minimum, got["key"].maximum, got["key"].values) == ("0", "1999", None)
    assert got["twenty"].distinct == 20 and sorted(got["twenty"].values, key=int) == [str(i) for i in range(20)]
    assert got["more"].distinct == 21 and got["more"].values is None
    assert (got["some"].non_null, got["some"].distinct, got["some"].values) == (500, 3, ["v0", "v1", "v2"])
    assert (got["nothing"].non_null, got["nothing"].distinct, got["nothing"].minimum, got["nothing"].values) == (0, 0, None, None)
    assert (got["amount"].minimum, got["amount"].maximum) == ("0.00", "6.00")
    assert [got[c].position for c in df.columns] == list(range(6))


def test_types_without_an_order(spark):
    n = F.col("id")
    a, b = F.lit("a"), F.lit("b")
    df = spark.range(30).select(
        F.array(n % 2).alias("listed"),
        F.when(n % 2 == 0, F.create_map(a, n % 3, b, F.lit(0))).otherwise(F.create_map(b, F.lit(0), a, n % 3)).alias("mapped"),
        F.struct((n % 4).alias("x")).alias("nested"),
        F.parse_json(F.concat(F.lit('{"a":'), n % 5, F.lit("}"))).alias("json"),
    )
    got = by_column(P.profile(df, "t"))
    assert {c: r.distinct for c, r in got.items()} == {"listed": 2, "mapped": 3, "nested": 4, "json": 5}
    assert all(r.minimum is None and r.maximum is None for r in got.values())
    assert got["json"].values[0] == '{"a":0}' and got["mapped"].values[0] == '{"a":0,"b":0}'
    shared = [spec("column_values_to_be_unique", column="mapped"), spec("column_unique_value_count_to_be_between", column="mapped", max_value=3)]
    rows = suite.run_suite(df, shared).orderBy("position").collect()
    assert (rows[0].unexpected_count, rows[1].observed) == (30, "3")


def test_bytes_that_are_no_text_stay_apart(spark):
    df = spark.range(6).select(F.unhex(F.element_at(F.array(F.lit("FF"), F.lit("FE"), F.lit("C328")), (F.col("id") % 3 + 1).cast("int"))).alias("b"))
    row = P.profile(df, "t").first()
    assert (row.distinct, row["values"], row.minimum, row.maximum) == (3, ["C328", "FE", "FF"], "C328", "FF")


def test_an_empty_table_still_lists_its_columns(frame):
    got = by_column(P.with_evidence_line(P.profile(frame([], "a int, b string"), "t")))
    assert {c: (r.total_rows, r.distinct, r.values) for c, r in got.items()} == {"a": (0, 0, None), "b": (0, 0, None)}
    assert got["a"].evidence == "0 rows scanned · 0 nulls · 0 distinct"


def test_value_sets_are_exact_beside_columns_with_many_values(spark):
    """The sketch of a small set stays exact however its rows are spread over tasks."""
    df = spark.range(0, 200_000, 1, 16).select(
        F.col("id").alias("key"), (F.col("id") % 20).alias("few"), F.when(F.col("id") == 7, 1).otherwise(0).alias("rare")
    )
    got = by_column(P.profile(df, "t"))
    assert len(got["few"].values) == 20 and got["rare"].values == ["0", "1"] and got["key"].distinct == 200_000


def test_evidence_lines(spark):
    df = spark.range(1200).select(F.col("id").alias("key"), F.when(F.col("id") > 1, F.lit("x")).alias("flag"))
    got = by_column(P.with_evidence_line(P.profile(df, "t")))
    assert got["key"].evidence == "1,200 rows scanned · 0 nulls · 1,200 distinct · min observed 0 · max observed 1199"
    assert got["flag"].evidence == "1,200 rows scanned · 2 nulls · 1 distinct: x"


def test_profiles_are_reused_for_five_minutes(spark, tmp_path):
    path = str(tmp_path / "profiles")
    now = dt.datetime(2024, 1, 1, 12)
    for name, age in (("new", 299), ("old", 300)):
        at = F.lit(now - dt.timedelta(seconds=age)).cast("timestamp_ntz")
        store.append_profiles(P.stamped(P.profile(spark.range(3), name), at), path)
    fresh = P.fresh_profiles(spark.read.parquet(path), F.lit(now).cast("timestamp_ntz"))
    assert [r.table for r in fresh.collect()] == ["new"]


def test_only_tables_without_a_fresh_profile_are_profiled(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 12)).cast("timestamp_ntz")
    at = lambda s: F.lit(dt.datetime(2024, 1, 1, 12) - dt.timedelta(seconds=s)).cast("timestamp_ntz")
    old = [P.stamped(P.profile(spark.range(3), n), at(s)) for n, s in (("a", 10), ("a", 200), ("b", 400), ("c", -5))]
    stored = old[0].unionByName(old[1]).unionByName(old[2]).unionByName(old[3])
    found = P.profiles_of({n: spark.range(7) for n in "abcd"}, stored, now).collect()
    assert {r.table: (r.reused, r.total_rows) for r in found} == {"a": (True, 3), "b": (False, 7), "c": (False, 7), "d": (False, 7)}
    assert len(found) == 4


def test_samples(spark):
    assert P.sample_rows(spark.range(100)).count() == 20
    assert [r.id for r in P.sample_rows(spark.range(100), 3, ["id"]).collect()] == [0, 1, 2]


def test_listing(spark, tmp_path):
    spark.range(5).select("id", F.lit("x").alias("name")).write.parquet(str(tmp_path / "a.parquet"))
    df, scan = T.scan(spark, str(tmp_path / "a.parquet"))
    assert (scan.table, scan.total_rows, scan.scanned_rows) == ("a", 5, 5)
    assert T.columns_of(df) == [("id", "bigint"), ("name", "string")]
    listed = T.list_tables({"a": df, "lt1_copy": df, "lt_kept": df}).collect()
    assert [(r.table, r.approx_rows, r.accepted_rules) for r in listed] == [("a", 5, 0), ("lt_kept", 5, 0)]
    assert [c.name for c in listed[0].columns] == ["id", "name"]
    with pytest.raises(ValueError):
        T.list_tables({})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        T.scan(spark, str(tmp_path / "nowhere"))
