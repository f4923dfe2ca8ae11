"""Tables of a metastore, specs of stored rules, and runs of stored rules."""

import json

from pyspark.sql import functions as F

from plumbline.operators import audit, history, registry, suite
from plumbline.operators.run import run_table
from plumbline.sources import layout, store
from plumbline.sources import tables as T
from tests.conftest import spec


def test_metastore_tables_are_listed(spark, tmp_path):
    spark.sql(f"create database listed location '{tmp_path}'")
    spark.range(4).write.saveAsTable("listed.a")
    spark.range(2).write.saveAsTable("listed.lt0_scratch")
    found = T.list_tables(T.catalog_tables(spark, "listed")).collect()
    assert [(r.table, r.approx_rows) for r in found] == [("a", 4)]
    spark.sql("drop database listed cascade")


def test_stored_rules_run(spark, frame):
    rules = [spec("column_values_to_be_between", column="id", max_value=2), spec("column_to_exist", column="id")]
    stored = frame([("b", json.dumps(rules[1])), ("a", json.dumps(rules[0]))], "rule_id string, spec string")
    specs = suite.specs_of(spark, stored)
    assert specs == rules
    assert [r.verdict for r in suite.run_suite(spark.range(5), specs).orderBy("position").collect()] == ["failed", "passed"]


def revisions(frame, *rows):
    full = [(f"r{i}", 1, table, json.dumps(s), status, None, None) for i, (table, s, status) in enumerate(rows)]
    return frame(full, registry.REVISION_SCHEMA)


def test_a_table_is_run_from_its_stored_rules(spark, frame):
    low, same = spec("column_values_to_be_between", column="id", min_value=2), spec("column_values_to_be_between", min_value=2.0, column="id")
    rules = revisions(
        frame, ("t", low, "accepted"), ("t", same, "accepted"), ("t", spec("column_to_exist", column="id"), "accepted"),
        ("t", spec("column_to_exist", column="gone"), "proposed"), ("u", spec("column_to_exist", column="gone"), "accepted"),
    )
    run = run_table(spark.range(10), "t", rules, "run 1", ["id"])
    found = {r.type: r for r in run.results.collect()}
    assert {k: r.verdict for k, r in found.items()} == {low["type"]: "failed", "expect_column_to_exist": "passed"}
    assert found[low["type"]].evidence == ["0", "1"]
    row = run.record.first()
    assert (row.record_id, row.table, row.status, row.coverage, len(row.results)) == ("run 1", "t", "failed", 2, 2)
    nothing = run_table(spark.range(10), "v", rules, "run 2")
    assert nothing.record.count() == 0 and "nothing was submitted" in nothing.run.first().refusal
    dark = run_table(spark.range(10), "u", revisions(frame, ("u", spec("column_values_to_be_null", column="gone"), "accepted")), "run 3")
    assert dark.record.count() == 0 and "errored" in dark.run.first().refusal


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_reads_its_own_revisions(spark, frame, tmp_path):
    path = str(tmp_path / "rules")
    rule = spec("column_to_exist", column="id")
    names = ["orders", "007", "a/b =c", "2024-01-01", None]
    for _ in range(2):  # appended twice
        store.append_revisions(revisions(frame, *[(n, rule, "accepted") for n in names]), path)
    read = store.read_revisions(spark, path)
    assert read.columns == list(registry.REVISION_COLUMNS)
    assert sorted(str(r.table) for r in read.collect()) == sorted(2 * [str(n) for n in names])
    one = registry.revisions(read, "007")
    assert [r.table for r in one.collect()] == ["007", "007"]
    assert "PartitionFilters: [isnotnull(table" in plan_of(one)
    run = run_table(spark.range(3), "a/b =c", read, "run 1")
    assert run.record.first().coverage == 1


def test_stores_without_folders_are_read(spark, frame, tmp_path):
    path = str(tmp_path / "flat")
    revisions(frame, ("t", spec("column_to_exist", column="id"), "accepted")).write.parquet(path)
    store.append_revisions(revisions(frame, ("u", spec("column_to_exist", column="id"), "accepted")).limit(0), path)
    assert [r.table for r in store.read_revisions(spark, path).collect()] == ["t"]


def test_records_of_a_table_keep_its_name(spark, frame, tmp_path):
    path = str(tmp_path / "records")
    rules = revisions(frame, ("12", spec("column_to_exist", column="id"), "accepted"))
    for run_id in ("a", "b"):
        store.append_records(run_table(spark.range(4), "12", rules, run_id).record, path)
    read = store.read_records(spark, path)
    assert read.columns == list(store.RECORD_COLUMNS)
    assert [(r.table, len(r.results)) for r in history.latest(read, "12").collect()] == [("12", 1)]
    assert history.latest(read, "13").count() == 0


def test_ranking_sends_no_results(spark, frame, tmp_path):
    """What a run found is not shuffled to find the latest run."""
    path = str(tmp_path / "ranked")
    rules = revisions(frame, ("t", spec("column_values_to_be_null", column="id"), "accepted"))
    for run_id in ("a", "b"):
        store.append_records(run_table(spark.range(4), "t", rules, run_id).record, path)
    tables = frame([("t", 4)], "table string, approx_rows bigint")
    ranked = history.ranked_tables(tables, rules, store.read_records(spark, path))
    assert [(r.record_id, r.bucket) for r in ranked.collect()] == [("b", "verified")]
    exchanged = ranked._jdf.queryExecution().optimizedPlan().toString()
    above = exchanged.split("Window")[0]
    assert "results" not in above


def test_a_part_of_a_table_says_so(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 1, F.col("id")))
    part, seen = T.scan_where(df, "t", F.col("x") < 6)
    assert (seen.scanned_rows, seen.total_rows, part.count()) == (4, 10, 4)
    row = suite.run_suite(part, [spec("column_values_to_not_be_null", column="x")], seen).first()
    assert row.status == "PASSED · sampled 4 / 10"
    nothing, none = T.scan_where(spark.range(0).toDF("x"), "t", F.col("x") < 6)
    assert (none.scanned_rows, none.total_rows, nothing.count()) == (0, 0, 0)


def test_audits_on_the_key_of_a_layout_shuffle_nothing(spark):
    lines = spark.range(300).select((F.col("id") % 90).alias("k"), F.col("id").alias("v"))
    heads = spark.range(80).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w"))
    plain = {name: df.first().observed for name, df in on_key(lines, heads).items()}
    assert plain["orphans"] == 30 and plain["duplicates"] == 300
    a, b = layout.bucketed(lines, "k", 4), layout.bucketed(heads, "key", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in on_key(a, b).items():
            assert "hashpartitioning" not in plan_of(df), name
            assert df.first().observed == plain[name]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def on_key(lines, heads):
    return {
        "orphans": audit.orphans(lines, "k", heads, "key"),
        "mismatched": audit.mismatched(lines, heads, ("k", "key"), ("v", "w")),
        "duplicates": audit.duplicate_rows(lines, ["k"]),
    }


def test_a_hot_key_is_not_put_into_one_bucket(spark, frame):
    hot = spark.range(300).select(F.when(F.col("id") > 200, F.col("id")).otherwise(7).alias("k"))
    assert layout.bucketed(hot, "k", 16) is hot
    assert layout.bucketed(hot, "k", 1) is not hot
    assert layout.bucketed(frame([], "k bigint"), "k", 4).count() == 0
    nulls = frame([(None,), (1,), (None,)], "k bigint")
    assert layout.bucketed(nulls, "k", 4).count() == 3
