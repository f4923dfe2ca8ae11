"""One verdict at a time: order of events, isolation of broken rules, what gets recorded."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import suite
from plumbline.sources import store
from plumbline.sources.tables import Scan
from plumbline.streaming.progressive import run_progressive, scan_groups
from tests.conftest import spec

RULES = [
    spec("column_values_to_be_between", column="id", max_value=7),
    spec("column_values_to_be_unique", column="nope"),
    spec("table_row_count_to_be_between", min_value=1),
]


def test_events_come_in_order_and_a_broken_rule_stops_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    events = list(
        run_progressive(spark.range(10), RULES, Scan("t", 10), ["id"], store=lambda r: store.append_records(r, path), run_id="run1")
    )
    assert [e["event"] for e in events] == ["started", "verdict", "verdict", "verdict", "completed"]
    assert [r["status"] for r in events[0]["rules"]] == ["PENDING · not yet reported"] * 3
    assert events[0]["rules"][0]["statement"] == "Every id is at most 7"
    assert [e["reported"] for e in events] == [0, 1, 2, 3, 3]
    assert [e["result"]["verdict"] for e in events[1:4]] == ["failed", "errored", "passed"]
    assert events[1]["result"]["evidence"] == ["8", "9"]  # the key is the checked column
    assert (events[4]["coverage"], events[4]["record_id"], events[4]["detail"]) == (2, "run1", None)
    row = store.read_records(spark, path).first()
    assert (row.table, row.status, row.coverage, row.scanned_rows) == ("t", "failed", 2, 10)
    assert [r.verdict for r in row.results] == ["failed", "errored", "passed"]


def test_verdicts_arrive_before_the_run_is_over(spark):
    run = run_progressive(spark.range(10), RULES, Scan("t", 10))
    assert next(run)["event"] == "started" and next(run)["result"]["unexpected_count"] == 2
    run.close()


def test_rules_share_their_scans(spark):
    rules = [spec("column_values_to_be_between", column="id", max_value=i) for i in range(25)]
    rules += [spec("column_values_to_be_unique", column="id"), spec("column_unique_value_count_to_be_between", column="id", max_value=3)]
    groups = scan_groups(suite.compiled(spark.range(3), rules))
    assert [len(g) for g in groups] == [25, 2]
    verdicts = [e["result"] for e in run_progressive(spark.range(30), rules, Scan("t", 30), ["id"]) if e["event"] == "verdict"]
    assert [v["unexpected_count"] for v in verdicts] == [29 - i for i in range(25)] + [0, None]
    assert verdicts[7]["evidence"] == [str(i) for i in range(8, 28)] and verdicts[26]["verdict"] == "failed"


def test_a_rule_that_raises_while_it_runs_is_errored(spark):
    df = spark.range(3).select(F.when(F.col("id") < 9, F.concat(F.lit("x"), "id")).cast("int").alias("n"), "id")
    rules = [spec("column_values_to_not_be_null", column="n"), RULES[2]]
    verdicts = [e["result"] for e in run_progressive(df, rules, Scan("t", 3)) if e["event"] == "verdict"]
    assert [v["verdict"] for v in verdicts] == ["errored", "passed"] and verdicts[0]["detail"]
    assert verdicts[0]["status"] == "ERRORED · rule could not run" and verdicts[0]["scanned_rows"] == 3


@pytest.mark.parametrize("rules, named", [([RULES[1]], "errored"), ([], "nothing was submitted")])
def test_runs_that_checked_nothing_are_not_recorded(spark, rules, named):
    written = []
    last = list(run_progressive(spark.range(3), rules, Scan("t", 3), store=written.append))[-1]
    assert last["event"] == "completed" and last["record_id"] is None and named in last["detail"]
    assert not written


def test_a_store_that_fails_does_not_lose_the_last_event(spark):
    def broken(_):
        raise OSError("disk is gone")

    last = list(run_progressive(spark.range(3), [RULES[2]], Scan("t", 3), store=broken))[-1]
    assert last["record_id"] is None and "disk is gone" in last["detail"]


def test_a_sampled_run_says_so(spark):
    events = list(run_progressive(spark.range(4), [RULES[2]], Scan("t", 10, seen=4)))
    assert events[1]["result"]["status"] == "PASSED · sampled 4 / 10"


def test_odd_bounds_stop_no_other_verdict(spark):
    df = spark.range(5).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rules = [
        spec("column_values_to_be_between", column="d", min_value="2024-W01-1"),
        spec("column_values_to_be_in_set", column="id", value_set=[1, float("nan")]),
        spec("column_values_to_be_between", column="id", max_value=10**30),
        RULES[2],
    ]
    verdicts = [e["result"]["verdict"] for e in run_progressive(df, rules, Scan("t", 5), ["id"]) if e["event"] == "verdict"]
    assert verdicts == ["errored", "failed", "passed", "passed"]
