"""Counts, verdicts and violating rows on small tables with known defects."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import suite
from plumbline.plans.catalog import RULE_TYPES
from plumbline.sources.tables import Scan
from tests.conftest import spec


@pytest.fixture(scope="module")
def probe(spark):
    """60 parcels: every fifth weighs nothing or less, 12 to 15 have no label, three sizes."""
    n = F.col("id")
    return spark.range(60).select(
        n.cast("int").alias("parcel"),
        F.when(n % 5 == 0, -n / 4).otherwise(n + 0.25).cast("decimal(8,2)").alias("weight"),
        F.element_at(F.array(*map(F.lit, ("small", "large", "odd"))), (n % 3 + 1).cast("int")).alias("size"),
        F.when(~n.between(12, 15), F.concat(F.lit("to:"), n)).alias("label"),
    )


def by_position(results):
    return {row.position: row for row in results.collect()}


def test_probe_counts_and_tolerance(probe):
    rules = [
        spec("column_values_to_not_be_null", column="label"),
        spec("column_values_to_be_between", column="weight", min_value=0.01),
        spec("column_values_to_be_between", column="weight", min_value=0.01, mostly=0.8),
        spec("column_values_to_be_in_set", column="size", value_set=["odd", "large", "small"]),
    ]
    got = by_position(suite.run_suite(probe, rules))
    assert [got[i].unexpected_count for i in range(4)] == [4, 12, 12, 0]
    assert [got[i].verdict for i in range(4)] == ["failed", "failed", "passed", "passed"]
    assert got[1].magnitude == "12 violating rows · of 60 rows scanned · 20.00%"
    assert got[2].statement == "Every weight is at least 0.01, in at least 80% of rows"


def test_nulls_are_skipped_except_by_the_null_rules(probe):
    rules = [
        spec("column_values_to_match_regex", column="label", regex="^to:"),
        spec("column_values_to_not_be_null", column="label", mostly=0.9),
    ]
    got = by_position(suite.run_suite(probe, rules))
    assert (got[0].unexpected_count, got[0].missing_count, round(got[0].missing_percent, 4)) == (0, 4, 6.6667)
    assert (got[1].verdict, got[1].missing_count, round(got[1].unexpected_percent, 4)) == ("passed", None, 6.6667)


def test_shapes_without_a_count_report_what_they_observed(probe):
    rules = [
        spec("column_mean_to_be_between", column="parcel", max_value=29),
        spec("column_unique_value_count_to_be_between", column="size", min_value=4),
        spec("table_row_count_to_be_between", min_value=60, max_value=60),
        spec("column_to_exist", column="sender"),
        spec("column_values_to_be_of_type", column="weight", type_="decimal"),
        spec("column_values_to_be_in_type_list", column="parcel", type_list=["SMALLINT", "DATE"]),
    ]
    got = by_position(suite.run_suite(probe, rules))
    assert [got[i].unexpected_count for i in range(6)] == [None] * 6
    assert [got[i].verdict for i in range(6)] == ["failed", "failed", "passed", "failed", "passed", "failed"]
    assert got[0].observed_number == pytest.approx(29.5)
    assert [got[i].observed for i in (1, 2, 3, 4, 5)] == ["3", "60", None, "NUMERIC", "INTEGER"]
    assert got[0].magnitude is None


def test_uniqueness_counts_every_row_of_a_shared_value(frame):
    df = frame([("a",), ("a",), ("a",), ("b",), ("c",), ("c",), (None,), (None,)], "ref string")
    rule = spec("column_values_to_be_unique", column="ref")
    row = suite.run_suite(df, [rule]).first()
    assert (row.unexpected_count, row.missing_count, row.verdict) == (5, 2, "failed")
    assert suite.violations(df, rule).count() == 5
    assert [tuple(r) for r in suite.violation_counts(df, rule).collect()] == [("a", 3), ("c", 2)]


def test_uniqueness_of_texts_sends_no_text(spark, frame):
    df = frame([("a" * 5000,), ("a" * 5000,), ("b" * 5000,), ("",), ("",), (None,), (None,)], "t string")
    rules = [spec("column_values_to_be_unique", column="t"), spec("column_unique_value_count_to_be_between", column="t", max_value=3)]
    got = by_position(suite.run_suite(df, rules))
    assert (got[0].unexpected_count, got[0].missing_count, got[1].observed) == (4, 2, "3")
    plan = suite.run_suite(df, rules[:1])._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "HashAggregate(keys=[" in line or "Exchange hashpartitioning" in line]
    assert keys and not any("[t#" in line or "(t#" in line for line in keys)
    assert suite.violations(df, rules[0]).count() == 4
    assert {(r.value[:1], r.rows) for r in suite.violation_counts(df, rules[0]).collect()} == {("a", 2), ("", 2)}


@pytest.mark.parametrize("kind, values, shared", [
    ("binary", [b"x", b"x", b"", None], 2), ("double", [0.0, -0.0, float("nan"), float("nan"), 1.0], 4),
    ("array<int>", [[1], [1], [2], []], 2), ("struct<a:int,b:string>", [(1, "x"), (1, "x"), (1, None)], 2),
])
def test_uniqueness_of_other_types(frame, kind, values, shared):
    df = frame([(v,) for v in values], f"v {kind}")
    rule = spec("column_values_to_be_unique", column="v")
    assert suite.run_suite(df, [rule]).first().unexpected_count == shared
    assert suite.violations(df, rule).count() == shared


def test_a_value_with_a_third_of_all_rows(spark):
    n = F.col("id")
    df = spark.range(30_000).select(
        n.alias("id"), F.when(n % 3 == 0, F.lit(-1)).when(n % 3 == 1, n - n % 2).otherwise(n).alias("v")
    )
    rule = spec("column_values_to_be_unique", column="v")
    expected = df.groupBy("v").count().filter("count > 1").agg(F.sum("count")).first()[0]
    assert suite.run_suite(df, [rule]).first().unexpected_count == expected
    rows = suite.violations(df, rule)
    assert rows.count() == expected and rows.filter("v = -1").count() == 10_000


def test_nulls_in_a_value_set_do_not_hide_violations(frame):
    df = frame([("a",), ("b",), (None,)], "s string")
    rules = [
        spec("column_values_to_be_in_set", column="s", value_set=["a", None]),
        spec("column_values_to_not_be_in_set", column="s", value_set=["a", None]),
    ]
    got = by_position(suite.run_suite(df, rules))
    assert (got[0].unexpected_count, got[1].unexpected_count) == (1, 1)


@pytest.mark.parametrize(
    "kind, values, members, inside",
    [
        ("bigint", list(range(3000)), list(range(0, 4000, 2)), 1500),
        ("int", list(range(3000)), [float(i) for i in range(1500)] + [0.5], 1500),
        ("double", [i / 2 for i in range(3000)], list(range(1200)), 1200),
        ("string", [f"k{i}" for i in range(3000)], [f"k{i}" for i in range(2000)], 2000),
        ("decimal(10,2)", [Decimal(i) for i in range(3000)], list(range(1100)), 1100),
    ],
)
def test_long_value_sets_count_like_short_ones(frame, kind, values, members, inside):
    df = frame([(v,) for v in [*values, None]], f"v {kind}")
    kept = spec("column_values_to_be_in_set", column="v", value_set=members)
    barred = spec("column_values_to_not_be_in_set", column="v", value_set=members)
    got = by_position(suite.run_suite(df, [kept, barred]))
    assert (got[0].unexpected_count, got[1].unexpected_count) == (3000 - inside, inside)
    assert suite.violations(df, kept).count() == 3000 - inside
    assert suite.violations(df, barred).count() == inside


# Members a column can hold, and members it cannot: too fine, too large, or another float.
EXACT = [
    ("tinyint", list(range(-100, 100)), [-100, 3, 99], [128, -129, 1000, 2.5]),
    ("smallint", list(range(200)), [0, 7], [40_000, -40_000, 0.5]),
    ("int", list(range(200)), [5, 6.0], [2**31, 1e300, 7.5]),
    ("bigint", list(range(200)), [5, 2**62], [2**63, 1e30, 3.25]),
    ("decimal(10,2)", [Decimal(i) / 4 for i in range(200)], [0.25, 10, 7.5], [1.005, 0.333, 1e12]),
    ("float", [i / 8 for i in range(200)], [0.125, 3], [0.1, 16_777_217.5, 1e300]),
    ("double", [i / 10 for i in range(200)], [0.1, 3, 1.7], [0.30000000000000004, -1]),
    ("boolean", [True, False] * 100, [True], []),
    ("string", [f"k{i}" for i in range(200)], ["k3", "k7"], ["K3", ""]),
    ("date", [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(200)], ["2024-02-01"], ["1999-01-01"]),
]


@pytest.mark.parametrize("kind, values, held, foreign", EXACT, ids=[e[0] for e in EXACT])
def test_the_length_of_a_value_set_changes_no_verdict(frame, monkeypatch, kind, values, held, foreign):
    """The same members inside the scan's expression and as a joined table, in the column's own type."""
    df = frame([(v,) for v in [*values, None]], f"v {kind}")
    rules = [
        spec("column_values_to_be_in_set", column="v", value_set=[*held, *foreign]),
        spec("column_values_to_not_be_in_set", column="v", value_set=[*held, *foreign]),
        *([spec("column_values_to_be_in_set", column="v", value_set=foreign)] if foreign else []),
    ]
    short = by_position(suite.run_suite(df, rules))
    monkeypatch.setattr("plumbline.plans.compile.INLINE_SET", 0)
    long = by_position(suite.run_suite(df, rules))
    as_told = lambda r: (r.verdict, r.unexpected_count, r.missing_count, r.magnitude)
    assert {i: as_told(r) for i, r in short.items()} == {i: as_told(r) for i, r in long.items()}
    shown = {dt.date.isoformat(v) if isinstance(v, dt.date) else v for v in values}
    inside = sum(m in shown for m in held) * (100 if kind == "boolean" else 1)
    assert (short[0].unexpected_count, short[1].unexpected_count) == (200 - inside, inside)


def test_bounds_on_dates_and_timestamps(frame):
    rows = [(dt.date(2024, 1, d), dt.datetime(2024, 1, d, 12)) for d in (1, 15, 31)]
    df = frame(rows, "d date, t timestamp_ntz")
    rules = [
        spec("column_values_to_be_between", column="d", min_value="2024-01-10", max_value="2024-01-31"),
        spec("column_values_to_be_between", column="t", max_value="2024-01-15T12:00:00"),
        spec("column_values_to_be_between", column="d", min_value="soon"),
    ]
    got = by_position(suite.run_suite(df, rules))
    assert [got[i].unexpected_count for i in range(3)] == [1, 1, None]
    assert got[2].verdict == "errored" and "soon" in got[2].detail


def test_not_a_number_is_above_every_bound(frame):
    df = frame([(1.0,), (float("nan"),)], "x double")
    row = suite.run_suite(df, [spec("column_values_to_be_between", column="x", max_value=10)]).first()
    assert row.unexpected_count == 1


def test_lengths_count_characters(frame):
    df = frame([("été",), ("日本",), ("",), (None,)], "s string")
    row = suite.run_suite(df, [spec("column_value_lengths_to_be_between", column="s", min_value=2, max_value=3)]).first()
    assert row.unexpected_count == 1


def test_bracket_classes_mean_what_they_say(frame):
    df = frame([("a@b.co",), ("a b@c.de",), ("nobody",), (None,)], "email string")
    pattern = r"^[^@[:space:]]+@[^@[:space:]]+\.[^@[:space:]]{2,}$"
    row = suite.run_suite(df, [spec("column_values_to_match_regex", column="email", regex=pattern)]).first()
    assert row.unexpected_count == 2


def test_an_empty_table_passes_what_it_checks_and_has_no_mean(frame):
    df = frame([], "x int")
    rules = [
        spec("column_values_to_not_be_null", column="x"),
        spec("column_values_to_be_unique", column="x"),
        spec("column_mean_to_be_between", column="x", min_value=0),
        spec("table_row_count_to_be_between", min_value=1),
    ]
    got = by_position(suite.run_suite(df, rules))
    assert [got[i].verdict for i in range(4)] == ["passed", "passed", "failed", "failed"]
    assert got[0].magnitude == "0 violating rows · of 0 rows scanned · 0.00%"


BROKEN = [
    (spec("column_values_to_be_unique", column="gone"), "gone"),
    (spec("column_value_lengths_to_be_between", column="n", max_value=3), "text"),
    (spec("column_values_to_not_match_regex", column="n", regex="7"), "text"),
    (spec("column_values_to_match_regex", column="s", regex="(a|"), "(a|"),
    (spec("column_values_to_be_between", column="n", max_value="ten"), "'ten'"),
    (spec("column_mean_to_be_between", column="s", max_value=0), "numbers"),
    (spec("column_values_to_not_be_in_set", column="n", value_set=[1, "one"]), "'one'"),
    (spec("column_values_to_not_be_in_set", column="n", value_set=[None]), "empty"),
    (spec("column_values_to_be_in_type_list", column="s", type_list=["TEXT", "WORDS"]), "WORDS"),
    (spec("column_kurtosis_to_be_between", column="n"), "kurtosis"),
    (spec("column_unique_value_count_to_be_between", column="n"), "min_value"),
    (spec("column_values_to_be_null", column="s", mostly=-1), "mostly"),
]


def test_rules_that_cannot_run_are_errored_and_the_rest_still_run(frame):
    df = frame([("a", 1), ("b", None)], "s string, n int")
    rules = [rule for rule, _ in BROKEN] + [spec("column_values_to_not_be_null", column="n")]
    got = by_position(suite.run_suite(df, rules))
    for i, (_, named) in enumerate(BROKEN):
        assert got[i].verdict == "errored" and named in got[i].detail
        assert got[i].status == "ERRORED · rule could not run" and got[i].unexpected_count is None
    assert (got[len(BROKEN)].verdict, got[len(BROKEN)].unexpected_count) == ("failed", 1)


NAN, INF = float("nan"), float("inf")
#: On days 2024-01-01 to 2024-01-10 with n from 0 to 9: the rule, and its violating rows, or what its reason names.
ODD = [
    (spec("column_values_to_be_between", column="d", min_value="2024-W01-1"), "2024-W01-1"),
    (spec("column_values_to_be_between", column="d", max_value="20240105"), "20240105"),
    (spec("column_values_to_not_be_in_set", column="d", value_set=["2024-01-05", "20240106"]), "20240106"),
    (spec("column_values_to_be_in_set", column="n", value_set=[3, NAN]), 9),
    (spec("column_values_to_not_be_in_set", column="n", value_set=[3, INF, -INF]), 1),
    (spec("column_values_to_be_between", column="n", max_value=10**30), 0),
    (spec("column_values_to_be_between", column="n", min_value=10**30), 10),
    (spec("column_values_to_be_between", column="n", min_value=-(10**50), max_value=4), 5),
    (spec("column_values_to_be_between", column="m", max_value=INF), 0),
    (spec("column_values_to_be_in_set", column="m", value_set=[INF, NAN, 2.5]), 10),
    (spec("column_value_lengths_to_be_between", column="s", max_value=10**30), 0),
    ({"type": "expect_column_values_to_be_null", "kwargs": ["n"]}, "kwargs"),
    (spec("column_values_to_be_null", column=["n"]), "list"),
    (spec("column_values_to_be_in_set", column="n", value_set=[[3], {}]), "[3]"),
]


@pytest.fixture
def days(spark):
    n = F.col("id")
    return spark.range(10).select(
        n.alias("n"), F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).alias("d"),
        n.cast("decimal(9,2)").alias("m"), n.cast("string").alias("s"),
    )


def test_odd_bounds_and_members_stop_no_other_rule(days):
    rules = [rule for rule, _ in ODD] + [spec("column_values_to_be_between", column="n", min_value=7)]
    for run in (suite.run_suite, suite.run_isolated):
        got = by_position(run(days, rules))
        assert (got[len(ODD)].verdict, got[len(ODD)].unexpected_count) == ("failed", 7)
        for i, (_, outcome) in enumerate(ODD):
            if isinstance(outcome, str):
                assert got[i].verdict == "errored" and outcome in got[i].detail
            else:
                assert (got[i].unexpected_count, got[i].detail) == (outcome, None) and got[i].statement


def test_a_date_that_spark_reads_still_runs(days):
    rules = [
        spec("column_values_to_be_between", column="d", min_value="2024-01-04"),
        spec("column_values_to_be_between", column="d", min_value=dt.date(2024, 1, 4)),
        spec("column_values_to_be_in_set", column="d", value_set=["2024-01-04"]),
    ]
    got = by_position(suite.run_suite(days, rules))
    assert [got[i].unexpected_count for i in range(3)] == [3, 3, 9]


def test_a_rule_that_raises_while_running_does_not_take_the_others_with_it(spark):
    texts = F.when(F.col("id") == 1, "x").otherwise(F.col("id").cast("string"))
    df = spark.range(2).select(texts.alias("s"), texts.cast("int").alias("n"))
    rules = [spec("column_values_to_not_be_null", column="s"), spec("column_values_to_be_between", column="n", min_value=0)]
    got = by_position(suite.run_isolated(df, rules))
    assert (got[0].verdict, got[1].verdict) == ("passed", "errored")
    assert got[1].detail and got[1].scanned_rows == 2


def test_a_long_suite_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(5)]).write.parquet(path)
    df = spark.read.parquet(path)
    rules = [spec("column_values_to_be_between", column=f"c{i % 5}", min_value=i) for i in range(130)]
    results = suite.run_suite(df, rules)
    assert results._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = by_position(results)
    assert len(got) == 130
    assert all(got[i].unexpected_count == min(100, max(0, i - i % 5)) for i in range(130))


def test_a_mean_at_its_bound_is_one_verdict_over_any_partitions(spark):
    n = F.col("id")
    df = spark.range(1000).select(
        F.lit(0.1).alias("same"), F.when(n % 3 > 0, n * 0.7 - 1e12).alias("far"), (n * 1e-310).alias("tiny"),
        F.when(n != 7, n).otherwise(F.lit(float("nan"))).alias("odd"), F.lit(None).cast("double").alias("none"),
        F.when(n == 3, float("inf")).otherwise(1.0).alias("inf"), n.cast("decimal(8,1)").alias("dec"),
    )
    rules = [spec("column_mean_to_be_between", column=c, min_value=0.1, max_value=0.1) for c in df.columns]
    seen = set()
    for parts in (1, 4, 40):
        got = by_position(suite.run_suite(df.repartition(parts), rules))
        seen.add(tuple((got[i].verdict, str(got[i].observed_number)) for i in range(len(rules))))
    (told,) = seen
    assert told[0] == ("passed", "0.1") and told[3][1] == "nan" and told[4][1] == "None" and told[5][1] == "inf"
    assert float(told[1][1]) == pytest.approx(-1e12 + 350, rel=1e-12) and float(told[6][1]) == 499.5
    assert float(told[2][1]) == pytest.approx(4.995e-308, rel=1e-9)


@pytest.mark.parametrize("key", ["n", "x", "s", "t", "d", "b", "one"])
def test_evidence_is_that_of_a_full_sort_for_any_key(spark, key):
    r = F.xxhash64("id")
    df = spark.range(3000).select(
        r.alias("r"), (r % 7).alias("v"), F.pmod(r, F.lit(500)).alias("u"), F.pmod(r, F.lit(3)).alias("few"),
        F.when(r % 40 != 0, r).alias("n"), F.when(r % 9 == 0, float("nan")).otherwise(r.cast("double")).alias("x"),
        F.concat(F.lit("Reader#"), F.pmod(r, F.lit(90_000)).cast("string")).alias("s"),
        F.timestamp_micros(F.pmod(r, F.lit(10**15))).alias("t"), F.lit(1).alias("one"), (r % 2 == 0).alias("b"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(r, F.lit(300)).cast("int")).alias("d"),
    ).repartition(5)
    rules = [spec("column_values_to_be_between", column="v", min_value=m) for m in (-6, 0, 6)]
    rules += [spec("column_values_to_be_unique", column=c) for c in ("u", "few")]
    got = by_position(suite.run_with_evidence(df, rules, [key, "r"]))
    for i, rule in enumerate(rules):
        row = F.to_json(F.struct(key, "r", rule["kwargs"]["column"])).alias("row")
        first = suite.violations(df, rule).orderBy(key, "r").limit(20).select(row)
        assert list(got[i].identified) == [x.row for x in first.collect()]


def test_only_rows_up_to_a_bound_are_sorted_for_evidence(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).select("id", (F.col("id") % 50).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    checks = suite.compiled(df, [spec("column_values_to_be_between", column="v", min_value=i) for i in (20, 40)])
    rows, bounds = suite.counted_with_bounds(df, checks, ["id"])
    assert [r.unexpected_count for r in rows] == [8000, 16000]
    assert all(n > 1000 and 19 <= bound < 1000 for n, bound in bounds.values())
    plan = suite.metrics(df, checks, suite.First(F.col("id"), 20))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.count("FileScan") == 1
    kept, hits = suite._hits(df, checks, ["id"], 20, bounds)
    assert kept.where(hits[0] | hits[1]).count() < 2000
    assert "PushedFilters: [Or(IsNull(id),LessThanOrEqual(id" in kept._jdf.queryExecution().executedPlan().toString()


def test_members_that_no_column_can_hold_leave_nulls_alone(frame):
    df = frame([(1,), (None,), (2,)], "n int")
    row = suite.run_suite(df, [spec("column_values_to_be_in_set", column="n", value_set=[0.5, float("inf")])]).first()
    assert (row.unexpected_count, row.missing_count) == (2, 1)


def test_all_types_run(probe):
    given = {
        "column": "parcel", "value_set": [4], "regex": "^o", "min_value": 1, "type_": "INTEGER", "type_list": ["TEXT"],
    }
    rules = []
    for entry in RULE_TYPES:
        kwargs = {p: given[p] for p in entry.required}
        if "at_least_one_bound" in entry.checks:
            kwargs["min_value"] = 1
        if entry.family == "regex/format":
            kwargs["column"] = "size"
        rules.append({"type": entry.name, "kwargs": kwargs})
    got = by_position(suite.run_suite(probe, rules))
    assert len(got) == 15 and not [r for r in got.values() if r.verdict == "errored"]


def test_no_rules_is_no_suite(probe):
    with pytest.raises(ValueError):
        suite.run_suite(probe, [])


def test_a_part_that_was_read_shows_in_every_line(probe):
    scan = Scan("parcels", 60, seen=24)
    row = suite.run_suite(probe.filter("parcel < 24"), [spec("column_values_to_be_null", column="parcel")], scan).first()
    assert row.status == "FAILED · sampled 24 / 60"
    assert row.magnitude == "24 violating rows · of 24 rows scanned · 100.00%"


def test_an_exception_without_a_message_is_a_reason_too(probe):
    (check,) = suite.compiled(probe, [spec("column_values_to_be_null", column="label")])
    for exc, reason in ((ValueError(), "ValueError"), (KeyError("a\n" + "b" * 900), "KeyError: " + repr("a\n" + "b" * 900))):
        row = suite.errored_result(probe, check, exc, 60)
        assert (row.verdict, row.detail) == ("errored", reason)


def test_evidence_names_the_first_rows(probe):
    rules = [
        spec("column_values_to_be_between", column="weight", min_value=0.5),
        spec("column_values_to_not_be_null", column="label"),
        spec("column_values_to_be_unique", column="size"),
        spec("column_to_exist", column="size"),
    ]
    got = by_position(suite.run_with_evidence(probe, rules, ["parcel"]))
    assert got[0].evidence[:3] == ["#0 0.00", "#5 -1.25", "#10 -2.50"] and len(got[0].evidence) == 12
    assert got[1].evidence == [f"#{i} (empty)" for i in range(12, 16)]
    assert got[2].evidence[:2] == ["#0 small", "#1 large"] and len(got[2].samples) == 20
    assert got[3].evidence == [] and got[0].identified[1] == '{"parcel":5,"weight":-1.25}'


def test_evidence_without_a_key_shows_bare_values(probe):
    row = suite.run_with_evidence(probe, [spec("column_values_to_be_between", column="weight", max_value=10)]).first()
    assert len(row.evidence) == 20 and all(line == value for line, value in zip(row.evidence, row.samples))


def test_the_evidence_of_all_row_rules_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).select("id", (F.col("id") % 50).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    checks = suite.compiled(df, [spec("column_values_to_be_between", column="v", min_value=i) for i in range(1, 31)])
    counted = suite.results_of(df, checks)
    found = suite._violating_first(df, checks, ["id"], 20, {c.position: (500, 200) for c in checks})
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = by_position(suite.with_evidence(counted, df, checks, ["id"], 20))
    assert rows[2].evidence == [f"#{i * 50 + j} {j}" for i in range(10) for j in range(3)][:20]


def test_evidence_of_a_composite_key(frame):
    rows = [(b, a, "x" if a < 3 else f"y{a}{b}") for a in range(4) for b in range(3)]
    df = frame(rows, "b int, a int, v string")
    found = suite.evidence(df, spec("column_values_to_be_unique", column="v"), ["a", "b"], n=4).collect()
    assert [r.evidence for r in found] == ["#0 #0 x", "#0 #1 x", "#0 #2 x", "#1 #0 x"]


def test_evidence_of_shared_values_starts_with_the_first_rows_by_key(spark):
    df = spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(150)).alias("v"))
    rule = spec("column_values_to_be_unique", column="v")
    expected = suite.violations(df, rule).orderBy("id").limit(20).collect()
    found = suite.evidence(df, rule, ["id"]).collect()
    assert [(r.id, r.value) for r in found] == [(r.id, r.v) for r in expected]


def test_schema_rules_have_no_violating_rows(probe):
    with pytest.raises(ValueError):
        suite.violations(probe, spec("column_to_exist", column="label"))


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(10).select("id", *[F.lit(i).alias(f"c{i}") for i in range(20)]).write.parquet(path)
    df = spark.read.parquet(path)
    plan = suite.run_suite(df, [spec("column_values_to_be_between", column="c3", min_value=0)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:int>" in text and text.count("FileScan") == 1
