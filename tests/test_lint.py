"""Bad rules are refused with the fault named, good ones are let through."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import regex
from plumbline.operators import intake, lint, profile
from plumbline.plans.catalog import RULE_TYPES
from tests.conftest import spec

# Two or three of each kind of fault, with a word that the reason names.
REFUSED = [
    # no such type
    (spec("column_values_to_rhyme", column="s"), "expect_column_values_to_rhyme"),
    (spec("row_sums_to_be_even", columns=["x", "s"]), lint.NOT_IN_CATALOG),
    # a parameter too many or too few
    (spec("column_values_to_be_null", column="x", nullable=True), "nullable"),
    (spec("column_values_to_be_in_set", column="s", set=["a"], value_set=["a"]), "set"),
    (spec("column_values_to_be_of_type", column="x"), "type_"),
    (spec("column_values_to_not_match_regex", column="s", regex=None), "regex"),
    (spec("column_values_to_not_be_in_set", column="s"), "value_set"),
    # a tolerance that is none
    (spec("column_values_to_be_unique", column="x", mostly=101), "mostly"),
    (spec("column_values_to_be_unique", column="x", mostly=True), "mostly"),
    (spec("column_values_to_be_unique", column="x", mostly="most"), "mostly"),
    (spec("column_values_to_be_unique", column="x", mostly=None), "mostly"),
    # bounds: none, or the wrong way round
    (spec("column_value_lengths_to_be_between", column="s"), "min_value"),
    (spec("column_values_to_be_between", column="x", min_value=None, max_value=None), "min_value"),
    (spec("table_row_count_to_be_between", min_value=9, max_value=8), "8"),
    (spec("column_mean_to_be_between", column="x", min_value=0.2, max_value=0.1), "0.2"),
    # nothing in a set
    (spec("column_values_to_not_be_in_set", column="s", value_set={}), "value_set"),
    (spec("column_values_to_be_in_set", column="s", value_set=0), "value_set"),
    (spec("column_values_to_be_in_type_list", column="s", type_list=""), "type_list"),
    # patterns and type names
    (spec("column_values_to_not_match_regex", column="s", regex="a{2,1}"), "a{2,1}"),
    (spec("column_values_to_match_regex", column="s", regex=["a"]), "a"),
    (spec("column_values_to_be_in_type_list", column="x", type_list=["TEXT", "STRINGS"]), "STRINGS"),
    (spec("column_values_to_be_of_type", column="x", type_=[1]), "1"),
    # columns
    (spec("column_values_to_be_null", column="X"), "X"),
    (spec("column_mean_to_be_between", column=True, min_value=1), "true"),
]
ACCEPTED = [
    spec("column_values_to_not_be_in_set", column="s", value_set=["", None]),
    spec("column_values_to_be_between", column="x", max_value="z"),
    spec("column_values_to_be_between", column="x", min_value=-2, max_value=-2.0),
    spec("column_value_lengths_to_be_between", column="s", min_value="1", max_value=0),
    spec("column_values_to_be_in_type_list", column="x", type_list=["smallint", "Date"]),
    spec("column_values_to_not_match_regex", column="e", regex="[[:upper:]]{4,}"),
    spec("column_values_to_be_null", column="x", mostly=0.0),
    spec("column_values_to_be_unique", column="e", mostly=1),
    spec("table_row_count_to_be_between", min_value=3),
]


@pytest.fixture
def schema(frame):
    return frame([("t", c, "string") for c in "xes"] + [("u", "x", "int")], "table string, column string, data_type string")


def linted(frame, specs, schema, table="t"):
    rows = frame([(i, table, json.dumps(s)) for i, s in enumerate(specs)], "id int, table string, spec string")
    return {r.id: r for r in lint.lint(rows, schema, ["id"]).collect()}


def test_bad_rules_are_refused_by_name(frame, schema):
    got = linted(frame, [s for s, _ in REFUSED], schema)
    for i, (bad, named) in enumerate(REFUSED):
        assert not got[i].ok and named in got[i].reason, (bad, got[i].reason)


def test_good_rules_pass(frame, schema):
    got = linted(frame, ACCEPTED, schema)
    assert [got[i].reason for i in range(len(ACCEPTED))] == [None] * len(ACCEPTED)


def test_every_type_is_refused_for_its_parameters_and_never_for_its_name(frame, schema):
    got = linted(frame, [{"type": e.name, "kwargs": {}} for e in RULE_TYPES], schema)
    assert all(not r.ok and lint.NOT_IN_CATALOG not in r.reason for r in got.values())


def test_a_column_is_looked_up_in_its_own_table(frame, schema):
    got = linted(frame, [spec("column_to_exist", column="s"), spec("column_to_exist", column="x")], schema, "u")
    assert (got[0].ok, got[1].ok) == (False, True)
    unread = linted(frame, [spec("column_to_exist", column="x"), spec("table_row_count_to_be_between", min_value=1)], schema, "v")
    assert "no schema of v" in unread[0].reason and unread[1].ok


def test_without_a_schema_rules_on_columns_are_refused(frame):
    got = linted(frame, [spec("column_to_exist", column="x"), spec("table_row_count_to_be_between", min_value=1)], None)
    assert (got[0].ok, got[1].ok) == (False, True)


def test_what_is_no_spec_is_refused(frame, schema):
    rows = frame([(i, "t", s) for i, s in enumerate(["nothing", "[]", "{}", None, '{"type":5}'])], "id int, table string, spec string")
    assert all(not r.ok for r in lint.lint(rows, schema, ["id"]).collect())


def test_patterns_are_tried_in_the_library_that_runs_them(spark):
    assert regex.failing_patterns(spark, {"[a", "^a$", "(?P<n>x)"}) == {"[a", "(?P<n>x)"}
    assert regex.to_java("[^[:space:]]") == r"[^\s]"


@pytest.fixture
def profiled(spark):
    df = spark.range(40).select((F.col("id") % 3).cast("string").alias("x"), F.col("id").alias("e"), F.lit("k").alias("s"))
    return profile.profile(df, "t")


def proposals(frame, schema, profiled, replies, limit=2):
    rows = frame(list(replies.items()), "reply_id string, reply string").withColumn("table", F.lit("t"))
    found = intake.proposals(rows, schema, profiled, limit).collect()
    return {k: sorted((r for r in found if r.reply_id == k), key=lambda r: r.position or 0) for k in replies}


def test_proposals_carry_sentence_and_evidence(frame, schema, profiled):
    good = [spec("column_values_to_not_be_null", column="x"), spec("table_row_count_to_be_between", min_value=1)]
    bad = spec("column_values_to_be_unique", column="nope")
    got = proposals(
        frame, schema, profiled,
        {
            "sound": json.dumps({"rules": good}),
            "longer": json.dumps({"rules": [*good, bad, good[0]]}),
            "faulty": json.dumps({"rules": [good[0], bad]}),
            "without": json.dumps({"rules": []}),
            "prose": "two rules come to mind",
            "words": json.dumps({"rules": ["unique"]}),
            "numbered": json.dumps({"rules": [{"type": 1, "kwargs": {}}]}),
            "listed": json.dumps({"rules": [{"type": "expect_table_row_count_to_be_between", "kwargs": [4]}]}),
        },
    )
    assert [r.evidence for r in got["sound"]] == ["40 rows scanned · 0 nulls · 3 distinct: 0, 1, 2", "40 rows scanned"]
    assert [r.statement for r in got["longer"][:2]] == ["Every x has a value", "Row count is at least 1"]
    assert [(r.position, r.refusal, r.status) for r in got["longer"][2:]] == [(i, intake.PAST_LIMIT, None) for i in (2, 3)]
    assert {r.status for r in got["sound"]} == {"proposed"}
    named = {"faulty": "nope", "without": "no rules", "prose": "no rules", "words": "type", "numbered": "type", "listed": "min_value"}
    for refused, word in named.items():
        assert len(got[refused]) == 1 and word in got[refused][0].refusal, refused


def test_without_a_limit_all_rules_are_judged(frame, schema, profiled):
    many = [spec("table_row_count_to_be_between", min_value=i) for i in range(1, 30)]
    got = proposals(frame, schema, profiled, {"many": json.dumps({"rules": many})}, limit=None)["many"]
    assert [r.statement for r in got] == [f"Row count is at least {i}" for i in range(1, 30)]


def test_replies_become_drafts_or_refusals(frame, schema):
    replies = {
        "draft": {"check": spec("column_values_to_be_between", column="x", min_value=0)},
        "pair": {"cannot": "multi_column", "why": "\t one column per rule \n"},
        "vague": {"cannot": "unclear", "why": "so " * 400},
        "other": {"cannot": "tired"},
        "both": {"cannot": "multi_column", "check": spec("column_to_exist", column="x")},
        "invalid": {"check": spec("column_to_exist", column="nope")},
        "untyped": {"check": {"type": 3}},
        "empty": {},
        "null": {"cannot": None, "check": spec("column_to_exist", column="x")},
    }
    rows = frame([(k, "t", json.dumps(v)) for k, v in replies.items()], "reply_id string, table string, reply string")
    got = {r.reply_id: r for r in intake.classify(rows, schema).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "draft": None, "pair": "multi_column", "vague": "unclear", "other": "unclear", "both": "multi_column",
        "invalid": "invalid", "untyped": "unclear", "empty": "unclear", "null": None,
    }
    assert got["draft"].statement == "Every x is at least 0" and got["draft"].message is None
    assert got["pair"].detail == "one column per rule" and got["vague"].detail == ("so " * 400).strip()
    refused = [r for r in got.values() if r.outcome == "refused"]
    assert all(r.message.endswith("Nothing was saved. Your coverage did not change.") for r in refused)
    assert "nope" in got["invalid"].message and got["invalid"].detail is None
