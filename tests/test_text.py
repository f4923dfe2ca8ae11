"""The rendered sentences, word for word."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "bad, rows, line",
    [
        (42, 9_600, "42 violating rows · of 9,600 rows scanned · 0.44%"),
        (0, 73, "0 violating rows · of 73 rows scanned · 0.00%"),
        (3, 2_000_000, "3 violating rows · of 2,000,000 rows scanned · <0.01%"),
        (1, 3, "1 violating rows · of 3 rows scanned · 33.33%"),
        (5_040, 5_040, "5,040 violating rows · of 5,040 rows scanned · 100.00%"),
        (0, 0, "0 violating rows · of 0 rows scanned · 0.00%"),
    ],
)
def test_magnitude(spark, bad, rows, line):
    assert one(spark, text.magnitude(F.lit(bad), F.lit(rows))) == line


def test_magnitude_of_nothing_counted(spark):
    assert one(spark, text.magnitude(F.lit(None).cast("bigint"), F.lit(5))) is None


@pytest.mark.parametrize(
    "verdict, scanned, total, line",
    [
        ("failed", 31, 31, "FAILED"),
        ("passed", 2_500, 80_000, "PASSED · sampled 2,500 / 80,000"),
        ("errored", 6, 6, "ERRORED · rule could not run"),
        ("errored", 1, 6, "ERRORED · rule could not run · sampled 1 / 6"),
    ],
)
def test_status_atom(spark, verdict, scanned, total, line):
    assert one(spark, text.status_atom(F.lit(verdict), F.lit(scanned), F.lit(total))) == line


def test_never_run(spark):
    assert one(spark, text.never_run_atom(F.lit(12))) == "NEVER RUN"
    assert one(spark, text.never_run_atom(F.lit(0))) == "NEVER RUN · NO RULES"


@pytest.mark.parametrize(
    "position, total, line",
    [
        (2, 9, "Decision 2 of 9 for supplier · about 3 minutes left"),
        (7, 9, "Decision 7 of 9 for supplier · about 1 minute left"),
        (9, 9, "Decision 9 of 9 for supplier · the last one"),
        (4, 19, "Decision 4 of 19 for supplier · about 5 minutes left"),
        (1, 50, "Decision 1 of 50 for supplier · about 17 minutes left — past the five minutes this is supposed to take"),
        (0, 9, None), (10, 9, None), (1, 0, None), (-3, 9, None),
    ],
)
def test_budget(spark, position, total, line):
    assert one(spark, text.budget(F.lit(position), F.lit(total), F.lit("supplier"))) == line


SENTENCES = [
    ("column_to_exist", {"column": "tare"}, "The column tare exists"),
    ("column_mean_to_be_between", {"column": "tare", "max_value": 80}, "The average tare is at most 80"),
    ("column_value_lengths_to_be_between", {"column": "code", "min_value": 2, "max_value": 7.0}, "Every code is between 2 and 7 characters long"),
    ("column_values_to_be_between", {"column": "tare", "min_value": 0.5, "max_value": None}, "Every tare is at least 0.5"),
    ("column_values_to_be_between", {"column": "tare", "min_value": -3.0, "max_value": 12}, "Every tare is between -3 and 12"),
    ("column_unique_value_count_to_be_between", {"column": "port", "min_value": 6}, "port holds at least 6 distinct values"),
    ("column_values_to_be_in_set", {"column": "port", "value_set": [False, 8.0, "Ghent"]}, "Every port is one of False, 8, Ghent"),
    ("column_values_to_not_be_in_set", {"column": "port", "value_set": ["Ghent"]}, "No port is one of Ghent"),
    ("column_values_to_not_match_regex", {"column": "code", "regex": "{mostly}{2}"}, "No code matches the pattern {mostly}{2}"),
    ("column_values_to_be_in_type_list", {"column": "tare", "type_list": ["REAL"]}, "Every tare is stored as one of REAL"),
    ("column_values_to_be_of_type", {"column": "tare", "type_": "real"}, "Every tare is stored as real"),
    ("column_values_to_be_null", {"column": "note", "mostly": 0.25}, "Every note is empty, in at least 25% of rows"),
    ("column_values_to_not_be_null", {"column": "note", "mostly": 1.0}, "Every note has a value"),
    ("column_values_to_be_unique", {"column": "code"}, "No two rows share the same code"),
    ("table_row_count_to_be_between", {"max_value": 40_000}, "Row count is at most 40000"),
    ("table_columns_to_be_sorted", {"columns": ["a"]}, None),
]


def test_statements(spark, frame):
    rows = [(i, json.dumps({"type": f"expect_{t}", "kwargs": k})) for i, (t, k, _) in enumerate(SENTENCES)]
    told = text.with_sentence(frame(rows, "i int, spec string")).collect()
    assert {r.i: r.statement for r in told} == {i: s for i, (_, _, s) in enumerate(SENTENCES)}


def test_spec_key_ignores_order_spelling_nulls_and_provenance(frame):
    same = [
        '{"type":"t","kwargs":{"column":"x","min_value":100,"value_set":[2,"2",null]}}',
        '{"kwargs":{"value_set":[2.0,"2",null],"min_value":100.0,"column":"x"},"type":"t"}',
        '{"type":"t","kwargs":{"column":"x","min_value":1e2,"value_set":[2e0,"2",null]}}',
        '{"type":"t","kwargs":{"column":"x","min_value":1E+2,"value_set":[2,"2",null],"max_value":null,"batch_id":"b"}}',
    ]
    other = [
        '{"type":"t","kwargs":{"column":"x","min_value":"100","value_set":[2,"2",null]}}',
        '{"type":"t","kwargs":{"column":"x","min_value":100.5,"value_set":[2,"2",null]}}',
        '{"type":"t","kwargs":{"column":"x","min_value":100,"value_set":[2,"2"]}}',
        '{"type":"t","kwargs":{"column":"x","min_value":100,"value_set":["2",2,null]}}',
        '{"type":"u","kwargs":{"column":"x","min_value":100,"value_set":[2,"2",null]}}',
    ]
    told = text.with_sentence(frame([(s,) for s in same + other], "spec string"))
    keys = {r.spec: r.spec_key for r in told.collect()}
    assert len({keys[s] for s in same}) == 1
    assert len(set(keys.values())) == 1 + len(other)


def test_evidence_row(spark):
    assert one(spark, text.evidence_row([F.lit(77)], F.lit(12.5))) == "#77 12.5"
    assert one(spark, text.evidence_row([F.lit(8), F.lit("b")], F.lit(None).cast("string"))) == "#8 #b (empty)"
    assert one(spark, text.evidence_row([], F.lit("Ghent"))) == "Ghent"
