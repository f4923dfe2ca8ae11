"""The fifteen rule types this package runs, as data.

Everything that needs to know what a rule type takes (lint, the sentence, the suite) reads
this list. ``shape`` says which result a type has: ``row`` types count violating rows,
``aggregate`` and ``table`` types only report an observed value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.local import local_frame


@dataclass(frozen=True)
class RuleType:
    name: str
    family: str
    shape: str
    sentence: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()

    @property
    def parameters(self) -> tuple[str, ...]:
        return self.required + self.optional


BOUNDS = ("at_least_one_bound", "ordered_bounds")

# Rule type names, sentence templates and parameter names.
RULE_TYPES: tuple[RuleType, ...] = (
    RuleType(
        "expect_column_values_to_not_be_null", "nulls", "row",
        "Every {column} has a value", ("column",), ("mostly",),
    ),
    RuleType(
        "expect_column_values_to_be_null", "nulls", "row",
        "Every {column} is empty", ("column",), ("mostly",),
    ),
    RuleType(
        "expect_column_values_to_be_unique", "uniqueness", "row",
        "No two rows share the same {column}", ("column",), ("mostly",),
    ),
    RuleType(
        "expect_column_unique_value_count_to_be_between", "uniqueness", "aggregate",
        "{column} holds between {min_value} and {max_value} distinct values",
        ("column",), ("min_value", "max_value"), BOUNDS,
    ),
    RuleType(
        "expect_column_values_to_be_in_set", "value sets", "row",
        "Every {column} is one of {value_set}",
        ("column", "value_set"), ("mostly",), ("non_empty_set",),
    ),
    RuleType(
        "expect_column_values_to_not_be_in_set", "value sets", "row",
        "No {column} is one of {value_set}",
        ("column", "value_set"), ("mostly",), ("non_empty_set",),
    ),
    RuleType(
        "expect_column_values_to_be_between", "ranges", "row",
        "Every {column} is between {min_value} and {max_value}",
        ("column",), ("min_value", "max_value", "mostly"), BOUNDS,
    ),
    RuleType(
        "expect_column_mean_to_be_between", "ranges", "aggregate",
        "The average {column} is between {min_value} and {max_value}",
        ("column",), ("min_value", "max_value"), BOUNDS,
    ),
    RuleType(
        "expect_column_values_to_match_regex", "regex/format", "row",
        "Every {column} matches the pattern {regex}",
        ("column", "regex"), ("mostly",), ("compilable_regex",),
    ),
    RuleType(
        "expect_column_values_to_not_match_regex", "regex/format", "row",
        "No {column} matches the pattern {regex}",
        ("column", "regex"), ("mostly",), ("compilable_regex",),
    ),
    RuleType(
        "expect_column_value_lengths_to_be_between", "regex/format", "row",
        "Every {column} is between {min_value} and {max_value} characters long",
        ("column",), ("min_value", "max_value", "mostly"), BOUNDS,
    ),
    RuleType(
        "expect_column_values_to_be_of_type", "type", "row",
        "Every {column} is stored as {type_}",
        ("column", "type_"), ("mostly",), ("known_sql_type",),
    ),
    RuleType(
        "expect_column_values_to_be_in_type_list", "type", "row",
        "Every {column} is stored as one of {type_list}",
        ("column", "type_list"), ("mostly",), ("non_empty_set", "known_sql_type"),
    ),
    RuleType(
        "expect_table_row_count_to_be_between", "row count", "table",
        "Row count is between {min_value} and {max_value}",
        (), ("min_value", "max_value"), BOUNDS,
    ),
    RuleType(
        "expect_column_to_exist", "column existence", "table",
        "The column {column} exists", ("column",),
    ),
)

BY_NAME: dict[str, RuleType] = {entry.name: entry for entry in RULE_TYPES}

# The phrase every two-bound sentence shares; a rule with one bound replaces it.
BOTH_BOUNDS = "between {min_value} and {max_value}"
LOWER_ONLY = "at least {min_value}"
UPPER_ONLY = "at most {max_value}"


def catalog(spark: SparkSession) -> DataFrame:
    """The rule types as a DataFrame, one row per type, in catalog order."""
    return local_frame(
        spark,
        [
            (i, e.name, e.family, e.shape, e.sentence, list(e.required), list(e.optional), list(e.checks))
            for i, e in enumerate(RULE_TYPES)
        ],
        "position int, type string, family string, shape string, sentence string, "
        "required array<string>, optional array<string>, checks array<string>",
    )
