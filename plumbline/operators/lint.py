"""Judging candidate rules before they are stored: a whole table of them at a time.

The reasons are Column expressions over the candidate's type and parameters; the first one
that applies is the one given. Only the column test reads a second table, the live schema.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import regex
from plumbline.functions import spec as S
from plumbline.functions.sqltypes import SQL_TYPES
from plumbline.plans.catalog import RULE_TYPES, RuleType

NOT_IN_CATALOG = "is no rule type of the catalog"


def _shown(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("nothing"))


def _by_type(type_name: Column, parameters: Callable[[RuleType], Sequence[str]]) -> Column:
    """A list of names per rule type, looked up in one constant map."""
    lists = [
        x
        for e in RULE_TYPES
        for x in (F.lit(e.name), F.array(*[F.lit(n) for n in parameters(e)]).cast("array<string>"))
    ]
    return F.try_element_at(F.create_map(*lists), type_name)


def _has(check: str, type_name: Column) -> Column:
    return type_name.isin([e.name for e in RULE_TYPES if check in e.checks])


def unknown_type(type_name: Column, params: Column) -> Column:
    known = type_name.isin([e.name for e in RULE_TYPES])
    reason = F.concat(F.coalesce(type_name, F.lit("no type")), F.lit(" " + NOT_IN_CATALOG))
    return F.when(~F.coalesce(known, F.lit(False)), reason)


def unknown_parameters(type_name: Column, params: Column) -> Column:
    allowed = _by_type(type_name, lambda e: e.parameters)
    extra = F.array_sort(F.array_except(F.map_keys(params), allowed))
    return F.when(
        F.size(extra) > 0,
        F.concat(type_name, F.lit(": "), F.array_join(extra, ", "), F.lit(" is not a parameter of this check")),
    )


def missing_parameters(type_name: Column, params: Column) -> Column:
    required = _by_type(type_name, lambda e: e.required)
    absent = F.array_sort(F.array_except(required, F.map_keys(params)))
    return F.when(
        F.size(absent) > 0,
        F.concat(type_name, F.lit(": missing "), F.array_join(absent, ", ")),
    )


def bad_tolerance(type_name: Column, params: Column) -> Column:
    given = F.array_contains(F.map_keys(params), "mostly")
    value = S.number(F.try_element_at(params, F.lit("mostly")))
    fine = F.coalesce(value.between(0, 1), F.lit(False))
    shown = _shown(F.try_element_at(params, F.lit("mostly")))
    return F.when(
        given & ~fine,
        F.concat(type_name, F.lit(": mostly="), shown, F.lit(" is not a proportion between 0 and 1")),
    )


def no_bound(type_name: Column, params: Column) -> Column:
    neither = S.argument(params, "min_value").isNull() & S.argument(params, "max_value").isNull()
    return F.when(
        _has("at_least_one_bound", type_name) & neither,
        F.concat(type_name, F.lit(": neither min_value nor max_value was given")),
    )


def inverted_bounds(type_name: Column, params: Column) -> Column:
    """Numbers compare as numbers and texts as texts; bounds of different kinds are let through."""
    low, high = S.argument(params, "min_value"), S.argument(params, "max_value")
    both_text = (F.schema_of_variant(low) == "STRING") & (F.schema_of_variant(high) == "STRING")
    inverted = F.coalesce(S.number(low) > S.number(high), F.lit(False)) | F.coalesce(
        both_text & (S.text(low) > S.text(high)), F.lit(False)
    )
    reason = F.concat(
        type_name, F.lit(": min_value="), _shown(low), F.lit(" is above max_value="), _shown(high)
    )
    return F.when(_has("ordered_bounds", type_name) & inverted, reason)


def empty_set(type_name: Column, params: Column) -> Column:
    """An empty list, an empty text, a null, a zero and a false all hold nothing."""
    def empty(name: str) -> Column:
        value = F.try_element_at(params, F.lit(name))
        holds_nothing = F.to_json(value).isin("[]", '""', "null", "0", "false", "{}", "0.0")
        given = F.array_contains(F.map_keys(params), name)
        return F.when(given & F.coalesce(holds_nothing, F.lit(True)),
                      F.concat(type_name, F.lit(f": {name} is empty")))

    return F.when(
        _has("non_empty_set", type_name), F.coalesce(empty("value_set"), empty("type_list"))
    )


def bad_pattern(type_name: Column, params: Column) -> Column:
    given = F.try_element_at(params, F.lit("regex"))
    pattern = F.when(F.schema_of_variant(given) == "STRING", S.text(given))
    reason = F.concat(type_name, F.lit(": regex "), _shown(given), F.lit(" does not compile"))
    return F.when(_has("compilable_regex", type_name) & ~regex.compiles(pattern), reason)


def unknown_sql_type(type_name: Column, params: Column) -> Column:
    single = F.try_element_at(params, F.lit("type_"))
    listed = S.elements(F.try_element_at(params, F.lit("type_list")))
    names = F.when(single.isNotNull(), F.array(single)).otherwise(listed)
    wrong = F.filter(
        names,
        lambda v: ~F.coalesce(
            (F.schema_of_variant(v) == "STRING") & F.upper(S.text(v)).isin(list(SQL_TYPES)),
            F.lit(False),
        ),
    )
    first = F.to_json(F.try_element_at(wrong, F.lit(1)))
    reason = F.concat(type_name, F.lit(": "), first, F.lit(" is not a SQL type name"))
    unreadable = F.concat(type_name, F.lit(": "), _shown(F.coalesce(single, F.try_element_at(params, F.lit("type_list")))), F.lit(" is not a SQL type name"))
    return F.when(
        _has("known_sql_type", type_name),
        F.when(names.isNull(), unreadable).when(F.size(wrong) > 0, reason),
    )


def unverified_column(
    type_name: Column, params: Column, table: Column, column_known: Column, table_known: Column
) -> Column:
    """Refused when no schema was there to look in, and when the schema has no such column."""
    given = F.array_contains(F.map_keys(params), "column")
    shown = _shown(F.try_element_at(params, F.lit("column")))
    unread = F.concat(
        type_name, F.lit(": no schema of "), table, F.lit(" to look for the column "), shown
    )
    absent = F.concat(type_name, F.lit(": "), table, F.lit(" has no column "), shown)
    return F.when(given & ~table_known, unread).when(given & ~column_known, absent)


# The order in which faults are looked for; the schema test comes after all of them.
FAULTS = (
    unknown_type, unknown_parameters, missing_parameters, bad_tolerance,
    no_bound, inverted_bounds, empty_set, bad_pattern, unknown_sql_type,
)


def lint(candidates: DataFrame, schema: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Candidates with ``ok`` and the first ``reason`` against each.

    ``candidates`` has ``table`` and ``spec`` (JSON text), and ``key`` names the columns that
    tell candidates apart. ``schema`` has one row per ``table`` and ``column``; without one,
    every rule that names a column is refused.
    """
    named_apart = candidates.withColumnsRenamed({"type": "__given_type"})
    parsed = S.with_parsed(named_apart).withColumnsRenamed({"type": "__type"}).withColumnsRenamed(
        {"__given_type": "type"}
    )
    parsed = parsed.withColumn("__kwargs", F.coalesce("__kwargs", _no_kwargs()))
    named = F.try_element_at(F.col("__kwargs"), F.lit("column"))
    parsed = parsed.withColumn(
        "__column", F.when(F.schema_of_variant(named) == "STRING", S.text(named))
    )
    looked_up = _with_schema(parsed, schema)
    arguments = (F.col("__type"), F.col("__kwargs"))
    faults = [fault(*arguments) for fault in FAULTS]
    faults.append(
        unverified_column(*arguments, F.col("table"), F.col("__column_known"), F.col("__table_known"))
    )
    judged = looked_up.withColumn("reason", F.coalesce(*faults))
    return judged.select(
        *candidates.columns, F.col("reason").isNull().alias("ok"), "reason"
    )


def _no_kwargs() -> Column:
    return F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")
    )


def _with_schema(parsed: DataFrame, schema: DataFrame | None) -> DataFrame:
    if schema is None:
        return parsed.withColumns({"__column_known": F.lit(False), "__table_known": F.lit(False)})
    columns = schema.select(
        "table", F.col("column").alias("__column"), F.lit(True).alias("__found")
    ).distinct()
    tables = schema.select("table", F.lit(True).alias("__listed")).distinct()
    # a table with a large share of the candidates is split at run time, on their side
    joined = parsed.join(columns, ["table", "__column"], "left").join(tables, ["table"], "left")
    return joined.withColumns(
        {
            "__column_known": F.coalesce("__found", F.lit(False)),
            "__table_known": F.coalesce("__listed", F.lit(False)),
        }
    )
