"""Reading a rule spec held as JSON text, and the key under which two specs are the same.

A spec is ``{"type": ..., "kwargs": {...}}``. Variants keep the JSON type of every
parameter, so ``0.98`` and ``"0.98"`` stay apart and ``0`` and ``0.0`` print alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the parameter that names where a rule ran; it is no part of the rule.
PROVENANCE = "batch_id"

KWARGS_TYPE = "map<string,variant>"


def _json(spec: Column | str) -> Column:
    return F.try_parse_json(spec)


def rule_type(spec: Column | str) -> Column:
    """The spec's type, or null when it is missing or is no text."""
    found = F.try_variant_get(_json(spec), "$.type", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def has_object_kwargs(spec: Column | str) -> Column:
    """True when ``kwargs`` is left out or is an object."""
    found = F.try_variant_get(_json(spec), "$.kwargs", "variant")
    return found.isNull() | F.schema_of_variant(found).startswith("OBJECT")


def argument(params: Column, name: str | Column) -> Column:
    """One parameter as a variant; null when it is absent or is a JSON null."""
    value = F.try_element_at(params, F.lit(name))
    return F.when(~F.is_variant_null(value), value)


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def number(value: Column) -> Column:
    """A JSON number as a double; null for anything else, numeric text and booleans included."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")


def elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def canonical(value: Column) -> Column:
    """A parameter as JSON text in which a whole number has one spelling, in a list too."""
    members = F.transform(elements(value), lambda v: F.coalesce(_whole(v), F.to_json(v), F.lit("null")))
    listed = F.concat(F.lit("["), F.array_join(members, ","), F.lit("]"))
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(is_list, listed).otherwise(F.coalesce(_whole(value), F.to_json(value)))


def _whole(value: Column) -> Column:
    """A floating-point number that is whole, as an integer; null for anything else."""
    found = F.try_variant_get(value, "$", "double")
    floating = F.schema_of_variant(value).isin("DOUBLE", "FLOAT")
    # whole numbers below this are exact in a double
    return F.when(floating & (found == F.floor(found)) & (F.abs(found) < 2.0**53), found.cast("bigint").cast("string"))


def identity(spec: Column, type_name: Column, params: Column) -> Column:
    """A rule's identity: its type and parameters, whatever order and spelling they came in.

    A text that is no spec is its own key. The key is never null: joins on it would otherwise
    test it for null first, far below the join, on every row it is computed from.
    """
    kept = F.filter(
        F.map_entries(params), lambda e: (e["key"] != PROVENANCE) & ~F.is_variant_null(e["value"])
    )
    pairs = F.transform(
        kept, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), canonical(e["value"]))
    )
    body = F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit(""))
    key = F.concat(F.lit('["'), type_name, F.lit('",{'), body, F.lit("}]"))
    return F.coalesce(key, spec, F.lit(""))


def with_parsed(rules: DataFrame) -> DataFrame:
    """Rules (``spec``) with ``type`` and ``__kwargs``, each text being parsed once.

    ``type`` is null unless it is a text, ``__kwargs`` unless it is an object.
    """
    parts = F.try_variant_get(_json("spec"), "$", "struct<type:variant,kwargs:variant>")
    parsed = rules.withColumn("__spec", parts)
    found = F.col("__spec.type")
    return parsed.withColumns(
        {
            "type": F.when(F.schema_of_variant(found) == "STRING", text(found)),
            "__kwargs": F.try_variant_get(F.col("__spec.kwargs"), "$", KWARGS_TYPE),
        }
    ).drop("__spec")


def with_spec_key(rules: DataFrame) -> DataFrame:
    """Rules (``spec``) with the ``spec_key`` under which rules that say the same are one."""
    parsed = with_parsed(rules.withColumnsRenamed({"type": "__given_type"}))
    key = identity(F.col("spec"), F.col("type"), F.col("__kwargs"))
    keyed = parsed.withColumn("spec_key", key).drop("type", "__kwargs")
    return keyed.withColumnsRenamed({"__given_type": "type"})
