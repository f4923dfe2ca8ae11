"""Profiling a table: exact counts per column, bounds, small value sets and example rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import sqltypes, text
from plumbline.plans.compile import quoted
from plumbline.sources.local import local_frame

# Sizes and lifetime of a profile.
LOW_CARDINALITY = 20
SAMPLE_ROWS = 20
FRESH_SECONDS = 300

# A sketch holding this many values is exact for any column with up to LOW_CARDINALITY of them.
SKETCH_VALUES = 64

PROFILE_COLUMNS = (
    "table", "column", "position", "data_type", "total_rows", "non_null", "distinct",
    "minimum", "maximum", "values", "estimated",
)


def profile(
    df: DataFrame,
    table: str,
    columns: Sequence[str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row per column: row count, non-nulls, exact distinct count, bounds, values.

    Columns of one type are stacked as ``(column, value)`` pairs in their own type and counted
    per pair, so that a value is shuffled once per map task and never as text; the table is
    read once per type it has, each time only for that type's columns. ``approximate`` estimates
    the distinct counts of columns with many values, which saves shuffling those values; such a
    column is ``estimated`` and has no value set.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        raise ValueError("a profile needs at least one column")
    if approximate:
        return _approximate(df, table, fields)
    families: dict[str, list[T.StructField]] = {}
    for field in fields:
        families.setdefault(_family(field.dataType), []).append(field)
    measured = reduce(DataFrame.unionByName, [_measured(df, group) for group in families.values()])
    return _described(measured, df, table, fields)


def _family(data_type: T.DataType) -> str:
    return "unordered" if isinstance(data_type, sqltypes.UNORDERED) else data_type.simpleString()


def _value(field: T.StructField) -> Column:
    if isinstance(field.dataType, sqltypes.UNORDERED):
        return F.to_json(sqltypes.in_order(quoted(field.name), field.dataType))
    return quoted(field.name)


def _text(value: Column, data_type: T.DataType) -> Column:
    """A value as text; bytes as hexadecimal digits, since not all are UTF-8."""
    return F.hex(value) if isinstance(data_type, T.BinaryType) else value.cast("string")


def value_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``position, value, n`` for columns of one type: each column's distinct values, counted."""
    names = [str(df.columns.index(f.name)) for f in fields]
    stacked = df.select(*[_value(f).alias(n) for f, n in zip(fields, names, strict=True)])
    pairs = stacked.unpivot([], names, "position", "value")
    return pairs.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))


def _measured(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    counts = value_counts(df, fields)
    present = F.col("value").isNotNull()
    data_type = fields[0].dataType
    shown = _text(F.col("value"), data_type)
    ordered = not isinstance(fields[0].dataType, sqltypes.UNORDERED)
    nothing = F.lit(None).cast("string")
    return counts.groupBy("position").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("value").alias("distinct"),
        (_text(F.min("value"), data_type) if ordered else F.first(nothing)).alias("minimum"),
        (_text(F.max("value"), data_type) if ordered else F.first(nothing)).alias("maximum"),
        _sketch(shown).alias("sketch"),
        F.lit(False).alias("estimated"),
    )


def _sketch(shown: Column) -> Column:
    return F.call_function("approx_top_k", shown, F.lit(LOW_CARDINALITY + 1), F.lit(SKETCH_VALUES))


def _described(
    measured: DataFrame, df: DataFrame, table: str, fields: Sequence[T.StructField]
) -> DataFrame:
    """The measured rows with their names; a table with no rows still lists its columns."""
    listed = local_frame(
        df.sparkSession,
        [(str(df.columns.index(f.name)), f.name, f.dataType.simpleString()) for f in fields],
        "position string, column string, data_type string",
    )
    few = (F.col("distinct") > 0) & (F.col("distinct") <= LOW_CARDINALITY)
    items = F.array_sort(F.filter(F.col("sketch.item"), lambda v: v.isNotNull()))
    zero = F.lit(0).cast("bigint")
    return (
        listed.join(measured, "position", "left")
        .withColumns(
            {
                "table": F.lit(table),
                "position": F.col("position").cast("int"),
                "total_rows": F.coalesce("total_rows", zero),
                "non_null": F.coalesce("non_null", zero),
                "distinct": F.coalesce("distinct", zero),
                # the whole set or nothing: values that print alike are not listed as one
                "values": F.when(few & (F.size(items) == F.col("distinct")), items),
                "estimated": F.coalesce("estimated", F.lit(False)),
            }
        )
        .select(*PROFILE_COLUMNS)
    )


def _approximate(df: DataFrame, table: str, fields: Sequence[T.StructField]) -> DataFrame:
    """Estimated distinct counts from one pass; columns that look small are then counted exactly.

    The estimates (one row) reach the driver, which picks the columns worth grouping.
    """
    estimates = df.agg(
        *[F.approx_count_distinct(_value(f)).alias(str(i)) for i, f in enumerate(fields)]
    ).first()
    small = [f for f, n in zip(fields, estimates, strict=True) if n <= 2 * LOW_CARDINALITY]
    large = [(f, n) for f, n in zip(fields, estimates, strict=True) if n > 2 * LOW_CARDINALITY]
    parts = []
    if small:
        families: dict[str, list[T.StructField]] = {}
        for field in small:
            families.setdefault(_family(field.dataType), []).append(field)
        parts += [_measured(df, group) for group in families.values()]
    if large:
        parts.append(_bounds(df, large))
    return _described(reduce(DataFrame.unionByName, parts), df, table, fields)


def _bounds(df: DataFrame, estimated: Sequence[tuple[T.StructField, int]]) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("rows")]
    rows = []
    for i, (field, distinct) in enumerate(estimated):
        value = _value(field)
        ordered = not isinstance(field.dataType, sqltypes.UNORDERED)
        low, high = (F.min(value), F.max(value)) if ordered else (F.first(F.lit(None)),) * 2
        aggregates += [
            F.count(value).alias(f"non_null_{i}"),
            _text(low, field.dataType).alias(f"minimum_{i}"),
            _text(high, field.dataType).alias(f"maximum_{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(str(df.columns.index(field.name))).alias("position"),
                F.col("rows").alias("total_rows"),
                F.col(f"non_null_{i}").alias("non_null"),
                F.lit(distinct).cast("bigint").alias("distinct"),
                F.col(f"minimum_{i}").alias("minimum"),
                F.col(f"maximum_{i}").alias("maximum"),
                F.lit(None).cast("array<struct<item:string,count:bigint>>").alias("sketch"),
                F.lit(True).alias("estimated"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """``n`` whole rows: those the scan reaches first, or the first by ``order_by``."""
    ordered = df.orderBy(*[quoted(c) for c in order_by]) if order_by else df
    return ordered.limit(n)


def with_evidence_line(profiled: DataFrame) -> DataFrame:
    """The profile with each column's numbers as one sentence."""
    line = text.evidence_line(
        F.col("total_rows"), F.col("non_null"), F.col("distinct"),
        F.col("minimum"), F.col("maximum"), F.col("values"),
    )
    return profiled.withColumn("evidence", line)


def fresh_profiles(
    profiles: DataFrame, now: Column | None = None, seconds: int = FRESH_SECONDS
) -> DataFrame:
    """The stored profiles (column ``profiled_at``) young enough to be used again, none from after now."""
    clock = F.current_timestamp() if now is None else now
    return profiles.filter(
        (F.col("profiled_at") > clock - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("profiled_at") <= clock)
    )


def profiles_of(
    tables: Mapping[str, DataFrame], stored: DataFrame, now: Column | None = None, seconds: int = FRESH_SECONDS
) -> DataFrame:
    """A profile of each table: its newest stored one while that is fresh, or a new one, stamped ``now``.

    ``stored`` has the columns of a profile and ``profiled_at``. ``reused`` tells the two apart;
    the new ones are what is left to append. Only names of tables reach the driver.
    """
    fresh = fresh_profiles(stored.filter(F.col("table").isin(list(tables))), now, seconds)
    newest = fresh.groupBy("table").agg(F.max("profiled_at").alias("profiled_at"))
    kept = fresh.join(newest, ["table", "profiled_at"], "left_semi").withColumn("reused", F.lit(True))
    known = {row.table for row in newest.select("table").collect()}
    new = [stamped(profile(df, name), now) for name, df in tables.items() if name not in known]
    columns = [*PROFILE_COLUMNS, "profiled_at", "reused"]
    taken = [df.withColumn("reused", F.lit(False)).select(*columns) for df in new]
    return reduce(DataFrame.unionByName, taken, kept.select(*columns))


def stamped(profiled: DataFrame, at: Column | None = None) -> DataFrame:
    """A profile with the time it was taken, ready to be appended to a table of profiles."""
    return profiled.withColumn("profiled_at", F.current_timestamp() if at is None else at)
