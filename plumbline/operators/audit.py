"""Audits of a data set: predicates over several columns or tables, counted against a manifest.

Every audit is a one-row DataFrame with one column, ``observed``. Joins are on keys whose rows
were counted first, so a key that holds a large share of a table is one row by then.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.compile import quoted
from plumbline.sources.local import local_frame


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias("observed")


def count_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the predicate holds."""
    return df.agg(F.count_if(predicate).alias("observed"))


def count_each(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Many row predicates of one table in one pass: ``audit, observed``."""
    counts = df.agg(*[F.count_if(p).alias(f"c{i}") for i, p in enumerate(predicates.values())])
    rows = [
        F.struct(F.lit(name).alias("audit"), F.col(f"c{i}").alias("observed"))
        for i, name in enumerate(predicates)
    ]
    return counts.select(F.inline(F.array(*rows)))


def out_of_order(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose ``later`` column is before their ``earlier`` one."""
    return count_rows(df, quoted(later) < quoted(earlier))


def incomplete_when(df: DataFrame, condition: Column, column: str) -> DataFrame:
    """Rows meeting a condition that should have a value and do not."""
    return count_rows(df, condition & quoted(column).isNull())


def later_than(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Rows dated after ``as_of``. The clock is an argument, so the count can be repeated."""
    return count_rows(df, quoted(column) > as_of)


def orphans(df: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """Rows whose key has no row in the reference table; a null key has none either."""
    counted = df.groupBy(quoted(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = reference.select(quoted(reference_key).alias("k")).distinct()
    return counted.join(known, "k", "left_anti").agg(_total(F.col("n")))


def mismatched(
    left: DataFrame, right: DataFrame, on: tuple[str, str], values: tuple[str, str], many: bool = False
) -> DataFrame:
    """Joined rows whose two values differ; nulls never compare, so they are left out.

    One join, for keys with a few rows on a side. With ``many`` rows of a key on both sides nothing
    is joined: for each key the count is (rows on the left) x (rows on the right), less the pairs that agree,
    which are counted per key and value. Rows are counted before either shuffle, so a key with
    a large share of both tables costs no more than its distinct values.
    """
    if not many:
        a = left.select(quoted(on[0]).alias("k"), quoted(values[0]).alias("v")).dropna()
        b = right.select(quoted(on[1]).alias("k"), quoted(values[1]).alias("w")).dropna()
        return a.join(b, "k").agg(F.count_if(F.col("v") != F.col("w")).alias("observed"))

    def side(df: DataFrame, key: str, value: str, a: int, b: int) -> DataFrame:
        present = df.select(quoted(key).alias("k"), quoted(value).alias("v")).dropna()
        return present.withColumns({"a": F.lit(a).cast("bigint"), "b": F.lit(b).cast("bigint")})

    both = side(left, on[0], values[0], 1, 0).unionByName(side(right, on[1], values[1], 0, 1))
    per_value = both.groupBy("k", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    per_key = per_value.groupBy("k").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("agreeing")
    )
    return per_key.agg(_total(F.col("a") * F.col("b") - F.col("agreeing")))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is held by more than one row; rows with a null in the key are left out."""
    columns = [quoted(k) for k in keys]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    groups = df.filter(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.filter(F.col("__n") > 1).agg(_total(F.col("__n")))


def named(audits: Mapping[str, DataFrame]) -> DataFrame:
    """Several audits as one DataFrame: ``audit, observed``."""
    rows = [df.select(F.lit(name).alias("audit"), "observed") for name, df in audits.items()]
    return reduce(DataFrame.unionByName, rows)


def manifest(spark: SparkSession, entries: Sequence[tuple[str, str, int, str]]) -> DataFrame:
    """``audit, table, expected, reach``: what a data set is known to contain."""
    return local_frame(spark, entries, "audit string, table string, expected bigint, reach string")


def verify(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Every manifest entry with its observed count and whether the two agree."""
    joined = expected.join(observed, "audit", "left")
    return joined.withColumn("match", F.coalesce(F.col("expected") == F.col("observed"), F.lit(False)))


def by_reach(expected: DataFrame, count: str = "expected") -> DataFrame:
    """How many defect classes, and how many rows, each kind of rule could catch."""
    return expected.groupBy("reach").agg(
        F.count(F.lit(1)).alias("classes"), F.sum(count).alias("rows")
    )


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The md5 of a row's values as text, each after its length, so that no two rows are one text."""
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    if columns is not None:
        chosen = sorted(chosen, key=lambda f: list(columns).index(f.name))
    parts = []
    for f in chosen:
        plain = not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType)
        shown = quoted(f.name).cast("string") if plain else F.to_json(quoted(f.name))
        sized = F.concat(F.char_length(shown).cast("string"), F.lit(":"), shown)
        parts.append(F.coalesce(sized, F.lit("~")))
    return F.md5(F.concat(F.lit(""), *parts).cast("binary"))


def fingerprint(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that two tables share when they hold the same rows, in whatever order.

    The exclusive-or alone would not see a row that occurs twice, so the sum goes with it, each over
    both 64-bit halves of the hashes.
    """
    digest = df.select(row_hash(df, columns).alias("digest"))
    halves = {name: F.conv(F.substring("digest", at, 16), 16, -10).cast("bigint") for name, at in (("a", 1), ("b", 17))}
    found = [F.count(F.lit(1)).alias("rows")]
    for name, half in halves.items():
        found.append(F.coalesce(F.bit_xor(half), F.lit(0)).alias(f"xor_{name}"))
        found.append(F.coalesce(F.sum(half.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"sum_{name}"))
    return digest.agg(*found).select(F.lit(table).alias("table"), "rows", "xor_a", "sum_a", "xor_b", "sum_b")


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, rows`` for every table."""
    sizes = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, sizes)
