"""The append-only tables: rule revisions, run records, profiles. Written to, never rewritten.

Each is laid out by table: an append writes to the folders of the tables it names, and a filter on
``table`` reads one folder. A table without a name (null or empty) is read back as null. Stores
that were written without folders are read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.operators.registry import REVISION_COLUMNS, REVISION_SCHEMA

RECORD_COLUMNS = (
    "record_id", "table", "status", "scanned_rows", "total_rows", "coverage", "results",
    "finished_at",
)


def _append(df: DataFrame, path: str) -> None:
    """A table's rows go to few files; those of a table with very many rows are split among tasks at run time."""
    df.hint("rebalance", "table").write.mode("append").partitionBy("table").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """What was appended; names of tables stay texts, whatever they look like."""
    fields = spark.read.parquet(path).schema.fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "table" else f for f in fields])
    return spark.read.schema(texts).parquet(path)


def append_revisions(revisions: DataFrame, path: str) -> None:
    """Append rule revisions; every column must be there, the clock's included."""
    _append(revisions.select(*REVISION_COLUMNS), path)


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVISION_SCHEMA).parquet(path).select(*REVISION_COLUMNS)


def append_records(records: DataFrame, path: str) -> None:
    """Append the records of completed runs."""
    _append(records.select(*RECORD_COLUMNS), path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).select(*RECORD_COLUMNS)


def append_profiles(profiles: DataFrame, path: str) -> None:
    _append(profiles, path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Stored profiles, for ``profile.profiles_of``, which filters by table."""
    return _read(spark, path)
