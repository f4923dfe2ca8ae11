"""Run history: the latest runs, and tables ranked by what has not been verified.

Records have ``record_id, table, status, scanned_rows, total_rows, coverage, results,
finished_at``; ``results`` is an array, and only completed runs are ever recorded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.ranges import checkpointed
from plumbline.operators.registry import rule_counts
from plumbline.sources.local import local_frame

# The three buckets, in the order they are shown.
NEVER_RUN, UNVERIFIABLE, VERIFIED = "never-run", "unverifiable", "verified"
BUCKETS = (
    (1, NEVER_RUN, "1 · Never run", "no evidence at all — top of the pile"),
    (2, UNVERIFIABLE, "2 · Ran, but unverifiable", "errored or sampled — a result exists, a verdict does not"),
    (3, VERIFIED, "3 · Verified", "full scan completed — pass or fail, the verdict is real"),
)


def latest(records: DataFrame, table: str) -> DataFrame:
    """The newest record of one table, or no row."""
    newest = records.filter(F.col("table") == table)
    return newest.orderBy(F.desc("finished_at"), F.desc("record_id")).limit(1)


def latest_per_table(records: DataFrame) -> DataFrame:
    """The newest record of every table that has one."""
    order = Window.partitionBy("table").orderBy(F.desc("finished_at"), F.desc("record_id"))
    # each task passes on one row per table
    return records.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= 1).drop("__nth")


def find(records: DataFrame, record_id: str) -> DataFrame:
    """One record by id; an id nothing was written under is an error."""
    found = records.filter(F.col("record_id") == record_id)
    if found.isEmpty():
        raise LookupError(f"there is no record of a run {record_id}")
    return found


def bucket(record_id: Column, scanned: Column, total: Column, coverage: Column, rules: Column) -> Column:
    """Never run; run but with a partial scan or a rule that left no evidence; or verified."""
    return (
        F.when(record_id.isNull(), NEVER_RUN)
        .when((scanned < total) | (coverage < rules), UNVERIFIABLE)
        .otherwise(VERIFIED)
    )


def buckets(spark: SparkSession) -> DataFrame:
    return local_frame(spark, BUCKETS, "bucket_no int, bucket string, heading string, why string")


def run_slot(record_id: Column, accepted_rules: Column, status: Column, scanned: Column, total: Column) -> Column:
    """The one string in a table's verdict slot, whether or not it was ever run."""
    return F.when(record_id.isNull(), text.never_run_atom(accepted_rules)).otherwise(
        text.status_atom(status, scanned, total)
    )


def ranked_tables(tables: DataFrame, rules: DataFrame, records: DataFrame) -> DataFrame:
    """Every table with its bucket, verdict slot and accepted rules, in no order."""
    # only the number of results is ranked, not the results
    counted = records.select(
        "table", "record_id", "finished_at", F.col("status").alias("verdict"), "scanned_rows", "total_rows",
        "coverage", F.size("results").alias("rules"),
    )
    newest = latest_per_table(counted).drop("finished_at")
    listed = rule_counts(tables, rules).join(newest, "table", "left")
    c = F.col
    return listed.select(
        "table",
        "approx_rows",
        text.digits(c("approx_rows")).alias("rows"),
        "accepted_rules",
        run_slot(c("record_id"), c("accepted_rules"), c("verdict"), c("scanned_rows"), c("total_rows")).alias("status"),
        "verdict",
        "record_id",
        bucket(c("record_id"), c("scanned_rows"), c("total_rows"), c("coverage"), c("rules")).alias("bucket"),
    )


def coverage_listing(tables: DataFrame, rules: DataFrame, records: DataFrame) -> DataFrame:
    """Tables by bucket, then those without rules, then the bigger ones, then by name.

    All three buckets are there: one without tables is a row that names none.
    """
    ranked = checkpointed(ranked_tables(tables, rules, records))  # a row per table, read twice
    described = buckets(tables.sparkSession)
    rows = ranked.join(F.broadcast(described), "bucket")
    # Three rows at most on either side of the test for empty buckets.
    empty = described.join(ranked.select("bucket").distinct(), "bucket", "left_anti")
    whole = rows.unionByName(empty, allowMissingColumns=True)
    return whole.orderBy(
        "bucket_no", F.coalesce("accepted_rules", F.lit(0)) > 0, F.desc("approx_rows"), "table"
    ).select(
        "bucket_no", "bucket", "heading", "why", "table", "rows", "accepted_rules", "status",
        "verdict", "record_id",
    )
