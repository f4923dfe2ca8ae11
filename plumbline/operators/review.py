"""The review queue: rules that wait for a person, with each one's place in its table's queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import spec as S
from plumbline.functions import text
from plumbline.operators.history import latest_per_table
from plumbline.operators.intake import with_evidence
from plumbline.operators.ranges import in_ranges, written
from plumbline.operators.registry import ACCEPTED, NEEDS_REVIEW, current, described


def failing_results(records: DataFrame) -> DataFrame:
    """``table, spec_key, failing, magnitude`` of the failed rules of each table's latest run."""
    # runs are ranked with what failed in them alone
    bad = F.filter("results", lambda r: r["verdict"] == "failed")
    kept = F.transform(bad, lambda r: F.struct(r["spec_key"].alias("spec_key"), r["status"].alias("failing"), r["magnitude"].alias("magnitude")))
    narrow = records.select("table", "record_id", "finished_at", kept.alias("failed"))
    return latest_per_table(narrow).select("table", F.inline("failed")).dropDuplicates(["table", "spec_key"])


def review_queue(rules: DataFrame, records: DataFrame, table: str | None = None) -> DataFrame:
    """Rules held for review, and accepted rules whose exact spec failed in the latest run.

    Only accepted rules carry a verdict, and they are matched by what they say: a rule amended
    since the run no longer matches the verdict on its former self.
    """
    if table is not None:
        rules = rules.filter(F.col("table") == table)
        records = records.filter(F.col("table") == table)
    newest = current(rules)
    held = newest.filter(F.col("status") == NEEDS_REVIEW)
    running = S.with_spec_key(newest.filter(F.col("status") == ACCEPTED))
    failed = running.join(failing_results(records), ["table", "spec_key"]).drop("spec_key")
    return failed.unionByName(held, allowMissingColumns=True)


def with_position(queue: DataFrame) -> DataFrame:
    """Each item with ``position`` (by rule id) and ``total`` within its own table.

    The queue is computed once, as bounds are drawn from it before it is dealt, and kept in ranges of
    table and rule id, whatever the ids look like. An item's position is its rank in its range after the table's items in the ranges
    before. So a table with a third of all items is ranked by many tasks, and only the sizes of
    ranges are brought together.
    """
    ranged = in_ranges(written(queue), [F.col("table").asc(), F.col("rule_id").asc()])
    sizes = ranged.groupBy("table", "_part").agg(F.count(F.lit(1)).alias("__size"))
    by_table = Window.partitionBy("table").orderBy("_part")
    offsets = sizes.withColumns(
        {
            "__before": F.sum("__size").over(by_table) - F.col("__size"),
            "total": F.sum("__size").over(Window.partitionBy("table")),
        }
    ).drop("__size")
    ranked = ranged.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("table", "_part").orderBy("rule_id"))
    )
    return (
        ranked.join(offsets, ["table", "_part"])
        .withColumn("position", (F.col("__before") + F.col("__rank")).cast("bigint"))
        .drop("__before", "__rank", "_part")
    )


def with_budget(positioned: DataFrame) -> DataFrame:
    return positioned.withColumn(
        "budget", text.budget(F.col("position"), F.col("total"), F.col("table"))
    )


def awaiting(
    rules: DataFrame, records: DataFrame, profiled: DataFrame, table: str | None = None
) -> DataFrame:
    """The queue as it is shown: sentence, evidence, failing verdict, place and time left."""
    queue = with_budget(with_position(review_queue(rules, records, table)))
    dressed = with_evidence(described(queue), profiled)
    return dressed.select(
        "table", "rule_id", "revision", "column", "status", "state_label", "statement",
        "evidence", "failing", "magnitude", "position", "total", "budget", "reason",
    ).orderBy("table", "position")
