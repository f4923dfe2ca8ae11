"""From results to run records: pairing, roll-up, what counts as a completed run.

``runs`` has ``run_id, table, scanned_rows, total_rows``; ``submitted`` has ``run_id, spec``;
``results`` has one row per run and rule: the columns of a suite's result and ``run_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import spec as S

# Fixed value: verdicts, the loudest first.
PRECEDENCE = ("failed", "errored", "passed")

RESULT_FIELDS = (
    "spec_key", "spec", "statement", "verdict", "status", "unexpected_count", "magnitude",
    "observed", "detail",
)


def with_spec_key(df: DataFrame) -> DataFrame:
    return df if "spec_key" in df.columns else S.with_spec_key(df)


def join_results(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """Each submitted rule with its result, paired by what the rule says and never by position.

    A rule that a run submitted twice has one result, the first that was reported for it.
    """
    rules = with_spec_key(submitted).select("run_id", "spec_key", F.col("spec").alias("submitted_spec"))
    keyed = with_spec_key(results)
    order = [c for c in ("position", "verdict") if c in keyed.columns]
    nth = F.row_number().over(Window.partitionBy("run_id", "spec_key").orderBy(*order))
    once = keyed.withColumn("__nth", nth).filter(F.col("__nth") <= 1).drop("__nth")
    return rules.join(once, ["run_id", "spec_key"])


def missing_results(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """Submitted rules that never reported. A dropped rule is not a rule that passed."""
    reported = with_spec_key(results).select("run_id", "spec_key").distinct()
    return with_spec_key(submitted).join(reported, ["run_id", "spec_key"], "left_anti")


def covered(verdict: Column) -> Column:
    """How many rules checked the data: an errored one did not."""
    return F.count_if(verdict != "errored")


def loudest(verdict: Column) -> Column:
    """A run's status: failed before errored before passed."""
    rank = F.min(F.array_position(F.array(*[F.lit(v) for v in PRECEDENCE]), verdict))
    return F.element_at(F.array(*[F.lit(v) for v in PRECEDENCE]), rank.cast("int"))


def coverage(results: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    return results.groupBy(*by).agg(
        covered(F.col("verdict")).alias("coverage"), F.count(F.lit(1)).alias("rules")
    )


def rollup(results: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    return results.groupBy(*by).agg(loudest(F.col("verdict")).alias("status"))


def completed_runs(runs: DataFrame, submitted: DataFrame, results: DataFrame) -> DataFrame:
    """Every run with its status and coverage, or the reason it may not be recorded.

    Refused are runs that submitted nothing, runs a submitted rule of which has not reported, runs
    with more results than rules, and runs all of whose rules errored. Submitted and reported rules are counted per run and
    rule and then per run, so no run's rules are brought together to be compared.
    """
    asked = with_spec_key(submitted).select(
        "run_id", "spec_key", F.lit(1).alias("asked"), F.lit(None).cast("string").alias("verdict")
    )
    answered = with_spec_key(results).select(
        "run_id", "spec_key", F.lit(0).alias("asked"), "verdict"
    )
    per_rule = (
        asked.unionByName(answered)
        .groupBy("run_id", "spec_key")
        .agg(
            F.sum("asked").alias("asked"),
            F.count("verdict").alias("answers"),
            covered(F.col("verdict")).alias("covered"),
            F.bool_or(F.col("verdict") == "failed").alias("failed"),
            F.bool_or(F.col("verdict") == "errored").alias("errored"),
        )
    )
    per_run = per_rule.groupBy("run_id").agg(
        F.sum("asked").alias("submitted"),
        F.sum(F.when(F.col("answers") > 0, F.col("asked")).otherwise(0)).alias("reported"),
        F.sum("answers").alias("results"),
        F.sum("covered").alias("coverage"),
        F.bool_or("failed").alias("failed"),
        F.bool_or("errored").alias("errored"),
    )
    counts = ("submitted", "reported", "results", "coverage")
    joined = runs.join(per_run, "run_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts}
    )
    refusal = (
        F.when(F.col("submitted") == 0, F.lit("nothing was submitted in this run"))
        .when(
            F.col("reported") < F.col("submitted"),
            F.concat(
                F.lit("results of "), F.col("reported").cast("string"), F.lit(" rules, and "),
                F.col("submitted").cast("string"), F.lit(" were submitted"),
            ),
        )
        .when(
            F.col("results") > F.col("submitted"),
            F.concat(F.col("results").cast("string"), F.lit(" results for "), F.col("submitted").cast("string"), F.lit(" rules")),
        )
        .when(
            F.col("coverage") == 0,
            F.concat(F.lit("no rule ran: all "), F.col("results").cast("string"), F.lit(" errored")),
        )
    )
    status = F.when(F.col("failed"), "failed").when(F.col("errored"), "errored").otherwise("passed")
    return joined.withColumn("refusal", refusal).select(
        *runs.columns, "submitted", "reported", "coverage",
        F.when(F.col("refusal").isNull(), status).alias("status"), "refusal",
    )


def invalid_scans(runs: DataFrame) -> DataFrame:
    """Runs whose scanned count is negative or more than the table holds."""
    fine = (F.col("scanned_rows") >= 0) & (F.col("scanned_rows") <= F.col("total_rows"))
    return runs.filter(~F.coalesce(fine, F.lit(False)))


def assemble_runs(
    runs: DataFrame, submitted: DataFrame, results: DataFrame, finished_at: Column | None = None
) -> DataFrame:
    """The records of the completed runs, their results nested in the order they were submitted.

    Status and coverage come from the verdicts alone. A run with more results than submitted rules
    has no record, so the nested list is as long as one suite.
    """
    complete = completed_runs(runs, submitted, results).filter(F.col("refusal").isNull())
    fields = [c for c in RESULT_FIELDS if c in results.columns or c == "spec_key"]
    keyed = with_spec_key(results)
    position = "position" if "position" in results.columns else "spec_key"
    nested = keyed.join(complete.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), *fields))).alias("results")
    )
    return complete.join(nested, "run_id").select(
        F.col("run_id").cast("string").alias("record_id"), "table", "status",
        "scanned_rows", "total_rows", "coverage", "results",
        (F.current_timestamp() if finished_at is None else finished_at).alias("finished_at"),
    )


def documents(records: DataFrame) -> DataFrame:
    """Records with their results as one JSON text."""
    return records.withColumn("results", F.to_json("results"))
