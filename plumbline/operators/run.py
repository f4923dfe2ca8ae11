"""Running the rules stored for a table, from their revisions to the record of the run."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import registry, suite
from plumbline.operators import results as R
from plumbline.sources.local import local_frame
from plumbline.sources.tables import Scan


class Run(NamedTuple):
    """What a run left: a row per rule, the run with its status or refusal, and its record."""

    results: DataFrame
    run: DataFrame
    record: DataFrame


def stored_specs(rules: DataFrame, table: str) -> list[dict]:
    """The accepted specs of one table, each once however many rules say it."""
    return suite.specs_of(rules.sparkSession, registry.executable(rules.filter(F.col("table") == table)))


def run_table(
    df: DataFrame,
    table: str,
    rules: DataFrame,
    run_id: str,
    id_cols: Sequence[str] = (),
    scan: Scan | None = None,
    finished_at: Column | None = None,
    n: int = suite.SAMPLE_ROWS,
) -> Run:
    """Runs the accepted rules of ``table`` over ``df``: one suite, its evidence, and the record.

    Of ``rules`` (revisions) the newest of each rule counts. ``record`` has no row when the run may
    not be recorded, and ``run`` says why; a table without accepted rules is such a run.
    """
    spark = df.sparkSession
    specs = stored_specs(rules, table)
    if specs:
        found = suite.run_with_evidence(df, specs, id_cols, scan, n).withColumn("run_id", F.lit(run_id))
        found = local_frame(spark, found.collect(), found.schema)  # a row per rule
    else:
        found = local_frame(spark, [], "run_id string, spec string, spec_key string, position int, verdict string")
    total = df.count() if scan is None else scan.total_rows
    seen = total if scan is None else scan.scanned_rows
    runs = local_frame(spark, [(run_id, table, seen, total)], "run_id string, table string, scanned_rows bigint, total_rows bigint")
    submitted = found.select("run_id", "spec", "spec_key")
    return Run(found, R.completed_runs(runs, submitted, found), R.assemble_runs(runs, submitted, found, finished_at))
