"""Running a suite while someone waits: each verdict handed over, in order, as it lands.

Rules that look at rows one by one share a scan for their counts and one for their evidence; each
column whose values are grouped has its own two. These groups run side by side, so the number of
scans follows the columns that need grouping, not the rules, and cheap verdicts don't wait for dear
ones that come after them. The table is not cached: each group reads its own columns only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import results as R
from plumbline.operators.suite import (
    SAMPLE_ROWS,
    compiled,
    counted_with_bounds,
    errored_result,
    results_of,
    with_evidence,
)
from plumbline.plans.compile import Check
from plumbline.sources.local import local_frame
from plumbline.sources.tables import Scan

STARTED, VERDICT, COMPLETED = "started", "verdict", "completed"

#: Groups of rules that run side by side, and the scheduler pool of their jobs where the session has pools.
SIDE_BY_SIDE = 4
POOL = "plumbline-progressive"

Event = dict[str, Any]


def run_progressive(
    df: DataFrame,
    specs: Sequence[Mapping[str, Any]],
    scan: Scan,
    id_cols: Sequence[str] = (),
    store: Callable[[DataFrame], None] | None = None,
    run_id: str | None = None,
) -> Iterator[Event]:
    """Yield ``started`` with every rule pending, a ``verdict`` per rule, then ``completed``.

    A rule that raises becomes an errored verdict and the others still run. ``store`` takes the
    finished run's record; when there is none to write, ``completed`` says why.
    """
    spark = df.sparkSession
    checks = compiled(df, specs)
    yield {
        "event": STARTED, "table": scan.table, "total": len(checks), "reported": 0,
        "rules": [
            {"index": c.position, "statement": c.statement, "status": text.PENDING} for c in checks
        ],
    }
    settled = []
    for check, result in zip(checks, _settled(df, checks, scan, id_cols), strict=True):
        settled.append(result)
        yield {
            "event": VERDICT, "index": check.position, "total": len(checks),
            "reported": len(settled), "result": result,
        }
    record_id, detail = _stored(spark, scan, settled, store, run_id)
    yield {
        "event": COMPLETED, "table": scan.table, "total": len(checks), "reported": len(settled),
        "coverage": sum(r["verdict"] != "errored" for r in settled),
        "record_id": record_id, "detail": detail,
    }


def scan_groups(checks: Sequence[Check]) -> list[list[Check]]:
    """The checks that share their scans: all that look at rows, and those on one column's grouped values."""
    groups: dict[str | None, list[Check]] = {}
    for check in checks:
        grouped = check.kind in ("unique", "distinct", "members")
        groups.setdefault(check.column if grouped else None, []).append(check)
    return list(groups.values())


def _settled(
    df: DataFrame, checks: Sequence[Check], scan: Scan, id_cols: Sequence[str]
) -> Iterator[dict[str, Any]]:
    """The result of each check in order, as soon as its group has run; a reader who leaves ends what still runs."""
    spark, tag = df.sparkSession, f"progressive-{uuid.uuid4().hex}"

    def run(group: Sequence[Check]) -> dict[int, dict[str, Any]]:
        spark.addTag(tag)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
        return {r["position"]: r for r in _settle_group(df, group, scan, id_cols)}

    pool = ThreadPoolExecutor(SIDE_BY_SIDE)
    over = False
    try:
        running = {c.position: future for group in scan_groups(checks) for future in [pool.submit(run, group)] for c in group}
        for check in checks:
            yield running[check.position].result()[check.position]
        over = True
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
        if not over:
            spark.interruptTag(tag)


def _settle_group(
    df: DataFrame, checks: Sequence[Check], scan: Scan, id_cols: Sequence[str]
) -> list[dict[str, Any]]:
    """The results of checks that share their scans; one at a time where they fail together."""
    nothing = {"samples": [], "evidence": [], "identified": []}
    try:
        rows, bounds = counted_with_bounds(df, checks, id_cols, scan, SAMPLE_ROWS)
        failing = {row.position for row in rows if row.unexpected_count}
        if not failing:
            return [row.asDict() | nothing for row in rows]
        kept = local_frame(df.sparkSession, rows, results_of(df, checks, scan).schema)
        found = with_evidence(kept, df, [c for c in checks if c.position in failing], id_cols, SAMPLE_ROWS, bounds)
        return [row.asDict() for row in found.collect()]
    except Exception as exc:  # one broken rule may not end the run for the others
        if len(checks) > 1:
            return [result for check in checks for result in _settle_group(df, [check], scan, id_cols)]
        row = errored_result(df, checks[0], exc, scan.scanned_rows, scan)
        return [row.asDict() | nothing]


def _stored(
    spark: SparkSession,
    scan: Scan,
    settled: Sequence[Mapping[str, Any]],
    store: Callable[[DataFrame], None] | None,
    run_id: str | None,
) -> tuple[str | None, str | None]:
    if store is None:
        return None, None
    if not settled:
        return None, "the run finished; the result was not saved. nothing was submitted in this run"
    identity = spark.range(1).select(F.uuid().alias("u")).first().u if run_id is None else run_id
    record = run_record(spark, identity, scan, settled)
    refused = record.filter(F.col("refusal").isNotNull()).first()
    if refused is not None:
        return None, f"the run finished; the result was not saved. {refused.refusal}"
    try:
        store(assembled(spark, identity, scan, settled))
    except Exception as exc:  # the run is over either way, and its last event must come
        return None, f"the run finished; the result was not saved. {type(exc).__name__}: {exc}"
    return identity, None


_RESULT_SCHEMA = (
    "run_id string, position int, spec string, spec_key string, statement string, "
    "verdict string, status string, unexpected_count bigint, magnitude string, "
    "observed string, detail string"
)


def _frames(
    spark: SparkSession, identity: str, scan: Scan, settled: Sequence[Mapping[str, Any]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = local_frame(
        spark,
        [(identity, scan.table, scan.scanned_rows, scan.total_rows)],
        "run_id string, table string, scanned_rows bigint, total_rows bigint",
    )
    names = [part.strip().split(" ")[0] for part in _RESULT_SCHEMA.split(",")]
    results = local_frame(
        spark,
        [tuple({**r, "run_id": identity}.get(n) for n in names) for r in settled], _RESULT_SCHEMA
    )
    return runs, results.select("run_id", "spec", "spec_key"), results


def run_record(
    spark: SparkSession, identity: str, scan: Scan, settled: Sequence[Mapping[str, Any]]
) -> DataFrame:
    return R.completed_runs(*_frames(spark, identity, scan, settled))


def assembled(
    spark: SparkSession, identity: str, scan: Scan, settled: Sequence[Mapping[str, Any]]
) -> DataFrame:
    return R.assemble_runs(*_frames(spark, identity, scan, settled))
