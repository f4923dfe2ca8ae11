"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.operators import audit, profile, suite
from plumbline.session import local_session
from plumbline.sources.tables import Scan
from plumbline.streaming.progressive import run_progressive
from workload import audits, history
from workload.checks import LINEITEM_SUITE, spec
from workload.derived import TABLES, table

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
RULES = [rule for rule, _ in LINEITEM_SUITE]
KEYS = ["l_orderkey", "l_linenumber"]

ALONE = {
    "rule_not_null": 0, "rule_between": 1, "rule_in_set": 2, "rule_unique": 3, "rule_match_regex": 4,
    "rule_not_match_regex": 5, "rule_lengths": 6, "rule_not_in_set": 7, "rule_in_type_list": 8,
    "rule_of_type": 9, "rule_mean": 10, "rule_unique_value_count": 11, "rule_row_count": 12,
    "rule_exists": 13, "rule_null": 14,
}


def many_rules(n: int) -> list[dict]:
    """``n`` different range rules over the numeric columns."""
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
    return [
        spec("column_values_to_be_between", column=columns[i % len(columns)], min_value=i // len(columns))
        for i in range(n)
    ]


def written(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def audit_set(spark, sf_dir):
    """Thirteen audits as one result, the row predicates of a table in one pass."""
    names = (
        "audit_out_of_order", "audit_column_pair", "audit_orphans", "audit_orphan_lines",
        "audit_reconciliation", "audit_incomplete", "audit_duplicates", "audit_duplicate_keys",
        "audit_future",
    )
    single = audit.named({n: audits.QUERIES[n](spark, sf_dir) for n in names})
    return single.unionByName(audits.audit_row_predicates(spark, sf_dir))


def timed(spark, sf_dir) -> dict:
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")

    def with_ids(rules, df=lineitem, scan: Scan | None = None):
        return lambda: suite.run_with_evidence(df, rules, KEYS, scan).collect()

    def without_ids(rules):
        return lambda: suite.run_suite(lineitem, rules).collect()

    narrow = spec("column_values_to_be_between", column="l_extendedprice", min_value=1000)
    wide = spec("column_values_to_be_null", column="l_shipdate")
    queries = {f"suite_{n}": with_ids(RULES[:n]) for n in (1, 3, 8, 10, 15)}
    queries |= {f"suite_{n}_no_ids": without_ids(RULES[:n]) for n in (10, 15)}
    queries["suite_200_ranges_no_ids"] = without_ids(many_rules(200))
    queries |= {name: with_ids([RULES[i]]) for name, i in ALONE.items()}
    queries |= {
        "progressive_3": lambda: list(run_progressive(lineitem, RULES[:3], Scan("lineitem", lineitem.count()), KEYS)),
        "violations_narrow": lambda: written(suite.violations(lineitem, narrow)),
        "violations_wide": lambda: written(suite.violations(lineitem, wide)),
        "violations_unique": lambda: written(suite.violations(lineitem, RULES[3])),
        "profile_orders": lambda: profile.profile(orders, "orders").collect(),
        "profile_lineitem": lambda: profile.profile(lineitem, "lineitem").collect(),
        "profile_lineitem_sketched": lambda: profile.profile(lineitem, "lineitem", approximate=True).collect(),
        "audit_13": lambda: audit_set(spark, sf_dir).collect(),
        "fingerprint": lambda: audits.fingerprint(spark, sf_dir).collect(),
        "table_sizes": lambda: audit.table_sizes({n: table(spark, sf_dir, n) for n in TABLES}).collect(),
        "coverage_ranking": lambda: written(history.coverage_ranking(spark, sf_dir)),
        "review_queue": lambda: written(history.review_queue(spark, sf_dir)),
    }
    return queries


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    seconds = {}
    runs = {name: run for name, run in timed(spark, sf_dir).items() if not only or name in only}
    for run in runs.values():  # all lines once, so that none is timed on cold code
        run()
    for name, run in runs.items():
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "table_quality_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
