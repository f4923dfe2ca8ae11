"""Runs registered queries beside their SQL and compares columns, types and rows.

As a script: ``python -m tests.oracle [--sf DIR] [name ...]``.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

from workload.derived import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def kind(name: str) -> str:
    name = name.lower().split("(")[0]
    return {
        "long": "int64", "bigint": "int64", "int": "int32", "integer": "int32", "varchar": "text",
        "string": "text", "timestamp_ntz": "timestamp", "hugeint": "int128",
    }.get(name, name)


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got is not None else "no rows"
    relation = con.sql(sql)
    if sorted(relation.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    odd = [
        f"{f.name}: {f.dataType.simpleString()} and {kinds[f.name]}"
        for f in df.schema.fields
        if kind(f.dataType.simpleString()) != kind(kinds[f.name])
    ]
    wanted = rows_of(relation.columns, relation.fetchall())
    if got != wanted:
        extra, lacking = got - wanted, wanted - got
        return (
            f"{sum(got.values())} rows and {sum(wanted.values())}; "
            f"only here {list(extra)[:2]}; only there {list(lacking)[:2]}"
        )
    return f"types {odd}" if odd else None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from plumbline.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(), connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            fault = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as exc:
            fault = f"{type(exc).__name__}: {str(exc)[:1500]}"
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok ' if fault is None else 'BAD'} {name}{note} {time.time() - start:.1f}s {fault or ''}", flush=True)
        bad += fault is not None
    print(f"{bad} of {len(args.names or queries)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
