"""Running a table's rules: every count of a suite in one pass over the table.

All conditional counts, means and the row count come from one scan, which counts rows by the mask of
the rules they violate. Uniqueness, distinct counts and long value sets need a column's values grouped;
each such column is read once more on its own, however many rules ask about it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import regex, sqltypes, text
from plumbline.functions.spec import with_spec_key
from plumbline.plans.compile import Check, as_double, compile_rules, literals, patterns, quoted
from plumbline.sources.local import local_frame
from plumbline.sources.tables import Scan

SAMPLE_ROWS = 20

METRICS = {
    "position": "int", "element_count": "bigint", "non_null_count": "bigint",
    "checked_count": "bigint", "unexpected_count": "bigint", "observed": "string",
    "observed_number": "double",
}

RULE_SCHEMA = (
    "position int, type string, column string, spec string, spec_key string, statement string, "
    "mostly double, low double, high double, known_success boolean, known_observed string, "
    "detail string"
)

RESULT_COLUMNS = (
    "position", "type", "column", "spec", "spec_key", "statement", "verdict", "status",
    "element_count", "missing_count", "missing_percent", "unexpected_count",
    "unexpected_percent", "unexpected_percent_total", "observed", "observed_number",
    "magnitude", "detail", "scanned_rows", "total_rows",
)


def compiled(df: DataFrame, specs: Sequence[Mapping[str, Any]]) -> list[Check]:
    """The specs made ready for this table, each with its sentence and its key."""
    spark = df.sparkSession
    broken = regex.failing_patterns(spark, patterns(specs))
    broken |= sqltypes.failing_literals(spark, literals(df.schema, specs))
    checks = compile_rules(df.schema, specs, broken)
    if not checks:
        return []
    told = text.with_sentence(
        local_frame(spark, [(c.position, c.spec) for c in checks], "position int, spec string")
    )
    spoken = {row.position: row for row in told.select("position", "spec_key", "statement").collect()}
    return [
        replace(c, spec_key=spoken[c.position].spec_key, statement=spoken[c.position].statement)
        for c in checks
    ]


def run_suite(
    df: DataFrame, specs: Sequence[Mapping[str, Any]], scan: Scan | None = None
) -> DataFrame:
    """One row per rule: counts, verdict and rendered lines. Lazy; refuses an empty suite.

    ``scan`` says how many rows the table has, where the rows given are part of it.
    """
    if not specs:
        raise ValueError("a suite with no rules checks nothing")
    return results_of(df, compiled(df, specs), scan)


def results_of(df: DataFrame, checks: Sequence[Check], scan: Scan | None = None) -> DataFrame:
    return rendered(metrics(df, checks), checks, scan)


# --- metrics -------------------------------------------------------------------------

#: Rules that one mask has a bit for; a longer suite has several masks a row, all from one scan.
MASK_BITS = 20
#: Conditions that whole-stage code holds.
LONG = 40
#: Parts that violating rows are dealt into, each with its first key, to bound the first rows of all.
BUCKETS = 64
#: Masks that stand for a column's infinite and NaN values; its other values go by their exponent.
NAN, INFINITE, MINUS_INFINITE = 9999, 9998, 9997
#: A double is a whole number of three parts of so many bits, times a power of two.
PART_BITS = 19


@dataclass(frozen=True)
class First:
    """The rows wanted of each rule: the ``n`` first ones by a key that compares like the row's own key."""

    key: Column
    n: int


def metrics(df: DataFrame, checks: Sequence[Check], first: First | None = None) -> DataFrame:
    """The numbers of every check, one row each; with ``first`` also a ``bound``.

    No more than the wanted rows need keys above the bound: it is not below the last of them. It is
    null where fewer rows violate the rule, and for checks on grouped values.
    """
    grouped: dict[str, list[Check]] = {}
    counted, known = [], []
    for check in checks:
        if check.kind in ("unique", "distinct", "members"):
            grouped.setdefault(check.column, []).append(check)
        elif check.kind in ("row", "mean"):
            counted.append(check)
        else:
            known.append(check)
    counted.sort(key=lambda c: c.column)
    parts = [_scanned(df, counted + known, first)] if counted or known else []
    for column, members in grouped.items():
        part = _grouped(df, column, members)
        parts.append(part if first is None else part.withColumn("bound", F.lit(None).cast(_key_type(df, first))))
    return reduce(DataFrame.unionByName, parts)


def _key_type(df: DataFrame, first: First) -> T.DataType:
    return df.select(first.key.alias("key")).schema["key"].dataType


def _rows_of(counts: DataFrame, rows: Sequence[Mapping[str, str]], extra: str = "") -> DataFrame:
    """One row of counts turned into a row per check; each says which count is which metric."""
    structs = [
        "struct(" + ", ".join(
            f"cast({row.get(name, 'null')} as {kind}) as {name}" for name, kind in METRICS.items()
        ) + (f", {row.get(extra, 'null')} as {extra}" if extra else "") + ")"
        for row in rows
    ]
    return counts.selectExpr(f"inline(array({', '.join(structs)}))")


def violated(check: Check) -> Column:
    """Whether a row violates a check that looks at rows one by one."""
    present = F.lit(True) if check.counts_nulls else quoted(check.column).isNotNull()
    return F.coalesce(check.violation & present, F.lit(False))


def _scanned(df: DataFrame, checks: Sequence[Check], first: First | None) -> DataFrame:
    """Every count and mean of one scan.

    A row becomes the masks of the rules it violates and of the columns it has no value in, and rows are
    counted by mask before the shuffle; the counts of rules are sums over the masks, of which there are
    few. A mean's column adds its values as whole numbers, by their exponents, so that no order of rows
    or partitions changes the sum.
    """
    columns = sorted({c.column for c in checks if c.kind == "row" and not c.counts_nulls})
    rules = {f"bad_{c.position}": c.violation for c in checks if c.kind == "row"}
    nulls = {f"null_{i}": quoted(c).isNull() for i, c in enumerate(columns)}
    means = sorted({c.column for c in checks if c.kind == "mean"})
    summed = _masked(df, rules | nulls, means, first, bounded=list(rules))
    null_of = {column: f"null_{i}" for i, column in enumerate(columns)}
    mean_of = {column: f"mean_{i}" for i, column in enumerate(means)}
    rows = [_scanned_row(c, null_of, mean_of) for c in checks]
    if first is None:
        return _rows_of(summed, rows)
    kind = _key_type(df, first).simpleString()
    for check, row in zip(checks, rows, strict=True):
        row["bound"] = f"bound_bad_{check.position}" if check.kind == "row" else f"cast(null as {kind})"
    return _rows_of(summed, rows, "bound")


def _masked(
    df: DataFrame, bits: Mapping[str, Column], means: Sequence[str] = (), first: First | None = None, bounded: Sequence[str] = ()
) -> DataFrame:
    """One row: ``rows``, under its name how many rows have each bit, ``mean_i`` and for bounded bits ``bound_`` and the name."""
    names = list(bits)
    masks = [names[i : i + MASK_BITS] for i in range(0, len(names), MASK_BITS)] or [[]]
    keys = [] if first is None else [
        first.key.alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int").alias("bucket")
    ]
    kept = ["key", "bucket"] if keys else []
    if first is None and not means and len(names) <= LONG:
        # few counts need no masks: one aggregate without keys
        return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in bits.items()])
    rows = df.select(*keys, *[c.alias(name) for name, c in bits.items()], *[quoted(c).cast("double").alias(f"x_{i}") for i, c in enumerate(means)])
    made = [" | ".join([f"if({name}, {1 << j}, 0)" for j, name in enumerate(mask)] or ["0"]) for mask in masks]
    if len(names) > LONG:
        made[0] += " | " + _INTERPRETED.format(x=names[0])
    rows = rows.selectExpr(*kept, *[f"{mask} as mask_{i}" for i, mask in enumerate(made)], *[f"x_{i}" for i in range(len(means))])
    if len(masks) == 1 and not means:
        rows = rows.selectExpr(*kept, "0 as entry", "mask_0 as mask")
    else:
        of = range(len(means))
        if means:
            rows = rows.selectExpr("*", *[f"{_EXPONENT.format(x=f'x_{i}')} as e_{i}" for i in of])
            rows = rows.selectExpr("*", *[f"{_NUMBER.format(x=f'x_{i}', e=f'e_{i}')} as m_{i}" for i in of])
        nothing = ", cast(null as bigint) as p0, cast(null as bigint) as p1, cast(null as bigint) as p2" if means else ""
        entries = [f"struct({i} as entry, mask_{i} as mask{nothing})" for i in range(len(masks))]
        entries += [f"struct({-1 - i} as entry, {_PARTS.format(x=f'x_{i}', e=f'e_{i}', m=f'm_{i}')})" for i in of]
        rows = rows.selectExpr(*kept, f"inline(array({', '.join(entries)}))")
    aggregates = [F.count(F.lit(1)).alias("n")]
    aggregates += [F.sum(p).alias(p) for p in ("p0", "p1", "p2") if means] + ([F.min("key").alias("low")] if keys else [])
    counts = rows.groupBy("entry", "mask", *kept[1:]).agg(*aggregates)
    told = ["coalesce(sum(case when entry = 0 then n end), 0) as rows"]
    for i, mask in enumerate(masks):
        for j, name in enumerate(mask):
            has = f"entry = {i} and (mask & {1 << j}) <> 0"
            told.append(f"coalesce(sum(case when {has} then n end), 0) as {name}")
            if name in bounded and first is not None:
                told.append(f"get(array_sort(collect_list(case when {has} then low end)), {first.n - 1}) as bound_{name}")
    for i in range(len(means)):
        told.append(f"collect_list(case when entry = {-1 - i} then struct(mask, n, p0, p1, p2) end) as sums_{i}")
    summed = counts.agg(*[F.expr(x) for x in told])
    if not means:
        return summed
    of = range(len(means))
    summed = summed.withColumns({f"sums_{i}": F.expr(_SUMS.format(sums=f"sums_{i}")) for i in of})
    summed = summed.withColumns({f"n_{i}": F.expr(_COUNT.format(sums=f"sums_{i}")) for i in of})
    return summed.withColumns({f"mean_{i}": F.expr(_MEAN.format(sums=f"sums_{i}", n=f"n_{i}")) for i in of})


# Always 0, but Spark interprets it, and so generates the projection that holds it in many small methods;
# whole-stage code would be one method, which is too long for the compiler when there are many rules.
_INTERPRETED = "cast(exists(array(isnull({x})), y -> y is null) as int)"

# A double as an exponent (its mask) and a whole number in three parts; a null has no parts. The exponent
# is two lower than it need be, for what the logarithm may be off, and is applied in two steps, as the
# lowest powers of two lose digits.
_FINITE = "{x} is not null and not isnan({x}) and abs({x}) < double('Infinity')"
_EXPONENT = f"case when {_FINITE} then greatest(cast(floor(log2(greatest(abs({{x}}), 5e-324D))) as int) - 54, -1074) end"
_NUMBER = "case when {e} is not null then cast({x} / pow(2D, greatest({e}, -1000)) * pow(2D, greatest(-1000 - {e}, 0)) as bigint) end"
_REST = (1 << PART_BITS) - 1
_PARTS = (
    f"case when {{x}} is null then null when isnan({{x}}) then {NAN} when {{e}} is not null then {{e}} "
    f"when {{x}} > 0 then {INFINITE} else {MINUS_INFINITE} end as mask, "
    f"{{m}} & {_REST}L as p0, shiftright({{m}}, {PART_BITS}) & {_REST}L as p1, shiftright({{m}}, {2 * PART_BITS}) as p2"
)
# The mean from the sums by exponent: each sum is divided exactly, and they are added from the smallest.
_TOTAL = (
    f"cast(cast(s.p2 as decimal(38,0)) * {1 << 2 * PART_BITS}L + cast(s.p1 as decimal(38,0)) * {1 << PART_BITS}L + s.p0 as decimal(38,0))"
)
_SUMS = f"transform(filter({{sums}}, s -> s.mask is not null), s -> struct(s.mask as mask, s.n as n, {_TOTAL} as t))"
_COUNT = "aggregate({sums}, 0L, (a, s) -> a + s.n)"
_MEAN = (
    f"case when {{n}} = 0 then cast(null as double) "
    f"when exists({{sums}}, s -> s.mask = {NAN}) or exists({{sums}}, s -> s.mask = {INFINITE}) and exists({{sums}}, s -> s.mask = {MINUS_INFINITE}) then double('NaN') "
    f"when exists({{sums}}, s -> s.mask = {INFINITE}) then double('Infinity') "
    f"when exists({{sums}}, s -> s.mask = {MINUS_INFINITE}) then double('-Infinity') "
    f"else aggregate(array_sort(filter({{sums}}, s -> s.mask < {MINUS_INFINITE})), 0D, "
    f"(a, s) -> a + (cast((s.t - s.t % {{n}}) / {{n}} as double) + cast(s.t % {{n}} as double) / {{n}}) "
    f"* pow(2D, greatest(s.mask, -1000)) * pow(2D, least(s.mask + 1000, 0))) end"
)


def _scanned_row(check: Check, nulls: Mapping[str, str], means: Mapping[str, str]) -> dict[str, str]:
    row = {"position": str(check.position), "element_count": "rows"}
    if check.kind == "row" and check.counts_nulls:
        return row | {"checked_count": "rows", "unexpected_count": f"bad_{check.position}"}
    if check.kind == "row":
        present = f"rows - {nulls[check.column]}"
        return row | {
            "non_null_count": present,
            "checked_count": present,
            "unexpected_count": f"bad_{check.position}",
        }
    if check.kind == "mean":
        return row | dict.fromkeys(("observed", "observed_number"), means[check.column])
    if check.kind == "rows":
        return row | dict.fromkeys(("observed", "observed_number"), "rows")
    return row


def group_key(df: DataFrame, column: str) -> Column:
    """A column as something rows can be grouped by; values with no equality go by their text."""
    data_type = df.schema[column].dataType
    if isinstance(data_type, T.MapType | T.StructType | T.VariantType):
        return F.to_json(sqltypes.in_order(quoted(column), data_type))
    return quoted(column)


def digest_key(df: DataFrame, column: str) -> Column:
    """What equal values of a column share and others don't: texts and bytes go by their SHA-256.

    So no value travels to be counted, however long it is; 32 bytes do.
    """
    data_type = df.schema[column].dataType
    plain_text = isinstance(data_type, sqltypes.TEXT) and getattr(data_type, "collation", "UTF8_BINARY") == "UTF8_BINARY"
    if plain_text or isinstance(data_type, T.BinaryType | T.MapType | T.StructType | T.VariantType):
        return F.unhex(F.sha2(group_key(df, column).cast("binary"), 256))
    return group_key(df, column)


def grouped_values(df: DataFrame, column: str) -> DataFrame:
    """``value`` and ``n``: each distinct value with its rows, counted before the shuffle."""
    return df.groupBy(group_key(df, column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _grouped(df: DataFrame, column: str, checks: Sequence[Check]) -> DataFrame:
    # only value sets have to see the values themselves
    key = group_key if any(c.kind == "members" for c in checks) else digest_key
    values = df.groupBy(key(df, column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    aggregates = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("present"),
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(present & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("shared"),
    ]
    for check in checks:
        if check.kind == "members":
            flag = f"member_{check.position}"
            values = values.join(_members(df, check, flag), "value", "left")
            found = F.col(flag).isNotNull()
            violating = found if check.negated else present & ~found
            bad = F.sum(F.when(violating, F.col("n")))
            aggregates.append(F.coalesce(bad, F.lit(0)).alias(f"bad_{check.position}"))
    return _rows_of(values.agg(*aggregates), [_grouped_row(c) for c in checks])


def _grouped_row(check: Check) -> dict[str, str]:
    row = {"position": str(check.position), "element_count": "rows"}
    if check.kind == "distinct":
        return row | dict.fromkeys(("observed", "observed_number"), "distinct")
    bad = "shared" if check.kind == "unique" else f"bad_{check.position}"
    return row | {"non_null_count": "present", "checked_count": "present", "unexpected_count": bad}


def _members(df: DataFrame, check: Check, flag: str) -> DataFrame:
    """A long value set as a table in the column's type, which holds every member exactly."""
    data_type = df.schema[check.column].dataType
    if isinstance(data_type, T.FloatType | T.DoubleType):
        literal, given = "double", [(float(m),) for m in check.members]
    elif isinstance(data_type, T.IntegralType):
        literal, given = "bigint", [(int(m),) for m in check.members]
    elif isinstance(data_type, T.BooleanType):
        literal, given = "boolean", [(m,) for m in check.members]
    else:
        shown = [repr(m) if isinstance(m, float) else str(m) for m in check.members]
        literal, given = "string", [(m,) for m in shown]
    frame = local_frame(df.sparkSession, given, f"value {literal}")
    return frame.select(F.col("value").cast(data_type)).distinct().withColumn(flag, F.lit(True))


# --- verdicts and lines --------------------------------------------------------------


def verdict(success: Column, detail: Column) -> Column:
    """A rule that raised is ``errored``, never ``failed``; otherwise success decides."""
    return F.when(detail.isNotNull(), "errored").when(success, "passed").otherwise("failed")


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide((F.lit(100) * part).cast("double"), whole.cast("double"))


def described(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    """What is known of each check without reading data: as many rows as the suite has rules."""
    def bound(value: Any) -> float | None:
        return None if value is None else as_double(value)

    return local_frame(
        spark,
        [
            (
                c.position, c.type, c.column, c.spec, c.spec_key, c.statement, c.mostly,
                bound(c.low), bound(c.high), c.success if c.kind == "schema" else None,
                c.observed, c.detail,
            )
            for c in checks
        ],
        RULE_SCHEMA,
    )


def _success() -> Column:
    c = F.col
    share = (c("checked_count") - c("unexpected_count")).cast("double") / F.nullif(
        c("checked_count"), F.lit(0)
    ).cast("double")
    tolerated = (c("checked_count") == 0) | (share >= c("mostly"))
    number = c("observed_number")
    within = (c("low").isNull() | (number >= c("low"))) & (c("high").isNull() | (number <= c("high")))
    return (
        F.when(c("unexpected_count").isNotNull(), tolerated)
        .when(c("known_success").isNotNull(), c("known_success"))
        .otherwise(F.coalesce(number.isNotNull() & within, F.lit(False)))
    )


def rendered(
    measured: DataFrame, checks: Sequence[Check], scan: Scan | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The numbers with their rule, verdict, proportions and rendered lines."""
    c = F.col
    rules = F.broadcast(described(measured.sparkSession, checks))
    total = c("element_count") if scan is None else F.lit(scan.total_rows).cast("bigint")
    missing = c("element_count") - c("non_null_count")
    judged = measured.join(rules, "position").withColumns(
        {
            "verdict": verdict(_success(), c("detail")),
            "observed": F.coalesce("observed", "known_observed"),
            "scanned_rows": c("element_count"),
            "total_rows": total,
            "missing_count": missing,
            "missing_percent": percent(missing, c("element_count")),
            "unexpected_percent": percent(c("unexpected_count"), c("checked_count")),
            "unexpected_percent_total": F.when(
                missing.isNotNull(), percent(c("unexpected_count"), c("element_count"))
            ),
            "magnitude": text.magnitude(c("unexpected_count"), c("element_count")),
        }
    )
    status = text.status_atom(c("verdict"), c("scanned_rows"), c("total_rows"))
    return judged.withColumn("status", status).select(*RESULT_COLUMNS, *keep)


# --- violating rows ------------------------------------------------------------------


def violating_rows(df: DataFrame, check: Check) -> DataFrame:
    """Every violating row of one check, lazily. Meant to be written, never collected."""
    if not check.counted:
        raise ValueError(f"{check.type} has no violating rows to list")
    if check.kind == "row":
        violation = check.violation
        return df.filter(violation if check.counts_nulls else violation & quoted(check.column).isNotNull())
    values = _violating_values(df, check).select(F.col("value").alias("__key"))
    keyed = df.withColumn("__key", _key_of(df, check))
    # a value with a large share of the rows is split at run time, on the side of the rows
    return keyed.join(values, "__key", "left_semi").drop("__key")


def _key_of(df: DataFrame, check: Check) -> Column:
    """What a grouped check tells values apart by."""
    return (digest_key if check.kind == "unique" else group_key)(df, check.column)


def _violating_values(df: DataFrame, check: Check, first: Column | None = None) -> DataFrame:
    """The keys of column values whose rows violate a grouped check, with row counts and their first row key."""
    # a value with a row that lacks a key starts before all others
    lowest = [] if first is None else [F.when(F.count_if(F.col("key").isNull()) == 0, F.min("key")).alias("first")]
    values = (
        df.filter(quoted(check.column).isNotNull())
        .select(_key_of(df, check).alias("value"), *([] if first is None else [first.alias("key")]))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), *lowest)
    )
    if check.kind == "unique":
        return values.filter(F.col("n") > 1)
    members = _members(df, check, "member").select("value")
    return values.join(members, "value", "left_semi" if check.negated else "left_anti")


def _one(df: DataFrame, spec: Mapping[str, Any]) -> Check:
    (check,) = compiled(df, [spec])
    if check.detail is not None:
        raise ValueError(check.detail)
    return check


def violations(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Every row that violates one rule."""
    return violating_rows(df, _one(df, spec))


def violation_counts(df: DataFrame, spec: Mapping[str, Any], n: int | None = SAMPLE_ROWS) -> DataFrame:
    """The ``n`` most frequent offending values (all without ``n``), with the rows each one accounts for."""
    check = _one(df, spec)
    if check.kind == "unique":
        values = grouped_values(df, check.column).filter(F.col("value").isNotNull() & (F.col("n") > 1))
    elif check.kind == "members":
        values = _violating_values(df, check).select("value", "n")
    else:
        values = grouped_values(violating_rows(df, check), check.column)
    ranked = values.orderBy(F.desc("n"), F.col("value").cast("string"))
    return (ranked if n is None else ranked.limit(n)).select("value", F.col("n").alias("rows"))


def sample_violations(
    df: DataFrame, spec: Mapping[str, Any], n: int = SAMPLE_ROWS, id_cols: Sequence[str] = ()
) -> DataFrame:
    """Up to ``n`` offending values; with key columns, those of the first rows by key."""
    check = _one(df, spec)
    return _first_rows(df, check, id_cols, n).select(quoted(check.column).alias("value"))


def evidence(
    df: DataFrame, spec: Mapping[str, Any], id_cols: Sequence[str], n: int = SAMPLE_ROWS
) -> DataFrame:
    """Up to ``n`` offending rows: key columns, the value, and both as one line of text."""
    check = _one(df, spec)
    return _first_rows(df, check, id_cols, n).select(
        *[quoted(c) for c in id_cols],
        quoted(check.column).alias("value"),
        _evidence_text(df, check, id_cols).alias("evidence"),
    )


def _evidence_text(df: DataFrame, check: Check, id_cols: Sequence[str]) -> Column:
    keys = [quoted(c) for c in id_cols if c != check.column]
    return text.evidence_row(keys, _printable(df, check.column))


def _printable(df: DataFrame, column: str) -> Column:
    complex_type = isinstance(df.schema[column].dataType, sqltypes.UNORDERED)
    return F.to_json(quoted(column)) if complex_type else quoted(column).cast("string")


def _first_rows(df: DataFrame, check: Check, id_cols: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` violating rows by key: a top-n per partition, never a full sort."""
    if not check.counted:
        raise ValueError(f"{check.type} has no violating rows to list")
    wanted = [quoted(c) for c in dict.fromkeys([*id_cols, check.column])]
    rows, (hit,) = _hits(df, [check], id_cols, n, {check.position: (0, None)})
    rows = rows.where(hit).select(*wanted)
    order = [quoted(c) for c in id_cols]
    return (rows.orderBy(*order) if order else rows).limit(n)


def order_key(df: DataFrame, id_cols: Sequence[str]) -> Column | None:
    """A number in the order of the rows' keys, equal for some that differ; None where rows have no key.

    It is the first key column, or the first bytes of it, so that hashed aggregates can keep its
    minimum. A null comes before all.
    """
    if not id_cols:
        return None
    key, kind = quoted(id_cols[0]), df.schema[id_cols[0]].dataType
    if isinstance(kind, T.NumericType | T.DateType | T.TimestampNTZType):
        return key
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.BooleanType):
        return key.cast("int")
    if isinstance(kind, sqltypes.TEXT) or isinstance(kind, T.BinaryType):
        digits = F.rpad(F.hex(F.substring(key.cast("binary"), 1, 14)), 28, "0")
        half = lambda at: F.conv(F.substring(digits, at, 14), 16, 10).cast("decimal(18,0)")
        return (half(1) * F.lit(1 << 56) + half(15)).cast("decimal(38,0)")
    return None


def _limit(bound: Any, kind: T.DataType) -> Column:
    """A bound as the scan gave it, as a literal of the key's type; times go as text, in no time zone."""
    return F.lit(bound.isoformat() if isinstance(bound, date) else bound).cast(kind)


#: Violating rows up to which a rule's first rows are found without a bound.
FEW_ROWS = 1000


def _hits(
    df: DataFrame, checks: Sequence[Check], id_cols: Sequence[str], n: int, counted: Mapping[int, tuple[int | None, Any]]
) -> tuple[DataFrame, list[Column]]:
    """The rows, and for each check whether a row violates it and may be among its first ``n`` by key.

    ``counted`` has what is known of checks by position: how many rows violate it, and the bound of their
    keys. Rules that lack a bound and have many rows are bounded together by one scan of the keys.
    Grouped checks choose the values that start earliest; as a rule their hashes, ``n`` at most, are
    part of the scan's own condition. What ties with the last of them is joined.
    """
    key = order_key(df, id_cols)
    rows, hits, bounds = df, [], []
    for check in checks:
        many, bound = counted.get(check.position, (None, None))
        if check.kind == "row":
            hit = violated(check)
        else:
            hashed = F.xxhash64(_key_of(df, check))
            values = _violating_values(df, check, F.lit(0) if key is None else key)
            low = F.col("first").asc_nulls_first()
            firsts = values.orderBy(low, F.xxhash64("value")).select("first", F.xxhash64("value").alias("hash")).limit(n + 1).collect()
            present = quoted(check.column).isNotNull()
            last = firsts[n - 1].first if len(firsts) > n else None
            if len(firsts) <= n or key is None or (last is not None and firsts[n].first > last):
                hit = present & hashed.isin([r.hash for r in firsts[:n]])
            else:
                name = f"__hash_{check.position}"
                starts = F.col("first").isNull()
                tied = values.where(starts if last is None else starts | (F.col("first") <= _limit(last, _key_type(df, First(key, n)))))
                tied = tied.select(F.xxhash64("value").alias(name)).distinct().withColumn(f"__hit_{check.position}", F.lit(True))
                rows = rows.withColumn(name, F.when(present, hashed)).join(tied, name, "left")
                hit = F.col(f"__hit_{check.position}").isNotNull()
            bound = last if len(firsts) > n else None
        hits.append(hit)
        bounds.append((many, bound))
    if key is None:
        return rows, hits
    loose = [i for i, (many, bound) in enumerate(bounds) if bound is None and (many is None or many > FEW_ROWS)]
    if loose:
        bits = {f"bad_{i}": hits[i] for i in loose}
        found = _masked(rows, bits, (), First(key, n), list(bits)).first()
        for i in loose:
            bounds[i] = (None, found[f"bound_bad_{i}"])
    kind = _key_type(df, First(key, n))
    limits = [bound for _, bound in bounds]
    near = [F.lit(True) if b is None else key.isNull() | (key <= _limit(b, kind)) for b in limits]
    if all(b is not None for b in limits):
        # one condition on the key alone, which the scan can use; NaN is above all
        highest = max(limits, key=lambda b: (b != b, b))
        rows = rows.where(key.isNull() | (key <= _limit(highest, kind)))
    return rows, [near_ & hit for near_, hit in zip(near, hits, strict=True)]


def run_with_evidence(
    df: DataFrame,
    specs: Sequence[Mapping[str, Any]],
    id_cols: Sequence[str] = (),
    scan: Scan | None = None,
    n: int = SAMPLE_ROWS,
) -> DataFrame:
    """``run_suite`` with up to ``n`` offending values and identified rows per rule.

    The counts come first (one row per rule reaches the driver), and with them a bound of the first keys
    of each rule's violating rows; the rows up to these bounds are then looked up together.
    """
    if not specs:
        raise ValueError("a suite with no rules checks nothing")
    checks = compiled(df, specs)
    counted, bounds = counted_with_bounds(df, checks, id_cols, scan, n)
    found = {row.position for row in counted if row.unexpected_count}
    kept = local_frame(df.sparkSession, counted, results_of(df, checks, scan).schema)
    return with_evidence(kept, df, [c for c in checks if c.position in found], id_cols, n, bounds)


def counted_with_bounds(
    df: DataFrame, checks: Sequence[Check], id_cols: Sequence[str], scan: Scan | None = None, n: int = SAMPLE_ROWS
) -> tuple[list[Row], dict[int, tuple[int | None, Any]]]:
    """The results of all checks, and by position how many rows violate each and the bound of the first keys."""
    key = order_key(df, id_cols)
    if key is None:
        rows = results_of(df, checks, scan).collect()
        return rows, {r.position: (r.unexpected_count, None) for r in rows}
    measured = metrics(df, checks, First(key, n))
    results = rendered(measured, checks, scan, keep=("bound",)).collect()
    rows = [Row(*RESULT_COLUMNS)(*[r[c] for c in RESULT_COLUMNS]) for r in results]
    return rows, {r.position: (r.unexpected_count, r.bound) for r in results}


def with_evidence(
    results: DataFrame, df: DataFrame, checks: Sequence[Check], id_cols: Sequence[str], n: int,
    counted: Mapping[int, tuple[int | None, Any]] | None = None,
) -> DataFrame:
    """Results with the first ``n`` violating rows of each check, all found in one scan of the table.

    Only rows up to a bound of their key go on, with the positions of the rules they violate, and only
    those are sorted. Each task sends at most ``n`` rows per rule.
    """
    empty = F.array().cast("array<string>")
    if not checks:
        return results.withColumns({"samples": empty, "evidence": empty, "identified": empty})
    listed = (
        _violating_first(df, checks, id_cols, n, counted or {})
        .groupBy("position")
        .agg(F.array_sort(F.collect_list(F.struct("key", "line", "value", "row"))).alias("rows"))
        .select(
            "position",
            F.col("rows.value").alias("samples"),
            F.col("rows.line").alias("evidence"),
            F.col("rows.row").alias("identified"),
        )
    )
    joined = results.join(listed, "position", "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("samples", "evidence", "identified")})


def _violating_first(
    df: DataFrame, checks: Sequence[Check], id_cols: Sequence[str], n: int, counted: Mapping[int, tuple[int | None, Any]]
) -> DataFrame:
    """``position, key, value, line, row``: at most ``n`` rows per check, numbered by key."""
    wanted = list(dict.fromkeys([*id_cols, *[c.column for c in checks]]))
    rows, hits = _hits(df, checks, id_cols, n, counted)
    broken = F.array_compact(F.array(*[F.when(hit, F.lit(c.position)) for c, hit in zip(checks, hits, strict=True)]))
    rows = rows.where(reduce(lambda a, b: a | b, hits)).select(*[quoted(c) for c in wanted], F.explode(broken).alias("__position"))
    order = [quoted(c) for c in id_cols] or [F.monotonically_increasing_id()]
    first = F.row_number().over(Window.partitionBy("__position").orderBy(*order))
    hits = rows.withColumn("__key", first).filter(F.col("__key") <= n)

    def by_check(shown) -> Column:
        return F.coalesce(*[F.when(F.col("__position") == c.position, shown(c)) for c in checks])

    return hits.select(
        F.col("__position").alias("position"),
        F.col("__key").alias("key"),
        by_check(lambda c: _printable(df, c.column)).alias("value"),
        by_check(lambda c: _evidence_text(df, c, id_cols)).alias("line"),
        by_check(lambda c: F.to_json(F.struct(*[quoted(x) for x in dict.fromkeys([*id_cols, c.column])]))).alias("row"),
    )


def run_isolated(
    df: DataFrame, specs: Sequence[Mapping[str, Any]], scan: Scan | None = None
) -> DataFrame:
    """``run_suite``, run at once, in which a rule that raises is errored and the others stand.

    The whole suite is one job; only when that job fails is each rule run on its own.
    """
    if not specs:
        raise ValueError("a suite with no rules checks nothing")
    checks = compiled(df, specs)
    results = results_of(df, checks, scan)
    try:
        rows = results.collect()
    except Exception:
        rows = _one_by_one(df, checks, scan)
    return local_frame(df.sparkSession, rows, results.schema)


def _one_by_one(df: DataFrame, checks: Sequence[Check], scan: Scan | None) -> list[Row]:
    settled: list[Row | Exception] = []
    for check in checks:
        try:
            settled.append(results_of(df, [check], scan).first())
        except Exception as exc:
            settled.append(exc)
    scanned = next((r.element_count for r in settled if isinstance(r, Row)), None)
    return [
        errored_result(df, check, r, scanned, scan) if isinstance(r, Exception) else r
        for check, r in zip(checks, settled, strict=True)
    ]


def errored_result(
    df: DataFrame, check: Check, exc: Exception, scanned: int | None, scan: Scan | None = None
) -> Row:
    """The result of a rule whose job raised: nothing was counted, and the reason is its detail."""
    reason = f"{type(exc).__name__}: {exc}" if str(exc) else type(exc).__name__
    failed = replace(check, kind="errored", violation=None, detail=reason)
    counted = local_frame(df.sparkSession, [(scanned,)], "rows bigint")
    return rendered(_rows_of(counted, [{"position": str(check.position), "element_count": "rows"}]), [failed], scan).first()


def specs_of(spark: SparkSession, executable: DataFrame) -> list[dict[str, Any]]:
    """One table's accepted specs for ``run_suite``, each once, in the order of their first rule.

    The driver compiles a suite, so it sees as many specs as the table has different rules.
    """
    keyed = executable if "spec_key" in executable.columns else with_spec_key(executable)
    once = keyed.groupBy("spec_key").agg(F.min("rule_id").alias("rule_id"), F.min_by("spec", "rule_id").alias("spec"))
    return [json.loads(row.spec) for row in once.orderBy("rule_id").collect()]
