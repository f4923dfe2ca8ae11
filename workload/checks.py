"""One query per rule type, suites, and the queries over violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import suite
from plumbline.sources.local import local_frame
from plumbline.sources.tables import Scan, scan_where
from plumbline.streaming.progressive import run_progressive
from workload.derived import table

SHOWN = (
    "type", "statement", "verdict", "status", "element_count", "missing_count",
    "unexpected_count", "unexpected_percent", "magnitude", "observed",
)


def spec(rule_type: str, **kwargs) -> dict:
    return {"type": f"expect_{rule_type}", "kwargs": kwargs}


def shown(results: DataFrame) -> DataFrame:
    numbers = {
        "unexpected_percent": F.round("unexpected_percent", 6),
        "observed": F.when(
            F.col("type") == "expect_column_mean_to_be_between",
            F.format_number("observed_number", 2),
        ).otherwise(F.col("observed")),
    }
    return results.withColumns(numbers).select(*SHOWN)


def one_check(name: str, rule: dict, derive=lambda df: df):
    def query(spark, sf_dir):
        return shown(suite.run_suite(derive(table(spark, sf_dir, name)), [rule]))

    return query


# --- the SQL side --------------------------------------------------------------------

SHARE = (
    "case when {share} = 0 or round({share}, 2) <> 0 then printf('%.2f%%', {share}) "
    "else '<0.01%' end"
)


def magnitude_sql(bad: str, rows: str) -> str:
    share = f"(case when {rows} > 0 then cast(100 * {bad} as double) / {rows} else 0.0 end)"
    return (
        f"format('{{:,}} violating rows · of {{:,}} rows scanned · ', {bad}, {rows}) || "
        + SHARE.format(share=share)
    )


def counted_sql(
    rule: dict, statement: str, source: str, bad: str, nulls: bool = False, mostly: float = 1.0
) -> str:
    """A rule that counts violating rows. ``bad`` is an aggregate over ``source``."""
    column = rule["kwargs"]["column"]
    checked = "r" if nulls else "p"
    missing = "cast(null as bigint)" if nulls else "r - p"
    return f"""
    select '{rule["type"]}' as type, '{statement}' as statement, verdict, upper(verdict) as status,
           r as element_count, {missing} as missing_count, b as unexpected_count,
           round(case when {checked} > 0 then cast(100 * b as double) / {checked} end, 6) as unexpected_percent,
           {magnitude_sql("b", "r")} as magnitude, cast(null as varchar) as observed
    from (select *, case when {checked} = 0 or cast({checked} - b as double) / {checked} >= {mostly}
                         then 'passed' else 'failed' end as verdict
          from (select count(*) as r, count({column}) as p, cast({bad} as bigint) as b from {source}) counts) judged
    """


def observed_sql(rule: dict, statement: str, source: str, value: str, text: str, within: str) -> str:
    """A rule that reports an observed value. ``within`` tests it under the name ``v``."""
    return f"""
    select '{rule["type"]}' as type, '{statement}' as statement,
           case when coalesce({within}, false) then 'passed' else 'failed' end as verdict,
           case when coalesce({within}, false) then 'PASSED' else 'FAILED' end as status,
           r as element_count, cast(null as bigint) as missing_count,
           cast(null as bigint) as unexpected_count, cast(null as double) as unexpected_percent,
           cast(null as varchar) as magnitude, {text} as observed
    from (select count(*) as r, {value} as v from {source}) counts
    """


def shared_rows(source: str, column: str) -> str:
    return (
        f"(select coalesce(sum(n), 0) from (select count(*) as n from {source} "
        f"where {column} is not null group by {column} having count(*) > 1) d)"
    )


# --- one query per type --------------------------------------------------------------

SEGMENT = "(select *, nullif(c_mktsegment, 'BUILDING') as segment from customer)"


def with_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))


NOT_NULL = spec("column_values_to_not_be_null", column="segment", mostly=0.75)
NULL = spec("column_values_to_be_null", column="segment")
UNIQUE_TEXT = spec("column_values_to_be_unique", column="text")
IN_SET = spec("column_values_to_be_in_set", column="o_orderstatus", value_set=["O", "F"])
NOT_IN_SET = spec("column_values_to_not_be_in_set", column="event_type", value_set=["error", None])
BETWEEN = spec("column_values_to_be_between", column="c_acctbal", min_value=0)
BETWEEN_DATES = spec(
    "column_values_to_be_between", column="o_orderdate",
    min_value="1996-01-01", max_value="1999-12-31",
)
MATCH = spec("column_values_to_match_regex", column="c_name", regex="^Customer#[[:digit:]]+[02468]$")
NOT_MATCH = spec("column_values_to_not_match_regex", column="p_name", regex="^blue", mostly=0.5)
LENGTHS = spec("column_value_lengths_to_be_between", column="text", min_value=20, max_value=5000)
MEAN = spec("column_mean_to_be_between", column="o_totalprice", min_value=0, max_value=200000.0)
DISTINCT = spec("column_unique_value_count_to_be_between", column="o_custkey", min_value=1, max_value=1000)
ROW_COUNT = spec("table_row_count_to_be_between", min_value=100, max_value=5000000)
OF_TYPE = spec("column_values_to_be_of_type", column="l_quantity", type_="DOUBLE_PRECISION")
IN_TYPE_LIST = spec("column_values_to_be_in_type_list", column="l_shipdate", type_list=["DATE", "TEXT"])
EXISTS = spec("column_to_exist", column="l_comment")
MANY_KEYS = spec("column_values_to_be_in_set", column="l_partkey", value_set=list(range(0, 3000, 2)))

QUERIES = {
    "check_not_null": one_check("customer", NOT_NULL, with_segment),
    "check_null": one_check("customer", NULL, with_segment),
    "check_unique": one_check("documents", UNIQUE_TEXT),
    "check_in_set": one_check("orders", IN_SET),
    "check_in_long_set": one_check("lineitem", MANY_KEYS),
    "check_not_in_set": one_check("events", NOT_IN_SET),
    "check_between": one_check("customer", BETWEEN),
    "check_between_dates": one_check("orders", BETWEEN_DATES),
    "check_match_regex": one_check("customer", MATCH),
    "check_not_match_regex": one_check("part", NOT_MATCH),
    "check_lengths_between": one_check("documents", LENGTHS),
    "check_mean_between": one_check("orders", MEAN),
    "check_unique_value_count": one_check("orders", DISTINCT),
    "check_row_count": one_check("orders", ROW_COUNT),
    "check_of_type": one_check("lineitem", OF_TYPE),
    "check_in_type_list": one_check("lineitem", IN_TYPE_LIST),
    "check_column_exists": one_check("lineitem", EXISTS),
}


def count_if(condition: str) -> str:
    return f"count(*) filter (where {condition})"


LONG_SET = "l_partkey % 2 <> 0 or l_partkey >= 3000"

ORACLES = {
    "check_not_null": counted_sql(
        NOT_NULL, "Every segment has a value, in at least 75% of rows", SEGMENT,
        count_if("segment is null"), nulls=True, mostly=0.75,
    ),
    "check_null": counted_sql(
        NULL, "Every segment is empty", SEGMENT, count_if("segment is not null"), nulls=True
    ),
    "check_unique": counted_sql(
        UNIQUE_TEXT, "No two rows share the same text", "documents", shared_rows("documents", "text")
    ),
    "check_in_set": counted_sql(
        IN_SET, "Every o_orderstatus is one of O, F", "orders", count_if("o_orderstatus not in ('O', 'F')")
    ),
    "check_in_long_set": counted_sql(
        MANY_KEYS, "Every l_partkey is one of " + ", ".join(map(str, range(0, 3000, 2))),
        "lineitem", count_if(LONG_SET),
    ),
    "check_not_in_set": counted_sql(
        NOT_IN_SET, "No event_type is one of error, None", "events", count_if("event_type = 'error'")
    ),
    "check_between": counted_sql(
        BETWEEN, "Every c_acctbal is at least 0", "customer", count_if("c_acctbal < 0")
    ),
    "check_between_dates": counted_sql(
        BETWEEN_DATES, "Every o_orderdate is between 1996-01-01 and 1999-12-31", "orders",
        count_if("o_orderdate < timestamp '1996-01-01' or o_orderdate > timestamp '1999-12-31'"),
    ),
    "check_match_regex": counted_sql(
        MATCH, "Every c_name matches the pattern ^Customer#[[:digit:]]+[02468]$", "customer",
        count_if("not regexp_matches(c_name, '^Customer#[0-9]+[02468]$')"),
    ),
    "check_not_match_regex": counted_sql(
        NOT_MATCH, "No p_name matches the pattern ^blue, in at least 50% of rows", "part",
        count_if("p_name like 'blue%'"), mostly=0.5,
    ),
    "check_lengths_between": counted_sql(
        LENGTHS, "Every text is between 20 and 5000 characters long", "documents",
        count_if("length(text) < 20 or length(text) > 5000"),
    ),
    "check_mean_between": observed_sql(
        MEAN, "The average o_totalprice is between 0 and 200000", "orders",
        "avg(o_totalprice)", "format('{:,.2f}', v)", "v >= 0 and v <= 200000",
    ),
    "check_unique_value_count": observed_sql(
        DISTINCT, "o_custkey holds between 1 and 1000 distinct values", "orders",
        "count(distinct o_custkey)", "cast(v as varchar)", "v between 1 and 1000",
    ),
    "check_row_count": observed_sql(
        ROW_COUNT, "Row count is between 100 and 5000000", "orders",
        "count(*)", "cast(v as varchar)", "v between 100 and 5000000",
    ),
    "check_of_type": observed_sql(
        OF_TYPE, "Every l_quantity is stored as DOUBLE_PRECISION", "lineitem",
        "any_value(typeof(l_quantity))", "case v when 'DOUBLE' then 'DOUBLE_PRECISION' else v end",
        "v = 'DOUBLE'",
    ),
    "check_in_type_list": observed_sql(
        IN_TYPE_LIST, "Every l_shipdate is stored as one of DATE, TEXT", "lineitem",
        "any_value(typeof(l_shipdate))", "v", "v in ('DATE', 'VARCHAR')",
    ),
    "check_column_exists": observed_sql(
        EXISTS, "The column l_comment exists", "lineitem",
        "(select count(*) from (describe lineitem) where column_name = 'l_comment')",
        "cast(null as varchar)", "v = 1",
    ),
}

# --- suites --------------------------------------------------------------------------

# The fifteen types over one table: each is checked beside its own SQL.
LINEITEM_SUITE: tuple[tuple[dict, str], ...] = (
    (spec("column_values_to_not_be_null", column="l_suppkey"),
     counted_sql(spec("column_values_to_not_be_null", column="l_suppkey"), "Every l_suppkey has a value",
                 "lineitem", count_if("l_suppkey is null"), nulls=True)),
    (spec("column_values_to_be_between", column="l_extendedprice", min_value=1000.0),
     counted_sql(spec("column_values_to_be_between", column="l_extendedprice"),
                 "Every l_extendedprice is at least 1000", "lineitem", count_if("l_extendedprice < 1000"))),
    (spec("column_values_to_be_in_set", column="l_returnflag", value_set=["A", "R"]),
     counted_sql(spec("column_values_to_be_in_set", column="l_returnflag"), "Every l_returnflag is one of A, R",
                 "lineitem", count_if("l_returnflag not in ('A', 'R')"))),
    (spec("column_values_to_be_unique", column="l_orderkey"),
     counted_sql(spec("column_values_to_be_unique", column="l_orderkey"), "No two rows share the same l_orderkey",
                 "lineitem", shared_rows("lineitem", "l_orderkey"))),
    (spec("column_values_to_match_regex", column="l_linestatus", regex="^[OF]$"),
     counted_sql(spec("column_values_to_match_regex", column="l_linestatus"),
                 "Every l_linestatus matches the pattern ^[OF]$", "lineitem",
                 count_if("l_linestatus not in ('O', 'F')"))),
    (spec("column_values_to_not_match_regex", column="l_returnflag", regex="^(N|X)", mostly=0.66),
     counted_sql(spec("column_values_to_not_match_regex", column="l_returnflag"),
                 "No l_returnflag matches the pattern ^(N|X), in at least 66% of rows", "lineitem",
                 count_if("l_returnflag like 'N%' or l_returnflag like 'X%'"), mostly=0.66)),
    (spec("column_value_lengths_to_be_between", column="l_linestatus", min_value=1, max_value=1),
     counted_sql(spec("column_value_lengths_to_be_between", column="l_linestatus"),
                 "Every l_linestatus is between 1 and 1 characters long", "lineitem",
                 count_if("length(l_linestatus) <> 1"))),
    (spec("column_values_to_not_be_in_set", column="l_linenumber", value_set=[6, 7.0]),
     counted_sql(spec("column_values_to_not_be_in_set", column="l_linenumber"),
                 "No l_linenumber is one of 6, 7", "lineitem", count_if("l_linenumber in (6, 7)"))),
    (spec("column_values_to_be_in_type_list", column="l_tax", type_list=["REAL", "SMALLINT"]),
     observed_sql(spec("column_values_to_be_in_type_list"), "Every l_tax is stored as one of REAL, SMALLINT",
                  "lineitem", "any_value(typeof(l_tax))",
                  "case v when 'DOUBLE' then 'DOUBLE_PRECISION' else v end", "v in ('FLOAT', 'SMALLINT')")),
    (spec("column_values_to_be_of_type", column="l_orderkey", type_="bigint"),
     observed_sql(spec("column_values_to_be_of_type"), "Every l_orderkey is stored as bigint", "lineitem",
                  "any_value(typeof(l_orderkey))", "v", "v = 'BIGINT'")),
    (spec("column_mean_to_be_between", column="l_quantity", min_value=12, max_value=40),
     observed_sql(spec("column_mean_to_be_between"), "The average l_quantity is between 12 and 40",
                  "lineitem", "avg(l_quantity)", "format('{:,.2f}', v)", "v between 12 and 40")),
    (spec("column_unique_value_count_to_be_between", column="l_returnflag", min_value=2, max_value=9),
     observed_sql(spec("column_unique_value_count_to_be_between"),
                  "l_returnflag holds between 2 and 9 distinct values", "lineitem",
                  "count(distinct l_returnflag)", "cast(v as varchar)", "v between 2 and 9")),
    (spec("table_row_count_to_be_between", max_value=1000),
     observed_sql(spec("table_row_count_to_be_between"), "Row count is at most 1000", "lineitem",
                  "count(*)", "cast(v as varchar)", "v <= 1000")),
    (spec("column_to_exist", column="l_tax"),
     observed_sql(spec("column_to_exist"), "The column l_tax exists", "lineitem",
                  "(select count(*) from (describe lineitem) where column_name = 'l_tax')",
                  "cast(null as varchar)", "v = 1")),
    (spec("column_values_to_be_null", column="l_shipdate"),
     counted_sql(spec("column_values_to_be_null", column="l_shipdate"), "Every l_shipdate is empty",
                 "lineitem", count_if("l_shipdate is not null"), nulls=True)),
)


def suite_lineitem(spark, sf_dir):
    rules = [rule for rule, _ in LINEITEM_SUITE]
    return shown(suite.run_suite(table(spark, sf_dir, "lineitem"), rules))


# Rules that cannot run stand beside rules that can, and only they are errored.
ORDERS_SUITE = (
    IN_SET, MEAN, DISTINCT, ROW_COUNT, BETWEEN_DATES,
    spec("column_values_to_be_between", column="o_comment", min_value=1),
    spec("column_values_to_match_regex", column="o_orderpriority", regex="[unclosed"),
    spec("column_mean_to_be_between", column="o_orderpriority", min_value=1),
)
ERRORED = (
    ("expect_column_values_to_be_between", "Every o_comment is at least 1"),
    ("expect_column_values_to_match_regex", "Every o_orderpriority matches the pattern [unclosed"),
    ("expect_column_mean_to_be_between", "The average o_orderpriority is at least 1"),
)


def suite_orders(spark, sf_dir):
    return shown(suite.run_suite(table(spark, sf_dir, "orders"), ORDERS_SUITE))


def errored_sql(rule_type: str, statement: str) -> str:
    return f"""
    select '{rule_type}', '{statement}', 'errored', 'ERRORED · rule could not run', count(*),
           cast(null as bigint), cast(null as bigint), cast(null as double),
           cast(null as varchar), cast(null as varchar) from orders"""


QUERIES |= {"suite_lineitem": suite_lineitem, "suite_orders": suite_orders}
ORACLES |= {
    "suite_lineitem": " union all ".join(f"({sql})" for _, sql in LINEITEM_SUITE),
    "suite_orders": " union all ".join(
        [f"({ORACLES[k]})" for k in ("check_in_set", "check_mean_between", "check_unique_value_count",
                                     "check_row_count", "check_between_dates")]
        + [f"({errored_sql(*e)})" for e in ERRORED]
    ),
}


# Bounds and members that no literal of the column's type can hold, beside a sound rule.
ODD_SUITE = (
    IN_SET,
    spec("column_values_to_be_between", column="o_orderdate", min_value="1996-W01-1"),
    spec("column_values_to_be_between", column="o_orderdate", max_value="19991231"),
    spec("column_values_to_be_in_set", column="o_custkey", value_set=[7, float("nan")]),
    spec("column_values_to_not_be_in_set", column="o_custkey", value_set=[7, float("inf")]),
    spec("column_values_to_be_between", column="o_custkey", max_value=10**30),
)


def suite_odd_bounds(spark, sf_dir):
    return shown(suite.run_suite(table(spark, sf_dir, "orders"), ODD_SUITE))


QUERIES["suite_odd_bounds"] = suite_odd_bounds
ORACLES["suite_odd_bounds"] = " union all ".join([
    f"({ORACLES['check_in_set']})",
    f"({errored_sql('expect_column_values_to_be_between', 'Every o_orderdate is at least 1996-W01-1')})",
    f"({errored_sql('expect_column_values_to_be_between', 'Every o_orderdate is at most 19991231')})",
    f"({counted_sql(ODD_SUITE[3], 'Every o_custkey is one of 7, NaN', 'orders', count_if('o_custkey <> 7'))})",
    f"({counted_sql(ODD_SUITE[4], 'No o_custkey is one of 7, Infinity', 'orders', count_if('o_custkey = 7'))})",
    f"({counted_sql(ODD_SUITE[5], 'Every o_custkey is at most 1' + '0' * 30, 'orders', '0')})",
])


def proportions(spark, sf_dir):
    rules = [rule for rule, _ in LINEITEM_SUITE]
    counted = suite.run_suite(table(spark, sf_dir, "lineitem"), rules)
    return counted.filter(F.col("unexpected_count").isNotNull()).select(
        "column", "type", "missing_count",
        F.round("missing_percent", 6).alias("missing_percent"),
        F.round("unexpected_percent_total", 6).alias("unexpected_percent_total"),
    )


def proportions_sql(rule: dict, sql: str) -> str:
    collapsed = rule["type"].endswith("be_null")
    total = "cast(null as double)" if collapsed else "round(cast(100 * unexpected_count as double) / element_count, 6)"
    percent = "cast(null as double)" if collapsed else "round(cast(100 * missing_count as double) / element_count, 6)"
    return f"""select '{rule["kwargs"]["column"]}' as "column", type, missing_count,
        {percent} as missing_percent, {total} as unexpected_percent_total from ({sql}) c"""


QUERIES["proportions"] = proportions
ORACLES["proportions"] = " union all ".join(
    proportions_sql(rule, sql) for rule, sql in LINEITEM_SUITE if "as p, cast(" in sql
)


# --- violating rows ------------------------------------------------------------------


def violations_between(spark, sf_dir):
    return suite.violations(table(spark, sf_dir, "customer"), BETWEEN)


def violations_unique(spark, sf_dir):
    return suite.violations(table(spark, sf_dir, "documents"), UNIQUE_TEXT)


def violations_long_set(spark, sf_dir):
    rows = suite.violations(table(spark, sf_dir, "lineitem"), MANY_KEYS)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


def evidence_between(spark, sf_dir):
    return suite.evidence(table(spark, sf_dir, "customer"), BETWEEN, ["c_custkey"]).select("c_custkey", "evidence")


def evidence_not_null(spark, sf_dir):
    rows = with_segment(table(spark, sf_dir, "customer"))
    return suite.evidence(rows, NOT_NULL, ["c_custkey"]).select("c_custkey", "evidence")


def evidence_unique(spark, sf_dir):
    return suite.evidence(table(spark, sf_dir, "documents"), UNIQUE_TEXT, ["doc_id"]).select("doc_id", "evidence")


def sample_in_set(spark, sf_dir):
    return suite.sample_violations(table(spark, sf_dir, "orders"), IN_SET, 20, ["o_orderkey"])


def violation_counts_between(spark, sf_dir):
    rule = spec("column_values_to_be_between", column="l_quantity", max_value=10)
    counts = suite.violation_counts(table(spark, sf_dir, "lineitem"), rule)
    return counts


def violation_counts_unique(spark, sf_dir):
    rule = spec("column_values_to_be_unique", column="l_orderkey")
    counts = suite.violation_counts(table(spark, sf_dir, "lineitem"), rule)
    return counts.select(F.col("value").alias("l_orderkey"), "rows")


SUITE_EVIDENCE = (BETWEEN, spec("column_values_to_be_unique", column="c_nationkey"), EXISTS)


def suite_evidence(spark, sf_dir):
    """A suite with its evidence: the counts first, then the rows of rules that found any."""
    found = suite.run_with_evidence(table(spark, sf_dir, "customer"), SUITE_EVIDENCE, ["c_custkey"])
    return found.select(
        "position", "verdict", "unexpected_count",
        F.array_join("samples", "|").alias("samples"), F.array_join("evidence", "|").alias("evidence"),
    )


QUERIES |= {
    "violations_between": violations_between,
    "violations_unique": violations_unique,
    "violations_long_set": violations_long_set,
    "evidence_between": evidence_between,
    "evidence_not_null": evidence_not_null,
    "evidence_unique": evidence_unique,
    "sample_in_set": sample_in_set,
    "violation_counts_between": violation_counts_between,
    "violation_counts_unique": violation_counts_unique,
    "suite_evidence": suite_evidence,
}
DUPLICATE_TEXT = "text in (select text from documents group by text having count(*) > 1)"
ORACLES |= {
    "violations_between": "select * from customer where c_acctbal < 0",
    "violations_unique": f"select * from documents where {DUPLICATE_TEXT}",
    "violations_long_set": f"select l_orderkey, l_linenumber, l_partkey from lineitem where {LONG_SET}",
    "evidence_between": """
        select c_custkey, '#' || c_custkey || ' ' || c_acctbal as evidence from customer
        where c_acctbal < 0 order by c_custkey limit 20""",
    "evidence_not_null": f"""
        select c_custkey, '#' || c_custkey || ' (empty)' as evidence from {SEGMENT}
        where segment is null order by c_custkey limit 20""",
    "evidence_unique": f"""
        select doc_id, trim('#' || doc_id || ' ' || text, ' ') as evidence from documents
        where {DUPLICATE_TEXT} order by doc_id limit 20""",
    "sample_in_set": """
        select o_orderstatus as value from orders where o_orderstatus not in ('O', 'F')
        order by o_orderkey limit 20""",
    "violation_counts_between": """
        select l_quantity as value, count(*) as rows from lineitem where l_quantity > 10
        group by 1 order by rows desc, cast(l_quantity as varchar) limit 20""",
    "violation_counts_unique": """
        select l_orderkey, count(*) as rows from lineitem group by 1 having count(*) > 1
        order by rows desc, cast(l_orderkey as varchar) limit 20""",
    "suite_evidence": """
        select 0 as position, case when count(*) = 0 then 'passed' else 'failed' end as verdict,
               count(*) as unexpected_count,
               coalesce(array_to_string((list(cast(c_acctbal as varchar) order by c_custkey))[1:20], '|'), '') as samples,
               coalesce(array_to_string((list('#' || c_custkey || ' ' || c_acctbal order by c_custkey))[1:20], '|'), '') as evidence
        from customer where c_acctbal < 0
        union all
        select 1, case when count(*) = 0 then 'passed' else 'failed' end, count(*),
               coalesce(array_to_string((list(cast(c_nationkey as varchar) order by c_custkey))[1:20], '|'), ''),
               coalesce(array_to_string((list('#' || c_custkey || ' ' || c_nationkey order by c_custkey))[1:20], '|'), '')
        from customer
        where c_nationkey in (select c_nationkey from customer group by 1 having count(*) > 1)
        union all
        select 2, 'failed', null, '', ''""",
}


def lines_per_customer(spark, sf_dir):
    """The magnitude line of every customer's orders that are not open."""
    from plumbline.functions import text

    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") != "O").alias("bad"), F.count(F.lit(1)).alias("rows")
    )
    return counts.select("o_custkey", text.magnitude(F.col("bad"), F.col("rows") * 1000).alias("magnitude"))


QUERIES |= {"magnitude": lines_per_customer}
ORACLES |= {
    "magnitude": f"""
        select o_custkey, {magnitude_sql("b", "r")} as magnitude
        from (select o_custkey, count(*) filter (where o_orderstatus <> 'O') as b,
                     count(*) * 1000 as r from orders group by 1) c""",
}

# --- value sets on either side of the length that changes the plan ----------------------

# Per column type: the column, members it can and cannot hold, and what is outside in SQL.
SETS = {
    "decimal": ("orders", "cast(o_totalprice as decimal(10,2))", [x for i in range(600) for x in (i * 250, i * 250 + 0.005)],
                "not (v % 250 = 0 and v < {n} * 125)"),
    "float": ("lineitem", "cast(l_discount as float)", [0, 0.05] + [i + 0.1 for i in range(1200)], "v <> 0"),
    "smallint": ("part", "cast(p_size as smallint)", [x for i in range(600) for x in (2 * i, 100_000 + i)],
                 "not (v % 2 = 0 and v < {n})"),
}


def long_sets(spark, sf_dir):
    """The first members of a set and the whole long one, on columns that cannot hold all members."""
    found = None
    for kind, (name, column, members, _) in SETS.items():
        rows = table(spark, sf_dir, name).selectExpr(f"{column} as v")
        rules = [spec("column_values_to_be_in_set", column="v", value_set=members[:n]) for n in (40, 1200)]
        counted = suite.run_suite(rows, rules).select(
            F.lit(kind).alias("kind"), F.when(F.col("position") == 0, 40).otherwise(1200).alias("members"),
            "verdict", "unexpected_count",
        )
        found = counted if found is None else found.unionByName(counted)
    return found


def long_sets_sql() -> str:
    return " union all ".join(
        f"""select '{kind}' as kind, {n} as members, case when count(*) = 0 then 'passed' else 'failed' end as verdict,
            count(*) as unexpected_count from (select {column} as v from {name}) t where {outside.format(n=n)}"""
        for kind, (name, column, _, outside) in SETS.items()
        for n in (40, 1200)
    )


# --- evidence of many failing rules -------------------------------------------------------

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
THIRTY = [spec("column_values_to_be_between", column="l_extendedprice", min_value=3000 + 100 * i) for i in range(30)]


def evidence_of_thirty(spark, sf_dir):
    """Thirty failing rules over one column; their evidence is one scan."""
    found = suite.run_with_evidence(table(spark, sf_dir, "lineitem"), THIRTY, LINE_KEYS)
    return found.select("position", "unexpected_count", F.array_join("evidence", "|").alias("evidence"))


def evidence_of_thirty_sql() -> str:
    line = "'#' || l_orderkey || ' #' || l_linenumber || ' #' || l_partkey || ' #' || l_suppkey || ' ' || l_extendedprice"
    return f"""
        select cast(i as int) as position, count(*) as unexpected_count,
               array_to_string((list({line} order by l_orderkey, l_linenumber, l_partkey, l_suppkey))[1:20], '|') as evidence
        from lineitem, range(30) r(i) where l_extendedprice < 3000 + 100 * i group by i"""


def progressive(spark, sf_dir):
    """The fifteen rules one verdict at a time; one row per verdict, in the order they came."""
    lineitem = table(spark, sf_dir, "lineitem")
    rules = [rule for rule, _ in LINEITEM_SUITE]
    events = list(run_progressive(lineitem, rules, Scan("lineitem", lineitem.count())))
    told = [e["result"] for e in events if e["event"] == "verdict"]
    rows = [(e["type"], e["statement"], e["verdict"], e["unexpected_count"], e["magnitude"]) for e in told]
    return local_frame(spark, rows, "type string, statement string, verdict string, unexpected_count bigint, magnitude string")


def violation_counts_all(spark, sf_dir):
    """Every offending value with its rows, not the most frequent ones alone."""
    rule = spec("column_values_to_be_unique", column="l_partkey")
    counts = suite.violation_counts(table(spark, sf_dir, "lineitem"), rule, n=None)
    return counts.select(F.col("value").alias("l_partkey"), "rows")


QUERIES |= {
    "long_sets": long_sets, "evidence_of_thirty": evidence_of_thirty, "progressive": progressive,
    "violation_counts_all": violation_counts_all,
}
ORACLES |= {
    "progressive": " union all ".join(f"select type, statement, verdict, unexpected_count, magnitude from ({sql}) s" for _, sql in LINEITEM_SUITE),
    "long_sets": long_sets_sql(),
    "evidence_of_thirty": evidence_of_thirty_sql(),
    "violation_counts_all": "select l_partkey, count(*) as rows from lineitem group by 1 having count(*) > 1",
}


# --- a part of a table -----------------------------------------------------------------

PART = "l_shipdate >= timestamp '1997-01-01'"
PART_SUITE = (
    (spec("column_values_to_be_between", column="l_discount", max_value=0.07), "l_discount > 0.07"),
    (spec("column_values_to_not_be_null", column="l_returnflag"), "l_returnflag is null"),
)


def suite_of_a_part(spark, sf_dir):
    """Rules on the lines shipped since 1997: each result says how many of all lines it saw."""
    since = F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    part, seen = scan_where(table(spark, sf_dir, "lineitem"), "lineitem", since)
    results = suite.run_suite(part, [rule for rule, _ in PART_SUITE], seen)
    return results.select(
        "type", "verdict", "status", "unexpected_count", "magnitude",
        F.lit(seen.scanned_rows).cast("bigint").alias("scanned_rows"), F.lit(seen.total_rows).cast("bigint").alias("total_rows"),
    )


def part_sql(rule: dict, bad: str) -> str:
    return f"""
    select '{rule["type"]}' as type, verdict,
           upper(verdict) || case when r < t then format(' · sampled {{:,}} / {{:,}}', r, t) else '' end as status,
           b as unexpected_count, {magnitude_sql("b", "r")} as magnitude, r as scanned_rows, t as total_rows
    from (select *, case when b = 0 then 'passed' else 'failed' end as verdict
          from (select count(*) filter (where {PART}) as r, count(*) as t, count(*) filter (where {PART} and {bad}) as b from lineitem) c) j"""


QUERIES["suite_of_a_part"] = suite_of_a_part
ORACLES["suite_of_a_part"] = " union all ".join(part_sql(rule, bad) for rule, bad in PART_SUITE)
