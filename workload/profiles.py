"""Profiles of the given tables, and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.sources import tables as T
from workload.derived import TABLES, table

# Columns per table with the kind of value the SQL side has to deal with.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount "
                "l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
UNORDERED = {"embedding"}

# The names of the column types on the SQL side, as the Spark side gives them.
TYPE = (
    "case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' "
    "when 'DOUBLE' then 'double' when 'FLOAT[]' then 'array<float>' when 'TIMESTAMP' then 'timestamp_ntz' else column_type end"
)

# Parquet files state the least zero as -0.0; adding zero makes the SQL side print it as 0.0.
DOUBLES = {
    "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "value", "large",
}


def bound_sql(which: str, column: str) -> str:
    return f"cast({which}({column}{' + 0.0' if column in DOUBLES else ''}) as varchar)"


def profiled(name):
    def query(spark, sf_dir):
        found = P.with_evidence_line(P.profile(table(spark, sf_dir, name), name))
        return found.select(
            "table", "column", "total_rows", "non_null", "distinct", "minimum", "maximum",
            F.array_join("values", "|").alias("values"), "evidence",
        )

    return query


def column_sql(name: str, column: str, source: str | None = None) -> str:
    ordered = column not in UNORDERED
    low = bound_sql("min", column) if ordered else "cast(null as varchar)"
    high = bound_sql("max", column) if ordered else "cast(null as varchar)"
    return f"""
    select "table", "column", total_rows, non_null, "distinct", minimum, maximum,
           array_to_string(few, '|') as "values",
           format('{{:,}} rows scanned · {{:,}} nulls · {{:,}} distinct', total_rows, total_rows - non_null, "distinct")
           || case when few is not null then ': ' || array_to_string(few, ', ')
                   else coalesce(' · min observed ' || minimum, '') || coalesce(' · max observed ' || maximum, '') end as evidence
    from (select '{name}' as "table", '{column}' as "column", count(*) as total_rows,
                 count({column}) as non_null, count(distinct {column}) as "distinct",
                 {low} as minimum, {high} as maximum,
                 case when count(distinct {column}) between 1 and 20
                      then list_sort(list(distinct cast({column} as varchar)) filter (where {column} is not null)) end as few
          from {source or name}) p"""


QUERIES = {f"profile_{name}": profiled(name) for name in TABLES}
ORACLES = {
    f"profile_{name}": " union all ".join(column_sql(name, c) for c in columns.split())
    for name, columns in COLUMNS.items()
}


def profile_with_nulls(spark, sf_dir):
    """Columns that are partly null, wholly null, nested, or of a type without an order."""
    rows = table(spark, sf_dir, "events").select(
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("value") > 50, F.col("value")).alias("large"),
        F.array(F.col("user_id") % 30, F.col("event_id") % 2).alias("pair"),
    )
    found = P.with_evidence_line(P.profile(rows, "events"))
    return found.select(
        "column", "total_rows", "non_null", "distinct", "minimum", "maximum", F.array_join("values", "|").alias("values"), "evidence"
    )


def low_cardinality(spark, sf_dir):
    """Only the value sets, one row per value, over every table."""
    found = [P.profile(table(spark, sf_dir, n), n) for n in ("orders", "lineitem", "labels", "part")]
    whole = found[0]
    for one in found[1:]:
        whole = whole.unionByName(one)
    return whole.select("table", "column", F.explode("values").alias("value"))


def profile_sketched(spark, sf_dir):
    """The option with estimated distinct counts; everything else in it is exact."""
    found = P.profile(table(spark, sf_dir, "lineitem"), "lineitem", approximate=True)
    exact = F.when(~F.col("estimated"), F.col("distinct")).alias("distinct")
    return found.select("column", "total_rows", "non_null", "minimum", "maximum", exact, F.array_join("values", "|").alias("values"))


def sample_rows(spark, sf_dir):
    return P.sample_rows(table(spark, sf_dir, "orders"), 20, ["o_orderkey"])


def fresh_profiles(spark, sf_dir):
    """Events as profiles taken at their time: those under 300 seconds old at noon."""
    taken = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("profiled_at"))
    noon = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")
    return P.fresh_profiles(taken, noon)


def list_tables(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in TABLES}
    tables["lt3_scratch"] = tables["orders"]
    listed = T.list_tables(tables)
    return listed.select(
        "table", F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"])), " ").alias("columns"),
        "approx_rows", "accepted_rules",
    )


def table_columns(spark, sf_dir):
    """The columns of every table that is not empty, in declaration order."""
    tables = {n: table(spark, sf_dir, n) for n in TABLES}
    filled = T.list_tables(tables).filter("approx_rows > 0").select("table", F.posexplode("columns"))
    return filled.select("table", F.col("pos").alias("position"), F.col("col.name").alias("column"), F.col("col.type").alias("type"))


def profile_maps_and_bytes(spark, sf_dir):
    """Equal maps whose entries come in two orders, and bytes that are no text."""
    odd = F.col("event_id") % 2 == 1
    user, kind = F.lit("user"), F.lit("kind")
    a, b = F.col("user_id") % 3, F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").select(
        F.when(odd, F.create_map(user, a, kind, b)).otherwise(F.create_map(kind, b, user, a)).alias("pairs"),
        F.unhex(F.concat(F.lit("FFFE0"), (F.col("user_id") % 4).cast("string"))).alias("bytes"),
    )
    found = P.profile(rows, "events")
    return found.select("column", "total_rows", "distinct", "minimum", "maximum", F.array_join("values", "|").alias("values"))


NOON = "2024-01-03 12:00:00"


def profile_reuse(spark, sf_dir):
    """A fresh profile, a stale one, one from after now and none at all: who is profiled anew."""
    names = ("orders", "customer", "supplier", "part")
    ages = {"orders": 100, "customer": 1000, "supplier": -100}
    now = F.lit(NOON).cast("timestamp_ntz")
    stored = None
    for name, age in ages.items():
        taken = P.profile(table(spark, sf_dir, name), name).withColumn("total_rows", F.lit(-1).cast("bigint"))
        one = P.stamped(taken, now - F.make_dt_interval(secs=F.lit(age)))
        stored = one if stored is None else stored.unionByName(one)
    found = P.profiles_of({n: table(spark, sf_dir, n) for n in names}, stored, now)
    return found.select("table", "column", "total_rows", "non_null", "distinct", "reused")


QUERIES |= {
    "profile_maps_and_bytes": profile_maps_and_bytes,
    "profile_reuse": profile_reuse,
    "profile_with_nulls": profile_with_nulls,
    "low_cardinality": low_cardinality,
    "profile_sketched": profile_sketched,
    "sample_rows": sample_rows,
    "fresh_profiles": fresh_profiles,
    "list_tables": list_tables,
    "table_columns": table_columns,
}

DERIVED_EVENTS = """(select nullif(event_type, 'error') as kind, cast(null as varchar) as nothing,
    case when value > 50 then value end as large, [user_id % 30, event_id % 2] as pair from events)"""
UNORDERED.add("pair")
PAIRS = "(select (user_id % 3) || ' ' || (event_id % 5) as p, 'FFFE0' || (user_id % 4) as b from events)"
ORACLES |= {
    "profile_maps_and_bytes": f"""
        select 'pairs' as "column", count(*) as total_rows, count(distinct p) as "distinct", cast(null as varchar) as minimum,
               cast(null as varchar) as maximum,
               (select array_to_string(list(j order by j), '|') from (select distinct '{{"kind":' || (event_id % 5) || ',"user":' || (user_id % 3) || '}}' as j from events)) as "values"
        from {PAIRS} e
        union all
        select 'bytes', count(*), count(distinct b), min(b), max(b), array_to_string(list_sort(list(distinct b)), '|') from {PAIRS} e""",
    "profile_reuse": " union all ".join(
        f"""select '{n}' as "table", '{c}' as "column", {"cast(-1 as bigint)" if n == "orders" else "count(*)"} as total_rows,
            count({c}) as non_null, count(distinct {c}) as "distinct", {"true" if n == "orders" else "false"} as reused from {n}"""
        for n in ("orders", "customer", "supplier", "part")
        for c in COLUMNS[n].split()
    ),
    "profile_with_nulls": " union all ".join(
        'select "column", total_rows, non_null, "distinct", minimum, maximum, "values", evidence from ('
        + column_sql("events", c, DERIVED_EVENTS) + ") x"
        for c in ("kind", "nothing", "large", "pair")
    ),
    "low_cardinality": " union all ".join(
        f"""select '{n}' as "table", '{c}' as "column", v as value
            from (select distinct cast({c} as varchar) as v from {n} where {c} is not null)
            where (select count(distinct {c}) from {n}) <= 20"""
        for n in ("orders", "lineitem", "labels", "part")
        for c in COLUMNS[n].split()
    ),
    "profile_sketched": " union all ".join(
        f"""select '{c}' as "column", count(*) as total_rows, count({c}) as non_null,
            {bound_sql("min", c)} as minimum, {bound_sql("max", c)} as maximum,
            case when count(distinct {c}) <= 40 then count(distinct {c}) end as "distinct",
            case when count(distinct {c}) between 1 and 20
                 then array_to_string(list_sort(list(distinct cast({c} as varchar))), '|') end as "values" from lineitem"""
        for c in COLUMNS["lineitem"].split()
    ),
    "sample_rows": "select * from orders order by o_orderkey limit 20",
    "fresh_profiles": """
        select event_id, ts as profiled_at from events
        where ts <= timestamp '2024-01-03 12:00:00' and ts > timestamp '2024-01-03 11:55:00'""",
    "list_tables": " union all ".join(
        f"select '{n}' as \"table\", (select string_agg(column_name || ':' || {TYPE}, ' ') from (describe {n})) as columns, "
        f"count(*) as approx_rows, cast(0 as bigint) as accepted_rules from {n}"
        for n, c in COLUMNS.items()
    ),
    "table_columns": " union all ".join(
        f"select '{n}' as \"table\", cast({i} as int) as position, '{c}' as \"column\", "
        f"(select {TYPE} from (describe {n}) where column_name = '{c}') as type from {n} having count(*) > 0"
        for n, columns in COLUMNS.items()
        for i, c in enumerate(columns.split())
    ),
}
