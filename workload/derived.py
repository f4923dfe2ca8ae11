"""Inputs that no table holds as such, derived from the given tables.

Rules, runs and replies are made from table rows by the SQL below, in a form that both Spark
and the SQL side can read; what the operators then do with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import load

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return load(spark, directory, name)[name]


def from_sql(spark: SparkSession, directory: str, sql: str) -> DataFrame:
    """A derived input as a DataFrame; the tables it names are the Parquet files."""
    used = {n: table(spark, directory, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used).withColumnRenamed("tab", "table")


def for_oracle(sql: str) -> str:
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{{", "{").replace("}}", "}")


# A rule on one of three tables, said in one of four ways. `kind`, `q` and `tab` come from the
# row; there are about a hundred different rules per table.
def _spec(tab: str, kind: str, q: str) -> str:
    column = (
        f"case {tab} when 'orders' then 'o_totalprice' when 'customer' then 'c_acctbal' "
        "else 'l_quantity' end"
    )
    return f"""case {kind}
        when 0 then '{{{{"type":"expect_column_values_to_be_between","kwargs":{{{{"column":"' || {column} || '","min_value":' || cast({q} as string) || '}}}}}}}}'
        when 1 then '{{{{"type":"expect_column_values_to_not_be_null","kwargs":{{{{"column":"' || {column} || '"}}}}}}}}'
        when 2 then '{{{{"type":"expect_column_values_to_be_unique","kwargs":{{{{"column":"' || {column} || '","mostly":0.95}}}}}}}}'
        else '{{{{"type":"expect_table_row_count_to_be_between","kwargs":{{{{"min_value":' || cast({q} * 10 as string) || '}}}}}}}}' end"""


def _table_of(key: str) -> str:
    return f"case {key} % 3 when 0 then 'orders' when 1 then 'customer' else 'lineitem' end"


def _uuid(text: str) -> str:
    digest = f"md5({text})"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in cuts)


# Revisions: an order is a rule, its lines are the rule's revisions.
REVISIONS = f"""
select rule_id, revision, tab, {_spec("tab", "kind", "q")} as spec, status,
       case when status = 'rejected' and q > 10 then 'no rule of this business' end as reason,
       written_at
from (
  select {_uuid("'rule' || cast(l_orderkey as string)")} as rule_id,
         cast(l_linenumber as int) as revision,
         {_table_of("l_orderkey")} as tab,
         (l_orderkey + l_linenumber) % 4 as kind,
         cast(min(l_quantity) as bigint) as q,
         case min(l_returnflag) when 'A' then 'accepted' when 'R' then 'rejected'
              else case min(l_linestatus) when 'O' then 'needs_review' else 'proposed' end
         end as status,
         max(l_shipdate) as written_at
  from {{lineitem}}
  group by l_orderkey, l_linenumber
) r
"""

# The same rows before lines with one number are merged, to have conflicting revisions.
RAW_REVISIONS = f"""
select {_uuid("'rule' || cast(l_orderkey as string)")} as rule_id,
       cast(case when l_tax = 0.08 then 0 else l_linenumber end as int) as revision,
       {_table_of("l_orderkey")} as tab,
       {_spec(_table_of("l_orderkey"), "(l_orderkey + l_linenumber) % 4", "cast(l_quantity as bigint)")} as spec,
       case l_returnflag when 'A' then 'accepted' when 'R' then 'rejected'
            else case l_linestatus when 'O' then 'needs_review' else 'parked' end end as status,
       case when l_quantity > 10 then 'no rule of this business' when l_quantity > 5 then '   ' end as reason,
       l_shipdate as written_at
from {{lineitem}}
"""

# Runs: a supplier is a run of one table.
RUNS = f"""
select cast(s_suppkey as string) as run_id, {_table_of("s_suppkey")} as tab,
       case when s_suppkey % 17 = 3 then 1001 + s_suppkey
            when s_suppkey % 5 = 0 then cast(floor((1000 + s_suppkey) / 2) as bigint)
            else 1000 + s_suppkey end as scanned_rows,
       1000 + s_suppkey as total_rows
from {{supplier}}
"""

_ASKED = f"""
  select l_suppkey, {_table_of("l_suppkey")} as tab, (l_orderkey + l_linenumber) % 4 as kind,
         case when (l_orderkey + l_linenumber) % 4 in (1, 2) then 0 else cast(l_quantity as bigint) end as q,
         count_if(l_returnflag = 'A') as a, count_if(l_returnflag = 'N') as n, max(l_shipdate) as shipped
  from {{lineitem}}
  where l_suppkey % 13 <> 4
  group by 1, 2, 3, 4
"""

# What each run was asked to check, and what it reported. Some rules never report.
SUBMITTED = f"""
select cast(l_suppkey as string) as run_id, {_spec("tab", "kind", "q")} as spec
from ({_ASKED}) s
"""

RESULTS = f"""
select cast(l_suppkey as string) as run_id, {_spec("tab", "kind", "q")} as spec,
       cast(kind * 100 + q as int) as position,
       case when l_suppkey % 11 = 5 then 'errored' when a > 1 then 'failed'
            when a = 1 then 'passed' when n > 1 then 'passed' else 'errored' end as verdict
from ({_ASKED}) s
where not (l_suppkey % 7 = 2 and kind = 2)
"""

# Run records of many small tables: an event is a run, its user is the table.
RECORDS = """
select cast(event_id as string) as record_id, 'user_' || cast(user_id as string) as tab,
       case event_type when 'error' then 'errored' when 'click' then 'failed' else 'passed' end as status,
       case when event_id % 4 = 0 then cast(floor(value) as bigint) else 1000 + user_id end as scanned_rows,
       1000 + user_id as total_rows,
       case event_type when 'error' then 2 else 3 end as coverage,
       ts as finished_at
from {events}
"""

# Rules of the same tables: a user's events are the revisions of that user's rules.
USER_REVISIONS = f"""
select {_uuid("'rule' || cast(event_id as string)")} as rule_id, 1 as revision,
       'user_' || cast(user_id as string) as tab,
       '{{{{"type":"expect_table_row_count_to_be_between","kwargs":{{{{"min_value":' || cast(event_id % 50 as string) || '}}}}}}}}' as spec,
       case when user_id % 3 = 0 then 'proposed' when event_type = 'view' then 'accepted' else 'rejected' end as status,
       'seen' as reason, ts as written_at
from {{events}}
"""
