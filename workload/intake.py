"""Lint over candidate rules, and replies turned into proposals, drafts and refusals."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.operators import intake as I
from plumbline.operators import lint as L
from workload import derived as D
from workload.rules import profiles, schema

# A candidate per order. What is wrong with it goes by its key; `{c}` stands for the customer
# and `{k}` for the order. Each entry: the spec, and the fault named (None for a sound rule).
CANDIDATES: tuple[tuple[str, str, str | None], ...] = (
    ("expect_column_values_to_not_be_null", '"column":"o_custkey","mostly":0.8', None),
    ("expect_column_value_lengths_to_be_between", '"column":"o_orderpriority","min_value":40,"max_value":12',
     ": min_value=40 is above max_value=12"),
    ("expect_column_values_to_be_of_type", '"column":"o_orderdate"', ": missing type_"),
    ("expect_column_median_to_be_between", '"column":"o_totalprice","min_value":{c}', " is no rule type of the catalog"),
    ("expect_column_values_to_be_between", '"column":"o_custkey","max_value":{c},"min_value":1', None),
    ("expect_column_values_to_be_unique", '"column":"o_orderkey","strictly":true',
     ": strictly is not a parameter of this check"),
    ("expect_table_row_count_to_be_between", '"min_value":null', ": neither min_value nor max_value was given"),
    ("expect_column_values_to_not_be_in_set", '"column":"o_orderstatus","value_set":""', ": value_set is empty"),
    ("expect_column_values_to_not_match_regex", '"column":"o_orderpriority","regex":"(low|high"',
     ': regex "(low|high" does not compile'),
    ("expect_column_values_to_be_of_type", '"column":"o_totalprice","type_":"NUMBERS"',
     ': "NUMBERS" is not a SQL type name'),
    ("expect_column_values_to_be_null", '"column":"note_{c}"', ': orders has no column "note_{c}"'),
    ("expect_column_values_to_be_null", '"column":"o_orderdate","mostly":-0.1',
     ": mostly=-0.1 is not a proportion between 0 and 1"),
    ("expect_column_mean_to_be_between", '"column":"o_totalprice","max_value":{c}', None),
    ("expect_column_values_to_be_in_type_list", '"column":"o_orderkey","type_list":[]', ": type_list is empty"),
    ("expect_column_values_to_match_regex", '"column":"o_orderpriority","regex":"^[1-5]-"', None),
    ("expect_column_unique_value_count_to_be_between", '"column":"o_orderstatus","min_value":9,"max_value":-{c}',
     ": min_value=9 is above max_value=-{c}"),
    ("expect_column_values_to_be_in_set", '"column":"o_orderstatus"', ": missing value_set"),
    ("expect_column_values_to_not_be_null", '"column":"o_custkey","mostly":[1]',
     ": mostly=[1] is not a proportion between 0 and 1"),
    ("expect_column_values_to_match_regex", '"column":"o_orderstatus","regex":"*"', ': regex "*" does not compile'),
    ("expect_table_row_count_to_be_between", '"max_value":{k}', None),
    ("expect_multicolumn_sum_to_equal", '"columns":["o_orderkey"],"sum_total":{k}', " is no rule type of the catalog"),
    ("expect_column_to_exist", '"column":"o_shippriority"', ': orders has no column "o_shippriority"'),
)


def _filled(template: str) -> str:
    """A template as an SQL text expression; braces of JSON are doubled for the formatter."""
    parts = template.replace("{c}", "\x00c\x00").replace("{k}", "\x00k\x00").split("\x00")
    names = {"c": "cast(o_custkey as string)", "k": "cast(o_orderkey as string)"}
    return " || ".join(names[p] if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p or not i)


def _case(values: list[str], key: str, n: int) -> str:
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {key} % {n} {whens} end"


def _spec_text(rule_type: str, kwargs: str) -> str:
    inner = _filled(kwargs) if kwargs else "''"
    return f"""'{{{{"type":"{rule_type}","kwargs":{{{{' || {inner} || '}}}}}}}}'"""


SPEC = _case([_spec_text(t, k) for t, k, _ in CANDIDATES], "o_orderkey", len(CANDIDATES))
CANDIDATE_SQL = f"select o_orderkey as candidate_id, 'orders' as tab, {SPEC} as spec from {{orders}}"


def lint(spark, sf_dir):
    candidates = D.from_sql(spark, sf_dir, CANDIDATE_SQL)
    return L.lint(candidates, schema(spark, sf_dir), ["candidate_id"]).select("candidate_id", "ok", "reason")


def lint_without_schema(spark, sf_dir):
    """With no schema to look in, every rule that names a column is refused."""
    candidates = D.from_sql(spark, sf_dir, CANDIDATE_SQL)
    return L.lint(candidates, None, ["candidate_id"]).select("candidate_id", "ok", "reason")


# A reply per event: three rules, and a fourth that only counts when it is within the limit.
def _rule(rule_type: str, kwargs: str) -> str:
    return f"""'{{{{"type":"{rule_type}","kwargs":{{{{{kwargs}}}}}}}}}'"""


USER = "' || cast(user_id as string) || '"
GOOD = (
    _rule("expect_column_values_to_be_between", f'"column":"o_totalprice","min_value":{USER}'),
    _rule("expect_column_values_to_not_be_null", '"column":"o_totalprice","mostly":0.9'),
    _rule("expect_table_row_count_to_be_between", "\"max_value\":' || cast(user_id * 1000 as string) || '"),
)
BAD = _rule("expect_column_values_to_be_unique", '"column":"nowhere"')
REPLIES = f"""
select event_id as reply_id, 'orders' as tab,
       case when event_id % 5 = 0 then '{{{{"rules":[]}}}}'
            when event_id % 7 = 0 then '{{{{"rules":[' || {GOOD[0]} || ',' || {BAD} || ',' || {GOOD[2]} || ']}}}}'
            when event_id % 11 = 0 then '{{{{"rules":[' || {GOOD[0]} || ',' || {GOOD[1]} || ',' || {GOOD[2]} || ',' || {BAD} || ']}}}}'
            when event_id % 13 = 0 then '{{{{"rules":[{{{{"type":3}}}}]}}}}'
            when event_id % 17 = 0 then 'I would rather talk about it'
            else '{{{{"rules":[' || {GOOD[1]} || ',' || {GOOD[2]} || ']}}}}' end as reply
from {{events}}
"""


def proposals(spark, sf_dir):
    replies = D.from_sql(spark, sf_dir, REPLIES)
    found = I.proposals(replies, schema(spark, sf_dir), profiles(spark, sf_dir), limit=3)
    return found.select("reply_id", "position", "type", "column", "statement", "evidence", "status", "refusal")


# An authoring reply per conversation turn, its text being the model's explanation.
def authoring_replies(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 8

    def check(rule_type, **kwargs):
        params = F.struct(*[(v if not isinstance(v, str | list) else F.lit(v)).alias(k) for k, v in kwargs.items()])
        return F.to_json(F.struct(F.struct(F.lit(rule_type).alias("type"), params.alias("kwargs")).alias("check")))

    def cannot(code):
        return F.to_json(F.struct(F.lit(code).alias("cannot"), F.concat(F.lit(" \n"), F.col("text")).alias("why")))

    reply = (
        F.when(kind == 0, check("expect_column_values_to_be_between", column="o_totalprice", min_value=F.col("turn")))
        .when(kind == 1, cannot("multi_column"))
        .when(kind == 2, cannot("unclear"))
        .when(kind == 3, cannot("weird"))
        .when(kind == 4, check("expect_column_values_to_be_unique", column="nowhere"))
        .when(kind == 5, F.col("text"))
        .when(kind == 6, F.lit('{"check":{"type":7,"kwargs":{}},"why":"  "}'))
        .otherwise(F.lit('{"check":{"type":"expect_column_values_to_be_unique","kwargs":[1]}}'))
    )
    return turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("reply_id"), F.lit("orders").alias("table"), reply.alias("reply")
    )


def classify(spark, sf_dir):
    judged = I.classify(authoring_replies(spark, sf_dir), schema(spark, sf_dir))
    return judged.drop("table", "spec")


QUERIES = {f.__name__: f for f in (lint, lint_without_schema, proposals, classify)}

# --- the SQL side --------------------------------------------------------------------


def _reason(rule_type: str, fault: str | None) -> str:
    if fault is None:
        return "cast(null as varchar)"
    return f"'{rule_type}' || " + _filled(fault)


def _unread(kwargs: str, fault: str | None) -> str | None:
    """The fault when there is no schema: rules that only a column could fault, and sound ones on a column."""
    column = re.search(r'"column":("[^"]*")', kwargs)
    looks = column and (fault is None or " has no column " in fault)
    return f": no schema of orders to look for the column {column[1]}" if looks else fault


UNREAD = _case([_reason(t, _unread(k, f)) for t, k, f in CANDIDATES], "o_orderkey", len(CANDIDATES))
REASON = _case([_reason(t, f) for t, _, f in CANDIDATES], "o_orderkey", len(CANDIDATES))
EVIDENCE = """(select format('{:,} rows scanned · 0 nulls · {:,} distinct · min observed {} · max observed {}',
    count(*), count(distinct o_totalprice), cast(min(o_totalprice) as varchar), cast(max(o_totalprice) as varchar)) from orders)"""
SIZE = "(select format('{:,} rows scanned', count(*)) from orders)"
NOWHERE = """expect_column_values_to_be_unique: orders has no column "nowhere\""""
SAVED = " Nothing was saved. Your coverage did not change."
LIMIT = (
    "Not supported yet — this rule compares two columns, and the current rule set "
    "covers single-column and table-level checks only."
)
VAGUE = (
    "This could not be read as a check on one column or on the table as a whole. "
    "Name the column and say what would make a row wrong."
)

_KEPT = "event_id % 5 <> 0 and event_id % 7 <> 0"
_FIRST = f"{_KEPT} and event_id % 11 = 0"
_REST = f"{_KEPT} and (event_id % 11 = 0 or (event_id % 13 <> 0 and event_id % 17 <> 0))"
_PLACE = "case when event_id % 11 = 0 then {0} else {1} end"


def _proposal(position: str, rule_type: str, column: str, sentence: str, evidence: str, where: str) -> str:
    return f"""select event_id as reply_id, cast({position} as int) as position, '{rule_type}' as type,
        {column} as "column", {sentence} as statement, {evidence} as evidence, 'proposed' as status,
        cast(null as varchar) as refusal from events where {where}"""


def _refused(reason: str, where: str, position: str = "null") -> str:
    return f"""select event_id, cast({position} as int), cast(null as varchar), cast(null as varchar), cast(null as varchar),
        cast(null as varchar), cast(null as varchar), '{reason}' from events where {where}"""


ORACLES = {
    "lint": f"""
        select candidate_id, reason is null as ok, reason
        from (select o_orderkey as candidate_id, {D.for_oracle(REASON)} as reason from orders) r""",
    "lint_without_schema": f"""
        select candidate_id, reason is null as ok, reason
        from (select o_orderkey as candidate_id, {D.for_oracle(UNREAD)} as reason from orders) r""",
    "proposals": " union all ".join(
        [
            _proposal("0", "expect_column_values_to_be_between", "'o_totalprice'",
                      "'Every o_totalprice is at least ' || user_id", EVIDENCE, _FIRST),
            _proposal(_PLACE.format(1, 0), "expect_column_values_to_not_be_null", "'o_totalprice'",
                      "'Every o_totalprice has a value, in at least 90% of rows'", EVIDENCE, _REST),
            _proposal(_PLACE.format(2, 1), "expect_table_row_count_to_be_between", "cast(null as varchar)",
                      "'Row count is at most ' || (user_id * 1000)", SIZE, _REST),
            _refused("there are no rules in this reply",
                     "event_id % 5 = 0 or (event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 = 0)"),
            _refused(NOWHERE, "event_id % 5 <> 0 and event_id % 7 = 0"),
            _refused("this rule comes after the number of rules asked for", _FIRST, "3"),
            _refused("a rule is an object with a type",
                     "event_id % 5 <> 0 and event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 = 0"),
        ]
    ),
    "classify": f"""
        select conv_id || ':' || turn as reply_id,
               case when k = 0 then 'draft' else 'refused' end as outcome,
               case when k = 0 then null when k = 1 then 'multi_column' when k = 4 then 'invalid' else 'unclear' end as reason,
               case when k = 0 then 'Every o_totalprice is at least ' || turn end as statement,
               case when k = 0 then null when k = 1 then '{LIMIT}{SAVED}' when k = 4 then '{NOWHERE}{SAVED}'
                    else '{VAGUE}{SAVED}' end as message,
               case when k in (1, 2, 3) and length(said) > 0 then said end as detail
        from (select *, (conv_id + turn) % 8 as k,
                     trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as said from conversations) c""",
}
