"""The rule registry over revisions derived from order lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import spec as S
from plumbline.functions import text
from plumbline.operators import profile as P
from plumbline.operators import registry as R
from plumbline.operators.lint import lint
from plumbline.operators.ranges import shared_folder
from plumbline.operators.run import run_table
from plumbline.sources import store
from plumbline.sources import tables as T
from workload import derived as D
from workload.profiles import COLUMNS

RULE_TABLES = ("customer", "lineitem", "orders")


def revisions(spark, sf_dir):
    return D.from_sql(spark, sf_dir, D.REVISIONS)


def schema(spark, sf_dir):
    return T.table_columns({n: D.table(spark, sf_dir, n) for n in RULE_TABLES})


def profiles(spark, sf_dir):
    """The profiles of all columns of the three tables with rules."""
    found = [P.profile(D.table(spark, sf_dir, n), n) for n in RULE_TABLES]
    return found[0].unionByName(found[1]).unionByName(found[2])


def revision_history(spark, sf_dir):
    """All revisions; the order they come in does not show in the comparison."""
    return R.revisions(revisions(spark, sf_dir))


def stored_revisions(spark, sf_dir):
    """The revisions written in two appends and read again."""
    path = f"{shared_folder(spark)}/revisions-{uuid.uuid4().hex}"
    rules = revisions(spark, sf_dir).withColumn("written_at", F.col("written_at").cast("timestamp"))
    for part in (rules.filter("revision = 1"), rules.filter("revision <> 1")):
        store.append_revisions(part, path)
    return store.read_revisions(spark, path).select("rule_id", "revision", "table", "spec", "status", "reason")


def table_history(spark, sf_dir):
    return R.revisions(revisions(spark, sf_dir), table="orders").select("rule_id", "revision", "status")


def rule_history(spark, sf_dir):
    rule = "cfcd208495d565ef66e7dff9f98764da"
    rules = revisions(spark, sf_dir).withColumn(
        "rule_id", F.when(F.col("rule_id") < "1", F.lit(rule)).otherwise(F.col("rule_id"))
    )
    return R.revisions(rules, rule_id=rule).select("revision", "table", "status")


def current_rules(spark, sf_dir):
    return R.current(revisions(spark, sf_dir))


def accepted_rules(spark, sf_dir):
    return R.accepted(revisions(spark, sf_dir)).select("rule_id", "table", "spec")


def executable_rules(spark, sf_dir):
    return R.executable(revisions(spark, sf_dir))


def rule_counts(spark, sf_dir):
    tables = T.list_tables({n: D.table(spark, sf_dir, n) for n in D.TABLES})
    return R.rule_counts(tables, revisions(spark, sf_dir)).select("table", "approx_rows", "accepted_rules")


def rule_counts_per_user(spark, sf_dir):
    """Every user as a table, so that there are many; a third of them have no accepted rule."""
    events = D.table(spark, sf_dir, "events")
    tables = events.groupBy(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("table")
    ).agg(F.count(F.lit(1)).alias("approx_rows"))
    return R.rule_counts(tables, D.from_sql(spark, sf_dir, D.USER_REVISIONS))


def revision_conflicts(spark, sf_dir):
    return R.revision_conflicts(D.from_sql(spark, sf_dir, D.RAW_REVISIONS))


def invalid_revisions(spark, sf_dir):
    return R.invalid_revisions(D.from_sql(spark, sf_dir, D.RAW_REVISIONS))


LINE_DECISIONS = f"""
select {D._uuid("'rule' || cast(l_orderkey as string)")} as rule_id, cast(l_linenumber as int) as line,
       case min(l_returnflag) when 'A' then 'accepted' when 'R' then 'rejected' else 'needs_review' end as status,
       case when min(l_quantity) > 15 then 'seen' end as reason
from {{lineitem}} group by l_orderkey, l_linenumber"""


def edits(spark, sf_dir):
    """An edit of every rule whose order is over 100,000; every tenth edit names no column."""
    return D.from_sql(
        spark, sf_dir,
        f"""select {D._uuid("'rule' || cast(o_orderkey as string)")} as rule_id,
            case when o_orderkey % 10 = 0
                 then '{{{{"type":"expect_column_values_to_be_unique","kwargs":{{{{"column":"missing"}}}}}}}}'
                 else '{{{{"type":"expect_table_row_count_to_be_between","kwargs":{{{{"max_value":' || cast(o_custkey as string) || '}}}}}}}}'
            end as spec from {{orders}} where o_totalprice > 100000""",
    )


def amend(spark, sf_dir):
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    return R.amend(revisions(spark, sf_dir), edits(spark, sf_dir), schema(spark, sf_dir), at)


def refused_edits(spark, sf_dir):
    return R.refused_edits(revisions(spark, sf_dir), edits(spark, sf_dir), schema(spark, sf_dir))


def edit_outcomes(spark, sf_dir):
    """Edits written and edits refused: together they are all edits."""
    given = (revisions(spark, sf_dir), edits(spark, sf_dir), schema(spark, sf_dir))
    judged = R.judged_edits(*given)
    written, kept_out = R.amend(*given, judged=judged), R.refused_edits(*given, judged=judged)
    counts = [df.agg(F.count(F.lit(1)).alias("edits")).select(F.lit(n).alias("outcome"), "edits") for n, df in (("written", written), ("refused", kept_out))]
    return counts[0].unionByName(counts[1])


def line_decisions(spark, sf_dir):
    """A decision per order line, so that a rule is judged as often as its order has lines."""
    return D.from_sql(spark, sf_dir, LINE_DECISIONS)


def judge_in_order(spark, sf_dir):
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    written = R.judge(revisions(spark, sf_dir), line_decisions(spark, sf_dir), at, order=["line"])
    return written.select("rule_id", "revision", "status", "reason")


def judgments_without_order(spark, sf_dir):
    """Without an order only rules with a single storable decision are judged."""
    return R.refused_judgments(revisions(spark, sf_dir), line_decisions(spark, sf_dir)).select("rule_id", "line", "fault")


def decisions(spark, sf_dir):
    """A judgment on every order's rule. Orders without lines are rules nobody wrote."""
    return D.from_sql(
        spark, sf_dir,
        f"""select {D._uuid("'rule' || cast(o_orderkey as string)")} as rule_id,
            case o_orderstatus when 'O' then 'accepted' when 'F' then 'rejected' else 'shelved' end as status,
            case when o_orderkey % 2 = 0 then 'judged' when o_orderkey % 3 = 0 then ' ' end as reason
            from {{orders}}""",
    )


def judge(spark, sf_dir):
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    return R.judge(revisions(spark, sf_dir), decisions(spark, sf_dir), at)


def refused_judgments(spark, sf_dir):
    return R.refused_judgments(revisions(spark, sf_dir), decisions(spark, sf_dir)).select("rule_id", "fault")


def candidates(spark, sf_dir):
    """Parts as candidate rules: a value set per part, on a column that every third lacks."""
    return D.from_sql(
        spark, sf_dir,
        """select p_partkey as candidate_id, 'orders' as tab,
           '{{"kwargs":{{"value_set":["' || p_type || '",' || cast(p_size as string) || '.0],"column":"'
           || case when p_partkey % 3 = 0 then 'o_comment' else 'o_orderpriority' end
           || '"}},"type":"expect_column_values_to_be_in_set"}}' as spec from {part}""",
    )


def propose(spark, sf_dir):
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    return R.propose(candidates(spark, sf_dir), schema(spark, sf_dir), "first", at)


def judge_batch(spark, sf_dir):
    """One decision over candidates and stored rules."""
    fine = lint(candidates(spark, sf_dir), schema(spark, sf_dir), ["candidate_id"]).filter("ok").drop("ok", "reason")
    rules = revisions(spark, sf_dir)
    held = R.current(rules).filter("status = 'needs_review'").select("rule_id")
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    written = R.judge_batch(
        rules, fine, held, "rejected", "not ours", schema(spark, sf_dir), "second", at=at
    )
    return written.select("rule_id", "revision", "table", "spec", "status", "reason")


def judge_batch_refused(spark, sf_dir):
    """The same decision over all candidates, which the unsound ones refuse: their faults, and what the refusal told."""
    rules, offered, fields = revisions(spark, sf_dir), candidates(spark, sf_dir), schema(spark, sf_dir)
    held = R.current(rules).filter("status = 'needs_review'").select("rule_id")
    told = None
    try:
        R.judge_batch(rules, offered, held, "rejected", "not ours", fields, "second")
    except ValueError as refusal:
        told = str(refusal)
    return R.refused(offered, fields).select("candidate_id", "reason", F.lit(told).cast("string").alias("told"))


def proposals_for_known_rules(spark, sf_dir):
    """Candidates that say what stored rules say, with other spellings of the same numbers."""
    return D.from_sql(
        spark, sf_dir,
        """select l_orderkey as candidate_id, l_linenumber as line,
           case l_orderkey % 3 when 0 then 'orders' when 1 then 'customer' else 'lineitem' end as tab,
           '{{"kwargs":{{"max_value":null,"min_value":' || cast(cast(l_quantity as bigint) as string) || '.0,"column":"'
           || case l_orderkey % 3 when 0 then 'o_totalprice' when 1 then 'c_acctbal' else 'l_tax' end
           || '"}},"type":"expect_column_values_to_be_between"}}' as spec from {lineitem}""",
    )


def new_proposals(spark, sf_dir):
    found = R.new_proposals(
        proposals_for_known_rules(spark, sf_dir), revisions(spark, sf_dir)
    )
    return found.select("candidate_id", "line", "table", "spec_key")


def catalog_usage(spark, sf_dir):
    return R.catalog_usage(revisions(spark, sf_dir)).select("type", "in_use")


def catalog_usage_of_table(spark, sf_dir):
    return R.catalog_usage(revisions(spark, sf_dir), "customer").select("type", "in_use")


def workbench(spark, sf_dir):
    shown = R.workbench(revisions(spark, sf_dir), profiles(spark, sf_dir))
    return shown.select(
        "rule_id", "table", "revision", "column", "status", "state_label", "statement", "evidence", "bulk", "held"
    )


def statement(spark, sf_dir):
    """The sentence of every revision."""
    told = text.with_sentence(revisions(spark, sf_dir))
    return told.select("rule_id", "revision", "column", "statement")


def spec_identity(spark, sf_dir):
    """The key of specs that differ in key order, spelling of numbers, nulls and provenance."""
    specs = D.from_sql(
        spark, sf_dir,
        """select o_orderkey, '{{"kwargs":{{"mostly":' || case o_orderkey % 2 when 0 then '0.50' else '0.5' end
           || ',"batch_id":"b' || cast(o_orderkey as string) || '","min_value":' || cast(o_custkey as string)
           || case o_orderkey % 4 when 0 then '.0' when 1 then '' when 2 then 'e0' else '.00' end
           || case o_orderkey % 5 when 0 then ',"max_value":null' else '' end
           || ',"column":"o_totalprice"}},"type":"expect_column_values_to_be_between"}}' as spec from {orders}""",
    )
    return S.with_spec_key(specs).select("o_orderkey", "spec_key")


def open_judgments(spark, sf_dir):
    return R.open_judgments(R.current(revisions(spark, sf_dir)))


def stored_run(name):
    """All accepted rules of one table, run over it as they are stored."""
    def query(spark, sf_dir):
        keys = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey"}
        run = run_table(D.table(spark, sf_dir, name), name, revisions(spark, sf_dir), f"run of {name}", [keys[name]])
        about = run.run.select("run_id", "status", "submitted", "coverage")
        found = run.results.select("run_id", "spec_key", "verdict", "unexpected_count").join(about, "run_id")
        recorded = run.record.select(F.col("record_id").alias("run_id"), F.size("results").alias("recorded"))
        return found.join(recorded, "run_id", "left")

    return query


QUERIES = {
    f.__name__: f
    for f in (
        revision_history, rule_history, current_rules, accepted_rules, executable_rules, rule_counts,
        rule_counts_per_user, revision_conflicts, invalid_revisions, amend, judge, refused_judgments,
        propose, judge_batch, judge_batch_refused, new_proposals, catalog_usage, workbench, statement, spec_identity,
        open_judgments, stored_revisions, table_history, refused_edits, edit_outcomes, judge_in_order,
        judgments_without_order, catalog_usage_of_table,
    )
}

QUERIES |= {f"run_{name}": stored_run(name) for name in RULE_TABLES}

# --- the SQL side --------------------------------------------------------------------

REV = D.for_oracle(D.REVISIONS)
RAW = D.for_oracle(D.RAW_REVISIONS)
COLS = 'rule_id, revision, tab as "table", spec, status, reason, written_at'
CURRENT = f"(select * from ({REV}) v qualify row_number() over (partition by rule_id order by revision desc) = 1)"
COLUMN = "json_extract_string(spec, '$.kwargs.column')"
Q = "json_extract_string(spec, '$.kwargs.min_value')"


def sentence_sql() -> str:
    return f"""case json_extract_string(spec, '$.type')
        when 'expect_column_values_to_be_between' then 'Every ' || {COLUMN} || ' is at least ' || {Q}
        when 'expect_column_values_to_not_be_null' then 'Every ' || {COLUMN} || ' has a value'
        when 'expect_column_values_to_be_unique' then 'No two rows share the same ' || {COLUMN} || ', in at least 95% of rows'
        else 'Row count is at least ' || {Q} end"""


def key_sql() -> str:
    return f"""'["' || json_extract_string(spec, '$.type') || '",{{' ||
        case json_extract_string(spec, '$.type')
        when 'expect_column_values_to_be_between' then '"column":"' || {COLUMN} || '","min_value":' || {Q}
        when 'expect_column_values_to_not_be_null' then '"column":"' || {COLUMN} || '"'
        when 'expect_column_values_to_be_unique' then '"column":"' || {COLUMN} || '","mostly":0.95'
        else '"min_value":' || {Q} end || '}}]'"""


def uuid_sql(text_sql: str) -> str:
    return D._uuid(text_sql)


ORDER_RULE = uuid_sql("'rule' || cast(o_orderkey as string)")
PART_RULE = uuid_sql("'{batch}|' || cast(p_partkey as string)")
PART_SPEC = """'{"kwargs":{"value_set":["' || p_type || '",' || cast(p_size as varchar) || '.0],"column":"'
    || case when p_partkey % 3 = 0 then 'o_comment' else 'o_orderpriority' end
    || '"},"type":"expect_column_values_to_be_in_set"}'"""
DECISION = f"""select {ORDER_RULE} as rule_id,
    case o_orderstatus when 'O' then 'accepted' when 'F' then 'rejected' else 'shelved' end as status,
    case when o_orderkey % 2 = 0 then 'judged' when o_orderkey % 3 = 0 then ' ' end as reason from orders"""
FAULT = """case when status = 'shelved' then 'shelved is no state of a rule'
    when status = 'rejected' and trim(coalesce(reason, '')) = '' then 'a rejection needs a reason' end"""
EVIDENCE = """(select format('{:,} rows scanned · 0 nulls · {:,} distinct · min observed {} · max observed {}',
    count(*), count(distinct o_totalprice), cast(min(o_totalprice) as varchar), cast(max(o_totalprice) as varchar)) from orders)"""


def evidence_sql(name: str, column: str) -> str:
    """The evidence of a rule of a table: on its column, or on the table alone."""
    own = EVIDENCE.replace("o_totalprice", column).replace("from orders", f"from {name}")
    size = f"(select format('{{:,}} rows scanned', count(*)) from {name})"
    return f"case when {COLUMN} is null then {size} else {own} end"


LABEL = """case status when 'proposed' then 'Unsaved proposal' when 'needs_review' then 'Held for review'
    when 'accepted' then 'In use' else 'Rejected' end"""

ORACLES = {
    "revision_history": f"select {COLS} from ({REV}) v",
    "stored_revisions": f"""select rule_id, revision, tab as "table", spec, status, reason from ({REV}) v""",
    "table_history": f"select rule_id, revision, status from ({REV}) v where tab = 'orders'",
    "rule_history": f"""select revision, tab as "table", status from ({REV}) v where rule_id < '1'""",
    "current_rules": f"select {COLS} from {CURRENT} c",
    "accepted_rules": f"""select rule_id, tab as "table", spec from {CURRENT} c where status = 'accepted'""",
    "executable_rules": f"""select tab as "table", rule_id, spec, {key_sql()} as spec_key
        from {CURRENT} c where status = 'accepted'""",
    "rule_counts": " union all ".join(
        f"""select '{n}' as "table", count(*) as approx_rows,
            (select count(*) from {CURRENT} c where status = 'accepted' and tab = '{n}') as accepted_rules from {n}"""
        for n in COLUMNS
    ),
    "rule_counts_per_user": """
        select 'user_' || user_id as "table", count(*) as approx_rows,
               count(*) filter (where user_id % 3 <> 0 and event_type = 'view') as accepted_rules
        from events group by user_id""",
    "revision_conflicts": f"""
        select rule_id, revision, count(*) as copies from ({RAW}) v group by 1, 2 having count(*) > 1""",
    "invalid_revisions": f"""
        select rule_id, revision, tab as "table", spec, status, reason, written_at, fault from (
          select *, case when status = 'parked' then 'parked is no state of a rule'
                         when status = 'rejected' and trim(coalesce(reason, '')) = '' then 'a rejection needs a reason'
                         when revision < 1 then 'revisions start at 1' end as fault
          from ({RAW}) v) f
        where fault is not null""",
    "amend": f"""
        select rule_id, cast(revision + 1 as int) as revision, tab as "table",
               '{{"type":"expect_table_row_count_to_be_between","kwargs":{{"max_value":' || o_custkey || '}}}}' as spec,
               'needs_review' as status, cast(null as varchar) as reason, timestamp '2024-06-01' as written_at
        from {CURRENT} c join orders on rule_id = {ORDER_RULE}
        where o_totalprice > 100000 and o_orderkey % 10 <> 0""",
    "judge": f"""
        select c.rule_id, cast(revision + 1 as int) as revision, tab as "table", spec, d.status, d.reason,
               timestamp '2024-06-01' as written_at
        from {CURRENT} c join ({DECISION}) d on c.rule_id = d.rule_id
        where {FAULT.replace("status", "d.status").replace("reason,", "d.reason,")} is null""",
    "refused_judgments": f"""
        select rule_id, fault from (
          select d.rule_id, coalesce({FAULT}, case when r.rule_id is null then 'there is no rule with this id' end) as fault
          from ({DECISION}) d left join (select distinct rule_id from ({REV}) v) r on d.rule_id = r.rule_id) f
        where fault is not null""",
    "propose": f"""
        select {PART_RULE.replace("{batch}", "first")} as rule_id, 1 as revision, 'orders' as "table", {PART_SPEC} as spec,
               'proposed' as status, cast(null as varchar) as reason, timestamp '2024-06-01' as written_at
        from part where p_partkey % 3 <> 0""",
    "judge_batch": f"""
        with fresh as (select {PART_RULE.replace("{batch}", "second")} as rule_id, {PART_SPEC} as spec from part where p_partkey % 3 <> 0)
        select rule_id, 1 as revision, 'orders' as "table", spec, 'proposed' as status, cast(null as varchar) as reason from fresh
        union all select rule_id, 2, 'orders', spec, 'rejected', 'not ours' from fresh
        union all select rule_id, cast(revision + 1 as int), tab, spec, 'rejected', 'not ours'
        from {CURRENT} c where status = 'needs_review'""",
    "judge_batch_refused": '''
        select p_partkey as candidate_id, reason, reason as told
        from part, (select 'expect_column_values_to_be_in_set: orders has no column "o_comment"' as reason) r
        where p_partkey % 3 = 0''',
    "new_proposals": f"""
        with offered as (
          select l_orderkey as candidate_id, l_linenumber as line,
                 case l_orderkey % 3 when 0 then 'orders' when 1 then 'customer' else 'lineitem' end as tab,
                 '["expect_column_values_to_be_between",{{"column":"'
                 || case l_orderkey % 3 when 0 then 'o_totalprice' when 1 then 'c_acctbal' else 'l_tax' end
                 || '","min_value":' || cast(l_quantity as bigint) || '}}]' as spec_key from lineitem),
        held as (select distinct tab, {key_sql()} as spec_key from {CURRENT} c)
        select candidate_id, line, tab as "table", spec_key from offered o
        where not exists (select 1 from held h where h.tab = o.tab and h.spec_key = o.spec_key)""",
    "workbench": f"""
        select rule_id, tab as "table", revision, {COLUMN} as "column", status, {LABEL} as state_label, {sentence_sql()} as statement,
               case tab when 'orders' then {evidence_sql("orders", "o_totalprice")}
                        when 'customer' then {evidence_sql("customer", "c_acctbal")}
                        else {evidence_sql("lineitem", "l_quantity")} end as evidence,
               status = 'proposed' as bulk, status = 'needs_review' as held
        from {CURRENT} c""",
    "statement": f"""select rule_id, revision, {COLUMN} as "column", {sentence_sql()} as statement from ({REV}) v""",
    "spec_identity": """
        select o_orderkey, '["expect_column_values_to_be_between",{"column":"o_totalprice","min_value":'
               || o_custkey || ',"mostly":0.5}]' as spec_key from orders""",
    "open_judgments": f"""
        select rule_id, status, target, label, target = 'accepted' as primary
        from {CURRENT} c, (values ('accepted', 'Accept — I vouch for this'), ('rejected', 'Reject…'),
                                  ('needs_review', 'Ask business')) j(target, label)
        where target <> status""",
}
EDITED = f"""select {ORDER_RULE} as rule_id, case when o_orderkey % 10 = 0
    then '{{"type":"expect_column_values_to_be_unique","kwargs":{{"column":"missing"}}}}'
    else '{{"type":"expect_table_row_count_to_be_between","kwargs":{{"max_value":' || o_custkey || '}}}}' end as spec,
    o_orderkey % 10 = 0 as bad from orders where o_totalprice > 100000"""
ORACLES["refused_edits"] = f"""
    select e.rule_id, e.spec, case when c.rule_id is null then 'there is no rule with this id'
        else 'expect_column_values_to_be_unique: ' || tab || ' has no column "missing"' end as fault
    from ({EDITED}) e left join {CURRENT} c on e.rule_id = c.rule_id where c.rule_id is null or bad"""
ORACLES["edit_outcomes"] = f"""
    select outcome, count(rule_id) as edits
    from (values ('written'), ('refused')) o(outcome)
    left join (select e.rule_id, case when c.rule_id is null or bad then 'refused' else 'written' end as kind
               from ({EDITED}) e left join {CURRENT} c on e.rule_id = c.rule_id) k on kind = outcome
    group by 1"""
BY_LINE = f"""(select *, {FAULT} as fault from ({D.for_oracle(LINE_DECISIONS)}) d)"""
ORACLES["judge_in_order"] = f"""
    select c.rule_id, cast(revision + row_number() over (partition by c.rule_id order by line) as int) as revision, d.status, d.reason
    from {CURRENT} c join {BY_LINE} d on c.rule_id = d.rule_id where fault is null"""
ORACLES["judgments_without_order"] = f"""
    select rule_id, line, coalesce(fault, 'there is more than one of these for this rule, and no order was given') as fault
    from (select *, count(*) filter (where fault is null) over (partition by rule_id) as n from {BY_LINE} d) x
    where fault is not null or n > 1"""
RUN_COLUMN = {"orders": "o_totalprice", "customer": "c_acctbal", "lineitem": "l_quantity"}


def stored_run_sql(name: str) -> str:
    column = RUN_COLUMN[name]
    return f"""
    with s as (select distinct {key_sql()} as spec_key, json_extract_string(spec, '$.type') as type,
                      cast({Q} as double) as q from {CURRENT} c where status = 'accepted' and tab = '{name}'),
    t as (select count(*) as n, (select coalesce(sum(k), 0) from (select count(*) as k from {name} group by {column} having count(*) > 1) d) as shared
          from {name}),
    v as (select spec_key, n, shared, type, q,
                 case type when 'expect_column_values_to_be_between' then (select count(*) from {name} where {column} < q)
                           when 'expect_column_values_to_not_be_null' then 0
                           when 'expect_column_values_to_be_unique' then shared end as bad from s, t),
    r as (select spec_key, cast(bad as bigint) as unexpected_count,
                 case when case type when 'expect_table_row_count_to_be_between' then n >= q
                           when 'expect_column_values_to_be_unique' then (n - bad) / n >= 0.95 else bad = 0 end
                      then 'passed' else 'failed' end as verdict from v)
    select 'run of {name}' as run_id, spec_key, verdict, unexpected_count,
           case when bool_or(verdict = 'failed') over () then 'failed' else 'passed' end as status,
           count(*) over () as submitted, count(*) over () as coverage, cast(count(*) over () as int) as recorded from r"""


ORACLES |= {f"run_{name}": stored_run_sql(name) for name in RULE_TABLES}
TYPES_USED = (
    "expect_column_values_to_be_between", "expect_column_values_to_not_be_null",
    "expect_column_values_to_be_unique", "expect_table_row_count_to_be_between",
)
UNUSED = (
    "expect_column_values_to_be_null", "expect_column_unique_value_count_to_be_between",
    "expect_column_values_to_be_in_set", "expect_column_values_to_not_be_in_set",
    "expect_column_mean_to_be_between", "expect_column_values_to_match_regex",
    "expect_column_values_to_not_match_regex", "expect_column_value_lengths_to_be_between",
    "expect_column_values_to_be_of_type", "expect_column_values_to_be_in_type_list",
    "expect_column_to_exist",
)
for _name, _where in (("catalog_usage", "true"), ("catalog_usage_of_table", "tab = 'customer'")):
    ORACLES[_name] = " union all ".join(
        f"""select '{t}' as type, (select count(*) from {CURRENT} c where {_where}
            and json_extract_string(spec, '$.type') = '{t}') > 0 as in_use"""
        for t in TYPES_USED + UNUSED
    )
