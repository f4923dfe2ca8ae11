"""Run records, the coverage ranking and the review queue, over runs derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import history as H
from plumbline.operators import results as R
from plumbline.operators import review as V
from plumbline.operators.ranges import shared_folder
from plumbline.sources import store
from workload import derived as D
from workload.checks import magnitude_sql
from workload.rules import CURRENT, EVIDENCE, LABEL, key_sql, profiles, revisions, sentence_sql


def runs(spark, sf_dir):
    return D.from_sql(spark, sf_dir, D.RUNS)


def submitted(spark, sf_dir):
    return D.from_sql(spark, sf_dir, D.SUBMITTED)


def results(spark, sf_dir):
    """The reported results, dressed as a suite dresses them."""
    reported = R.with_spec_key(D.from_sql(spark, sf_dir, D.RESULTS))
    seen = runs(spark, sf_dir).select("run_id", "scanned_rows", "total_rows")
    return reported.join(seen, "run_id").select(
        "run_id", "spec", "spec_key", "position", "verdict",
        text.status_atom(F.col("verdict"), F.col("scanned_rows"), F.col("total_rows")).alias("status"),
        F.when(
            F.col("verdict") != "errored", text.magnitude(F.col("position"), F.col("scanned_rows"))
        ).alias("magnitude"),
    )


def valid_runs(spark, sf_dir):
    return runs(spark, sf_dir).join(
        R.invalid_scans(runs(spark, sf_dir)).select("run_id"), "run_id", "left_anti"
    )


def records(spark, sf_dir):
    """A record per completed run; a run finished as many hours after the epoch as its number."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    hours = epoch + F.make_dt_interval(hours=F.col("run_id").cast("int"))
    return R.assemble_runs(
        valid_runs(spark, sf_dir), submitted(spark, sf_dir), results(spark, sf_dir), hours
    )


def result_pairs(spark, sf_dir):
    return R.join_results(submitted(spark, sf_dir), results(spark, sf_dir)).select("run_id", "spec_key", "verdict")


def result_pairs_of_repeated_rules(spark, sf_dir):
    """Runs that submit each rule twice and report each result twice: a pair per submitted rule."""
    asked, reported = submitted(spark, sf_dir), results(spark, sf_dir)
    pairs = R.join_results(asked.unionByName(asked), reported.unionByName(reported))
    return pairs.groupBy("run_id", "spec_key", "verdict").agg(F.count(F.lit(1)).alias("pairs"))


def missing_results(spark, sf_dir):
    return R.missing_results(submitted(spark, sf_dir), results(spark, sf_dir)).select("run_id", "spec_key")


def coverage(spark, sf_dir):
    return R.coverage(results(spark, sf_dir))


def rollup(spark, sf_dir):
    return R.rollup(results(spark, sf_dir))


def completed_runs(spark, sf_dir):
    return R.completed_runs(runs(spark, sf_dir), submitted(spark, sf_dir), results(spark, sf_dir))


def invalid_scans(spark, sf_dir):
    return R.invalid_scans(runs(spark, sf_dir))


def run_records(spark, sf_dir):
    found = records(spark, sf_dir)
    return found.select(
        "record_id", "table", "status", "scanned_rows", "total_rows", "coverage",
        F.size("results").cast("bigint").alias("rules"),
        "finished_at",
    )


def stored_records(spark, sf_dir):
    """The records written and read again, one row per nested result."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    store.append_records(records(spark, sf_dir), path)
    read = store.read_records(spark, path).select("record_id", F.explode("results").alias("r"))
    return read.select("record_id", "r.spec_key", "r.verdict")


def record_results(spark, sf_dir):
    """The nested results of every record, one row per result, from its JSON document."""
    documents = R.documents(records(spark, sf_dir))
    shape = "array<struct<position int, spec_key string, verdict string, status string, magnitude string>>"
    read = documents.select("record_id", F.posexplode(F.from_json("results", shape)).alias("place", "r"))
    return read.select("record_id", "place", "r.spec_key", "r.verdict", "r.status", "r.magnitude")


def event_records(spark, sf_dir):
    found = D.from_sql(spark, sf_dir, D.RECORDS)
    return found.withColumn("results", F.array(F.lit(1), F.lit(2), F.lit(3)))


def latest_run(spark, sf_dir):
    return H.latest(event_records(spark, sf_dir), "user_7").select("record_id", "status", "finished_at")


def latest_per_table(spark, sf_dir):
    return H.latest_per_table(event_records(spark, sf_dir)).select(
        "record_id", "table", "status", "scanned_rows", "total_rows", "coverage", "finished_at"
    )


def find_run(spark, sf_dir):
    return H.find(event_records(spark, sf_dir), "42").select("record_id", "table", "status")


def status_atom(spark, sf_dir):
    """The verdict line of every run, with its sampling clause."""
    line = text.status_atom(F.col("status"), F.col("scanned_rows"), F.col("total_rows"))
    return event_records(spark, sf_dir).select("record_id", line.alias("atom"))


def user_tables(spark, sf_dir):
    """Users as tables, their events as rows, and buyers as tables that were never run."""
    events = D.table(spark, sf_dir, "events")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    seen = events.groupBy(name.alias("table")).agg(F.count(F.lit(1)).alias("approx_rows"))
    customers = D.table(spark, sf_dir, "customer")
    unseen = customers.select(
        F.concat(F.lit("buyer_"), F.col("c_custkey").cast("string")).alias("table"),
        (F.col("c_nationkey").cast("bigint") * 1000).alias("approx_rows"),
    )
    return seen.unionByName(unseen)


def coverage_ranking(spark, sf_dir):
    rules = D.from_sql(spark, sf_dir, D.USER_REVISIONS)
    listed = H.coverage_listing(user_tables(spark, sf_dir), rules, event_records(spark, sf_dir))
    return listed.drop("why")


def coverage_order(spark, sf_dir):
    """Every table with its place in the ranking."""
    rules = D.from_sql(spark, sf_dir, D.USER_REVISIONS)
    ranked = H.coverage_listing(user_tables(spark, sf_dir), rules, event_records(spark, sf_dir))
    listed = ranked.select("bucket", "table", F.monotonically_increasing_id().alias("row"))
    return listed.select("bucket", "table", F.row_number().over(Window.orderBy("row")).alias("place"))


def coverage_with_empty_bucket(spark, sf_dir):
    """Only tables that were never run: the other two buckets are there all the same."""
    rules = D.from_sql(spark, sf_dir, D.USER_REVISIONS)
    unseen = user_tables(spark, sf_dir).filter(F.col("table").startswith("buyer_"))
    listed = H.coverage_listing(unseen, rules, event_records(spark, sf_dir))
    return listed.groupBy("bucket_no", "bucket", "heading").agg(
        F.count("table").alias("tables"), F.max("status").alias("status")
    )


def review_queue(spark, sf_dir):
    queue = V.review_queue(revisions(spark, sf_dir), records(spark, sf_dir))
    return queue.select("rule_id", "revision", "table", "spec", "status", "failing", "magnitude")


def review_queue_of_table(spark, sf_dir):
    queue = V.review_queue(revisions(spark, sf_dir), records(spark, sf_dir), "lineitem")
    return queue.select("rule_id", "status", "failing")


def held_rules(spark, sf_dir):
    return V.review_queue(revisions(spark, sf_dir), records(spark, sf_dir))


def queue_position(spark, sf_dir):
    placed = V.with_position(held_rules(spark, sf_dir))
    return placed.select("table", "rule_id", "position", "total")


def budget(spark, sf_dir):
    return V.with_budget(V.with_position(held_rules(spark, sf_dir))).select("rule_id", "budget")


def review_cards(spark, sf_dir):
    cards = V.awaiting(revisions(spark, sf_dir), records(spark, sf_dir), profiles(spark, sf_dir))
    return cards.select("table", "rule_id", "column", "state_label", "statement", "evidence", "failing", "position")


def run_slots(spark, sf_dir):
    """The verdict slot of every table, whether or not it was ever run."""
    rules = D.from_sql(spark, sf_dir, D.USER_REVISIONS)
    ranked = H.ranked_tables(user_tables(spark, sf_dir), rules, event_records(spark, sf_dir))
    return ranked.select("table", "rows", "status", "bucket")


QUERIES = {
    f.__name__: f
    for f in (
        result_pairs, result_pairs_of_repeated_rules, missing_results, coverage, rollup, completed_runs, invalid_scans, run_records,
        record_results, stored_records, latest_run, latest_per_table, find_run, status_atom, coverage_ranking,
        coverage_order, coverage_with_empty_bucket, run_slots, review_queue, review_queue_of_table,
        queue_position, budget, review_cards,
    )
}

# --- the SQL side --------------------------------------------------------------------

RUNS = D.for_oracle(D.RUNS)
SUBMITTED = f"(select run_id, spec, {key_sql()} as spec_key from ({D.for_oracle(D.SUBMITTED)}) s)"
SAMPLED = "case when scanned_rows < total_rows then format(' · sampled {:,} / {:,}', scanned_rows, total_rows) else '' end"
ATOM = "upper({v}) || case when {v} = 'errored' then ' · rule could not run' else '' end || " + SAMPLED
RESULTS = f"""(select r.run_id, spec, spec_key, position, verdict, {ATOM.replace("{v}", "verdict")} as status,
    case when verdict <> 'errored' then {magnitude_sql("position", "scanned_rows")} end as magnitude
    from (select *, {key_sql()} as spec_key from ({D.for_oracle(D.RESULTS)}) x) r join ({RUNS}) u on r.run_id = u.run_id)"""
LOUDEST = """case when bool_or(verdict = 'failed') then 'failed' when bool_or(verdict = 'errored') then 'errored' else 'passed' end"""
COMPLETED = f"""(
    select u.*, coalesce(a.n, 0) as submitted, coalesce(a.m, 0) as reported, coalesce(b.covered, 0) as coverage,
           case when refusal is null then b.status end as status, refusal
    from ({RUNS}) u
    left join (select s.run_id, count(*) as n, count(r.run_id) as m from {SUBMITTED} s
               left join {RESULTS} r on s.run_id = r.run_id and s.spec_key = r.spec_key group by 1) a on u.run_id = a.run_id
    left join (select run_id, count(*) as n, count(*) filter (where verdict <> 'errored') as covered, {LOUDEST} as status
               from {RESULTS} r group by 1) b on u.run_id = b.run_id,
    lateral (select case when coalesce(a.n, 0) = 0 then 'nothing was submitted in this run'
                         when a.m < a.n then 'results of ' || a.m || ' rules, and ' || a.n || ' were submitted'
                         when b.covered = 0 then 'no rule ran: all ' || b.n || ' errored' end as refusal) f)"""
RECORDED = f"(select * from {COMPLETED} c where refusal is null and scanned_rows between 0 and total_rows)"
EVENT_RECORDS = D.for_oracle(D.RECORDS)
LATEST = f"(select * from ({EVENT_RECORDS}) v qualify row_number() over (partition by tab order by finished_at desc, record_id desc) = 1)"
USER_TABLES = """(select 'user_' || user_id as tab, count(*) as approx_rows,
        count(*) filter (where user_id % 3 <> 0 and event_type = 'view') as accepted_rules from events group by user_id
    union all select 'buyer_' || c_custkey, cast(c_nationkey as bigint) * 1000, 0 from customer)"""
RANKED = f"""(
    select t.tab, t.approx_rows, accepted_rules, record_id, v.status as verdict,
           case when record_id is null then 'NEVER RUN' || case when accepted_rules = 0 then ' · NO RULES' else '' end
                else {ATOM.replace("{v}", "v.status")} end as status,
           case when record_id is null then 'never-run' when scanned_rows < total_rows or coverage < 3 then 'unverifiable'
                else 'verified' end as bucket
    from {USER_TABLES} t left join {LATEST} v on t.tab = v.tab)"""
BUCKETS = """(values (1, 'never-run', '1 · Never run'), (2, 'unverifiable', '2 · Ran, but unverifiable'),
    (3, 'verified', '3 · Verified')) b(bucket_no, bucket, heading)"""
LAST_RUNS = f"(select * from {RECORDED} r qualify row_number() over (partition by tab order by cast(run_id as bigint) desc) = 1)"
FAILING = f"""(select l.tab, spec_key, r.status as failing, r.magnitude from {LAST_RUNS} l
    join {RESULTS} r on l.run_id = r.run_id where r.verdict = 'failed')"""
QUEUE = f"""(
    select c.rule_id, c.revision, c.tab, c.spec, c.status, f.failing, f.magnitude
    from (select *, {key_sql()} as k from {CURRENT} c) c
    left join {FAILING} f on c.tab = f.tab and c.k = f.spec_key and c.status = 'accepted'
    where c.status = 'needs_review' or f.failing is not null)"""
PLACED = f"""(select *, row_number() over (partition by tab order by rule_id) as position,
    count(*) over (partition by tab) as total from {QUEUE} q)"""

ORACLES = {
    "result_pairs": f"""select s.run_id, s.spec_key, r.verdict from {SUBMITTED} s
        join {RESULTS} r on s.run_id = r.run_id and s.spec_key = r.spec_key""",
    "result_pairs_of_repeated_rules": f"""select s.run_id, s.spec_key, r.verdict, 2 * count(*) as pairs from {SUBMITTED} s
        join {RESULTS} r on s.run_id = r.run_id and s.spec_key = r.spec_key group by all""",
    "missing_results": f"""select s.run_id, s.spec_key from {SUBMITTED} s
        left join {RESULTS} r on s.run_id = r.run_id and s.spec_key = r.spec_key where r.run_id is null""",
    "coverage": f"""select run_id, count(*) filter (where verdict <> 'errored') as coverage, count(*) as rules
        from {RESULTS} r group by 1""",
    "rollup": f"select run_id, {LOUDEST} as status from {RESULTS} r group by 1",
    "completed_runs": f"""select run_id, tab as "table", scanned_rows, total_rows, submitted, reported, coverage,
        status, refusal from {COMPLETED} c""",
    "invalid_scans": f"""select run_id, tab as "table", scanned_rows, total_rows from ({RUNS}) u
        where scanned_rows < 0 or scanned_rows > total_rows""",
    "run_records": f"""select run_id as record_id, tab as "table", status, scanned_rows, total_rows, coverage,
        (select count(*) from {RESULTS} r where r.run_id = c.run_id) as rules,
        timestamp '1970-01-01' + to_hours(cast(run_id as int)) as finished_at from {RECORDED} c""",
    "record_results": f"""select c.run_id as record_id,
        cast(row_number() over (partition by c.run_id order by position, spec_key) - 1 as int) as place,
        spec_key, verdict, r.status, magnitude from {RECORDED} c join {RESULTS} r on c.run_id = r.run_id""",
    "stored_records": f"""select c.run_id as record_id, spec_key, verdict from {RECORDED} c
        join {RESULTS} r on c.run_id = r.run_id""",
    "latest_run": f"""select record_id, status, finished_at from ({EVENT_RECORDS}) v where tab = 'user_7'
        order by finished_at desc, record_id desc limit 1""",
    "latest_per_table": f"""select record_id, tab as "table", status, scanned_rows, total_rows, coverage, finished_at
        from {LATEST} v""",
    "find_run": f"""select record_id, tab as "table", status from ({EVENT_RECORDS}) v where record_id = '42'""",
    "status_atom": f"""select record_id, {ATOM.replace("{v}", "status")} as atom from ({EVENT_RECORDS}) v""",
    "coverage_ranking": f"""select bucket_no, b.bucket, heading, tab as "table",
        case when tab is not null then format('{{:,}}', approx_rows) end as rows, accepted_rules, status, verdict, record_id
        from {BUCKETS} left join {RANKED} r on b.bucket = r.bucket""",
    "coverage_order": f"""select b.bucket, tab as "table", cast(row_number() over (
        order by bucket_no, coalesce(accepted_rules, 0) > 0, approx_rows desc, tab) as int) as place
        from {BUCKETS} left join {RANKED} r on b.bucket = r.bucket""",
    "coverage_with_empty_bucket": f"""select bucket_no, b.bucket, heading, count(tab) as tables, max(status) as status
        from {BUCKETS} left join (select * from {RANKED} r where tab like 'buyer%') r
        on b.bucket = r.bucket group by all""",
    "run_slots": f"""select tab as "table", format('{{:,}}', approx_rows) as rows, status, bucket from {RANKED} r""",
    "review_queue": f"""select rule_id, revision, tab as "table", spec, status, failing, magnitude from {QUEUE} q""",
    "review_queue_of_table": f"""select rule_id, status, failing from {QUEUE} q where tab = 'lineitem'""",
    "queue_position": f"""select tab as "table", rule_id, position, total from {PLACED} p""",
    "budget": f"""select rule_id, 'Decision ' || position || ' of ' || total || ' for ' || tab || ' · ' ||
        case when position = total then 'the last one'
             else 'about ' || m || case when m = 1 then ' minute left' else ' minutes left' end
                  || case when m > 5 then ' — past the five minutes this is supposed to take' else '' end end as budget
        from (select *, cast(ceil((total - position) * 20 / 60) as bigint) as m from {PLACED} p) x""",
    "review_cards": f"""select tab as "table", rule_id, json_extract_string(spec, '$.kwargs.column') as "column",
        {LABEL} as state_label, {sentence_sql()} as statement,
        case when json_extract_string(spec, '$.kwargs.column') is null then
             case tab when 'orders' then (select format('{{:,}} rows scanned', count(*)) from orders)
                      when 'customer' then (select format('{{:,}} rows scanned', count(*)) from customer)
                      else (select format('{{:,}} rows scanned', count(*)) from lineitem) end
             else case tab when 'orders' then {EVIDENCE}
                  when 'customer' then {EVIDENCE.replace("o_totalprice", "c_acctbal").replace("from orders", "from customer")}
                  else {EVIDENCE.replace("o_totalprice", "l_quantity").replace("from orders", "from lineitem")} end end as evidence,
        failing, position from {PLACED} p""",
}
