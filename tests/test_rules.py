"""The rule registry, run records, the coverage ranking and the review queue."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import history, profile, registry, results, review
from plumbline.sources import store
from tests.conftest import spec

T0 = dt.datetime(2029, 7, 1)
# A weather service: stations and the readings they send.
DRY = spec("column_values_to_be_between", column="rain", max_value=90.0)
WIND = spec("column_values_to_be_in_set", column="wind", value_set=["calm", "gale"])
SENT = spec("column_values_to_not_be_null", column="sent")
NAMED = spec("column_values_to_be_unique", column="name")


def text_of(rule):
    return json.dumps(rule)


@pytest.fixture
def revisions(frame):
    def build(*rows):
        full = [
            (rule, rev, table, text_of(s), status, reason, T0 + dt.timedelta(hours=i))
            for i, (rule, rev, table, s, status, reason) in enumerate(rows)
        ]
        return frame(full, registry.REVISION_SCHEMA.replace("timestamp", "timestamp_ntz"))

    return build


@pytest.fixture
def book(revisions):
    """Four rules on two tables: one in use, one turned down, one waiting, one new."""
    return revisions(
        ("wind", 1, "readings", WIND, "proposed", None),
        ("name", 1, "stations", NAMED, "proposed", None),
        ("name", 2, "stations", NAMED, "rejected", "twins share a name"),
        ("dry", 1, "readings", DRY, "proposed", None),
        ("dry", 2, "readings", DRY, "needs_review", None),
        ("dry", 3, "readings", DRY, "accepted", None),
        ("sent", 1, "readings", SENT, "needs_review", None),
    )


@pytest.fixture
def schema(frame):
    columns = [("readings", c) for c in ("rain", "wind", "sent")] + [("stations", "name"), ("stations", "rain")]
    return frame(columns, "table string, column string")


def stamped(df):
    return df.withColumn("written_at", F.col("written_at").cast("timestamp"))


def test_only_the_newest_revision_counts(book, revisions):
    assert {r.rule_id: r.status for r in registry.current(book).collect()} == {
        "wind": "proposed", "name": "rejected", "dry": "accepted", "sent": "needs_review",
    }
    withdrawn = book.unionByName(revisions(("dry", 4, "readings", DRY, "needs_review", None), ("sent", 2, "readings", SENT, "accepted", None)))
    assert [r.rule_id for r in registry.accepted(withdrawn).collect()] == ["sent"]
    assert [r.table for r in registry.executable(withdrawn).collect()] == ["readings"]
    assert registry.revisions(withdrawn, rule_id="dry").count() == 4
    assert registry.revisions(withdrawn, table="stations").count() == 2


def test_rows_that_a_higher_number_replaced_are_not_ranked(frame):
    rows = [(f"r{i % 7}", n, f"s{i % 3}") for i in range(200) for n in (i % 5, None)]
    rules = frame([*rows, (None, 1, "s"), (None, 4, "t"), ("lone", None, "u")], "rule_id string, revision int, spec string")
    newest = registry.current(rules)

    def last(rule):
        return max(((n is not None, n, s) for r, n, s in [*rows, (None, 1, "s"), (None, 4, "t"), ("lone", None, "u")] if r == rule), key=str)[1:]

    assert {r.rule_id: (r.revision, r.spec) for r in newest.collect()} == {
        r: last(r) for r in [*{f"r{i}" for i in range(7)}, None, "lone"]
    }
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Window"):]  # so the sort gets one row a rule, but for ties


def test_invalid_and_conflicting_revisions_are_found(revisions):
    bad = revisions(
        ("fine", 2, "readings", DRY, "rejected", "too wet"),
        ("fine", 2, "readings", WIND, "proposed", None),
        ("fine", 2, "readings", SENT, "proposed", None),
        ("early", -1, "readings", DRY, "proposed", None),
        ("state", 1, "readings", DRY, "pending", None),
        ("shape", 1, "readings", {"type": "x", "kwargs": {}, "note": "?"}, "proposed", None),
        ("silent", 1, "readings", DRY, "rejected", "\t"),
    )
    assert sorted(r.rule_id for r in registry.invalid_revisions(bad).collect()) == ["early", "shape", "silent", "state"]
    assert [tuple(r) for r in registry.revision_conflicts(bad).collect()] == [("fine", 2, 3)]


def test_amending_appends_and_refuses_the_rest(book, schema, frame, spark, tmp_path):
    path = str(tmp_path / "rules")
    store.append_revisions(stamped(book), path)
    rules = store.read_revisions(spark, path)
    wetter = spec("column_values_to_be_between", column="rain", max_value=120)
    nowhere = spec("column_values_to_not_be_null", column="snow")
    edits = frame(
        [("dry", text_of(wetter), 1), ("sent", text_of(nowhere), 1), ("fog", text_of(SENT), 1), ("wind", text_of(WIND), 2), ("wind", text_of(SENT), 1)],
        "rule_id string, spec string, nth int",
    )
    written = registry.amend(rules, edits, schema).collect()
    assert [(r.rule_id, r.revision, r.status, json.loads(r.spec)) for r in written] == [("dry", 4, "needs_review", wetter)]
    faults = {(r.rule_id, r.nth): r.fault for r in registry.refused_edits(rules, edits, schema).collect()}
    assert faults[("fog", 1)] == registry.UNKNOWN_RULE and 'no column "snow"' in faults[("sent", 1)]
    assert faults[("wind", 1)] == faults[("wind", 2)] == registry.NO_ORDER
    assert len(written) + len(faults) == edits.count()

    in_turn = registry.amend(rules, edits, schema, order=["nth"])
    assert sorted((r.rule_id, r.revision, json.loads(r.spec)["type"]) for r in in_turn.collect()) == [
        ("dry", 4, wetter["type"]), ("wind", 2, SENT["type"]), ("wind", 3, WIND["type"]),
    ]
    assert registry.refused_edits(rules, edits, schema, order=["nth"]).count() == 2
    store.append_revisions(in_turn, path)
    assert registry.revision_conflicts(store.read_revisions(spark, path)).count() == 0


def test_edits_judged_once_serve_both_outcomes(book, schema, frame, monkeypatch):
    edits = frame(
        [("dry", text_of(DRY), 1), ("fog", text_of(SENT), 1), ("wind", text_of(WIND), 2), ("wind", text_of(SENT), 1)],
        "rule_id string, spec string, nth int",
    ).withColumn("note", F.lit(None))
    given, ranked = (book, edits, schema), []
    newest = registry.current
    monkeypatch.setattr(registry, "current", lambda rules: ranked.append(1) or newest(rules))
    judged = registry.judged_edits(*given)
    done, left = registry.amend(*given, judged=judged), registry.refused_edits(*given, judged=judged)
    assert left.columns == ["rule_id", "spec", "nth", "note", "fault"] and len(ranked) == 1
    assert [r.rule_id for r in done.collect()] == ["dry"]
    assert sorted((r.rule_id, r.nth, r.note) for r in left.collect()) == [("fog", 1, None), ("wind", 1, None), ("wind", 2, None)]


def test_a_batch_ranks_the_stored_rules_once(book, schema, frame, monkeypatch):
    ranked, newest = [], registry.current
    monkeypatch.setattr(registry, "current", lambda rules: ranked.append(1) or newest(rules))
    offered = frame([(1, "stations", text_of(NAMED))], "candidate_id int, table string, spec string")
    chosen = frame([("dry",), (None,), ("dry",)], "rule_id string")
    made = registry.judge_batch(stamped(book), offered, chosen, "rejected", "no", schema, "b")
    assert sorted((r.rule_id == "dry", r.revision, r.status) for r in made.collect()) == [
        (False, 1, "proposed"), (False, 2, "rejected"), (True, 4, "rejected"),
    ]
    # what is returned is read from what the check found, not from the revisions again
    assert len(ranked) == 1 and "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_judging_appends_and_refuses_the_rest(book, frame):
    decisions = frame(
        [("wind", "accepted", None, 1), ("sent", "rejected", "", 1), ("hail", "accepted", None, 1), ("name", "accepted", None, 2), ("name", "needs_review", None, 1)],
        "rule_id string, status string, reason string, nth int",
    )
    assert [(r.rule_id, r.revision, r.status) for r in registry.judge(book, decisions).collect()] == [("wind", 2, "accepted")]
    faults = {(r.rule_id, r.nth): r.fault for r in registry.refused_judgments(book, decisions).collect()}
    assert set(faults) == {("sent", 1), ("hail", 1), ("name", 1), ("name", 2)}
    assert "reason" in faults[("sent", 1)] and faults[("name", 1)] == registry.NO_ORDER
    judged = registry.judge(book, decisions, order=["nth"]).collect()
    assert sorted((r.rule_id, r.revision, r.status) for r in judged) == [
        ("name", 3, "needs_review"), ("name", 4, "accepted"), ("wind", 2, "accepted"),
    ]
    assert {json.loads(r.spec)["type"] for r in judged if r.rule_id == "name"} == {NAMED["type"]}
    assert registry.refused_judgments(book, decisions, order=["nth"]).count() == 2


def test_proposing_gives_the_same_ids_again(schema, frame):
    offered = frame(
        [(7, "readings", text_of(WIND)), (8, "stations", text_of(WIND))], "candidate_id int, table string, spec string"
    )
    fresh = registry.propose(offered, schema, "july").collect()
    assert [(r.revision, r.status, r.table) for r in fresh] == [(1, "proposed", "readings")]
    assert fresh == registry.propose(offered, schema, "july", F.lit(fresh[0].written_at)).collect()
    assert [r.candidate_id for r in registry.refused(offered, schema).collect()] == [8]


def test_a_batch_is_judged_whole_or_not_at_all(book, schema, frame):
    rules = stamped(book)

    def offered(*given):
        return frame([(i, t, text_of(s)) for i, (t, s) in enumerate(given)], "candidate_id int, table string, spec string")

    def ids(*given):
        return frame([(g,) for g in given], "rule_id string")

    fine = offered(("stations", NAMED), ("readings", SENT))
    written = registry.judge_batch(rules, fine, ids("wind", "wind", "sent"), "accepted", None, schema, "b").collect()
    assert sorted((r.revision, r.status) for r in written) == [(1, "proposed")] * 2 + [(2, "accepted")] * 4
    assert len({(r.rule_id, r.revision) for r in written}) == 6
    for candidates, chosen, status, reason, cap in [
        (offered(), ids(), "accepted", None, None),
        (fine, ids("wind"), "accepted", None, 2),
        (fine, ids("wind"), "rejected", " ", None),
        (fine, ids("wind"), "shelved", None, None),
        (offered(("stations", NAMED), ("stations", WIND)), ids("wind"), "accepted", None, None),
    ]:
        with pytest.raises(ValueError):
            registry.judge_batch(rules, candidates, chosen, status, reason, schema, "b", cap)
    with pytest.raises(LookupError, match="fog"):
        registry.judge_batch(rules, fine, ids("wind", "fog"), "accepted", None, schema, "b")


def test_known_rules_are_not_proposed_again(book, frame):
    offered = frame(
        [
            (1, "readings", '{"kwargs":{"max_value":9e1,"column":"rain"},"type":"expect_column_values_to_be_between"}'),
            (2, "stations", text_of(DRY)),
            (3, "stations", text_of(NAMED)),
        ],
        "id int, table string, spec string",
    )
    assert [r.id for r in registry.new_proposals(offered, book).collect()] == [2]


def test_tables_without_rules_stay_listed(book, frame):
    tables = frame([("readings", 5, 0), ("pictures", 7, 0), ("stations", 1, 0)], "table string, approx_rows bigint, accepted_rules bigint")
    counted = {r.table: r.accepted_rules for r in registry.rule_counts(tables, book).collect()}
    assert counted == {"readings": 1, "pictures": 0, "stations": 0}


def test_workbench_order_and_flags(book, spark):
    n = F.col("id")
    df = spark.range(30).select((n % 2).cast("string").alias("wind"), n.alias("rain"))
    shown = registry.workbench(book, profile.profile(df, "readings"), "readings").collect()
    assert [(r.rule_id, r.bulk, r.held) for r in shown] == [("dry", False, False), ("sent", False, True), ("wind", True, False)]
    assert shown[0].evidence == "30 rows scanned · 0 nulls · 30 distinct · min observed 0 · max observed 29"
    assert shown[1].evidence == "30 rows scanned" and shown[2].evidence.endswith("2 distinct: 0, 1")
    open_to = registry.open_judgments(registry.current(book)).filter("rule_id = 'dry'").collect()
    assert sorted(r.target for r in open_to) == ["needs_review", "rejected"]
    used = {r.type for r in registry.catalog_usage(book, "readings").filter("in_use").collect()}
    assert used == {DRY["type"], WIND["type"], SENT["type"]} and registry.catalog_usage(book).filter("in_use").count() == 4


# --- runs ----------------------------------------------------------------------------


@pytest.fixture
def run_frames(frame):
    def build(runs, asked, reported):
        return (
            frame(runs, "run_id string, table string, scanned_rows bigint, total_rows bigint"),
            frame([(r, text_of(s)) for r, s in asked], "run_id string, spec string"),
            frame([(r, text_of(s), v) for r, s, v in reported], "run_id string, spec string, verdict string"),
        )

    return build


def test_only_complete_runs_are_recorded(run_frames):
    outcome = {  # verdicts on DRY, WIND, SENT; None: it never reported
        "clear": ("passed", "passed", "passed"),
        "torn": ("errored", "failed", "errored"),
        "blind": ("errored", "errored", "errored"),
        "late": ("passed", None, None),
        "patchy": ("passed", "errored", "passed"),
    }
    rules = (DRY, WIND, SENT)
    asked = [(run, rule) for run in outcome for rule in rules] + [("extra", DRY)]
    reported = [(run, rule, v) for run, verdicts in outcome.items() for rule, v in zip(rules, verdicts) if v]
    reported += [("extra", DRY, "passed"), ("extra", DRY, "passed")]
    runs, asked, reported = run_frames([(r, "readings", 4, 4) for r in [*outcome, "idle", "extra"]], asked, reported)
    got = {r.run_id: r for r in results.completed_runs(runs, asked, reported).collect()}
    assert {k: (r.status, r.coverage) for k, r in got.items() if r.refusal is None} == {
        "clear": ("passed", 3), "torn": ("failed", 1), "patchy": ("errored", 2),
    }
    assert got["late"].refusal == "results of 1 rules, and 3 were submitted"
    assert got["extra"].refusal == "2 results for 1 rules"
    assert "nothing" in got["idle"].refusal and "all 3 errored" in got["blind"].refusal
    assert [r.run_id for r in results.missing_results(asked, reported).collect()] == ["late", "late"]
    assert {r.run_id: r.status for r in results.rollup(reported).collect()}["torn"] == "failed"
    assert {r.run_id: r.coverage for r in results.coverage(reported).collect()}["blind"] == 0
    records = results.assemble_runs(runs, asked, reported).collect()
    assert sorted((r.record_id, len(r.results)) for r in records) == [("clear", 3), ("patchy", 3), ("torn", 3)]


def test_results_pair_by_what_the_rule_says(run_frames):
    twice = [("r", WIND), ("r", SENT), ("r", WIND)]
    _, asked, reported = run_frames([("r", "t", 1, 1)], twice, [("r", SENT, "errored"), ("r", WIND, "passed"), ("r", WIND, "passed")])
    paired = sorted((json.loads(p.submitted_spec)["type"], p.verdict) for p in results.join_results(asked, reported).collect())
    assert paired == sorted([(WIND["type"], "passed")] * 2 + [(SENT["type"], "errored")])


def test_impossible_scans_are_found(frame):
    scans = {"all": (9, 9), "part": (0, 9), "more": (10, 9), "less": (-2, 9), "unknown": (None, 9), "unsized": (3, None)}
    runs = frame([(k, *v) for k, v in scans.items()], "run_id string, scanned_rows bigint, total_rows bigint")
    assert sorted(r.run_id for r in results.invalid_scans(runs).collect()) == ["less", "more", "unknown", "unsized"]


RECORD = (
    "record_id string, table string, status string, scanned_rows bigint, total_rows bigint, "
    "coverage bigint, results array<struct<spec_key:string,verdict:string,status:string,magnitude:string>>, "
    "finished_at timestamp_ntz"
)


def key_of(frame, s):
    from plumbline.functions.spec import with_spec_key

    return with_spec_key(frame([(text_of(s),)], "spec string")).first().spec_key


@pytest.fixture
def record(frame):
    def build(rows):
        full = []
        for i, (name, table, scanned, total, verdicts) in enumerate(rows):
            found = [
                {"spec_key": key_of(frame, s), "verdict": v, "status": v.upper(), "magnitude": "m" if v == "failed" else None}
                for s, v in verdicts
            ]
            kinds = [v for _, v in verdicts]
            status = next(v for v in results.PRECEDENCE if v in kinds)
            covered = sum(v != "errored" for v in kinds)
            full.append((name, table, status, scanned, total, covered, found, T0 + dt.timedelta(hours=i)))
        return frame(full, RECORD)

    return build


def test_latest_runs(record):
    passed = [(SENT, "passed")]
    records = record([("k", "readings", 1, 1, passed), ("m", "stations", 1, 1, passed), ("p", "readings", 1, 1, passed)])
    tied = records.withColumn("finished_at", F.lit("2029-07-09").cast("timestamp_ntz"))
    assert history.latest(records, "readings").first().record_id == "p"
    assert history.latest(tied, "readings").first().record_id == "p"
    assert {r.table: r.record_id for r in history.latest_per_table(tied).collect()} == {"readings": "p", "stations": "m"}
    assert history.latest(records, "pictures").count() == 0
    with pytest.raises(LookupError):
        history.find(records, "q")


def test_coverage_ranking(frame, record, revisions):
    sizes = {"maps": 900, "radar": 80_000, "floods": 12, "buoys": 7_000, "masts": 41, "kites": 640, "tides": 3_300}
    tables = frame([(t, n, 0) for t, n in sizes.items()], "table string, approx_rows bigint, accepted_rules bigint")
    rules = revisions(*[(f"{t} {i}", 1, t, SENT, "accepted", None) for t, n in (("maps", 3), ("floods", 1), ("kites", 2)) for i in range(n)])
    records = record([
        ("1", "masts", 41, 41, [(SENT, "passed"), (DRY, "failed")]),
        ("2", "kites", 600, 640, [(SENT, "passed")]),
        ("3", "tides", 3_300, 3_300, [(SENT, "errored"), (DRY, "passed")]),
    ])
    listed = history.coverage_listing(tables, rules, records).collect()
    assert [(r.table, r.bucket_no) for r in listed] == [
        ("radar", 1), ("buoys", 1), ("maps", 1), ("floods", 1), ("tides", 2), ("kites", 2), ("masts", 3),
    ]
    slots = {r.table: r.status for r in listed}
    assert slots["radar"] == "NEVER RUN · NO RULES" and slots["maps"] == "NEVER RUN"
    assert slots["kites"] == "PASSED · sampled 600 / 640" and slots["masts"] == "FAILED"
    assert {r.table: r.rows for r in listed}["radar"] == "80,000"


def test_empty_buckets_are_listed(frame, record, revisions):
    tables = frame([("maps", 5, 0)], "table string, approx_rows bigint, accepted_rules bigint")
    rules = revisions(("r", 1, "maps", SENT, "accepted", None))
    records = record([("1", "maps", 5, 5, [(SENT, "passed")])])
    listed = history.coverage_listing(tables, rules, records).collect()
    assert [(r.bucket, r.table) for r in listed] == [("never-run", None), ("unverifiable", None), ("verified", "maps")]


@pytest.fixture
def waiting(book, revisions, record):
    """The book with one more rule in use, and two runs of the readings: the later one is what counts."""
    rules = book.unionByName(revisions(("gale", 1, "readings", WIND, "accepted", None)))
    records = record([
        ("old", "readings", 1, 1, [(WIND, "failed"), (DRY, "passed")]),
        ("new", "readings", 1, 1, [(WIND, "passed"), (DRY, "failed"), (SENT, "failed")]),
        ("else", "stations", 1, 1, [(NAMED, "failed")]),
    ])
    return rules, records


def test_the_queue_holds_two_kinds_of_rules_and_nothing_else(waiting):
    queue = {r.rule_id: r for r in review.review_queue(*waiting).collect()}
    assert sorted(queue) == ["dry", "sent"]
    assert queue["dry"].failing == "FAILED" and queue["sent"].failing is None


def test_an_amended_rule_drops_the_verdict_on_its_former_self(waiting, revisions):
    rules, records = waiting
    changed = spec("column_values_to_be_between", column="rain", max_value=91.0)
    held = rules.unionByName(revisions(("dry", 4, "readings", changed, "needs_review", None)))
    queue = {r.rule_id: r for r in review.review_queue(held, records, "readings").collect()}
    assert queue["dry"].failing is None and queue["dry"].revision == 4
    back = held.unionByName(revisions(("dry", 5, "readings", changed, "accepted", None)))
    assert [r.rule_id for r in review.review_queue(back, records, "readings").collect()] == ["sent"]


def test_the_queue_is_computed_once_to_be_placed(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 500, 1, 4).rdd.map(lambda r: seen.add(1) or (f"rule-{r.id}", "readings"))
    placed = review.with_position(spark.createDataFrame(rows, "rule_id string, table string"))
    assert placed.count() == 500 and seen.value == 500


@pytest.mark.parametrize("ids", ["hexadecimal", "numbered"])
def test_positions_count_within_a_table(spark, ids):
    n = F.col("id")
    rule = F.md5(n.cast("string")) if ids == "hexadecimal" else F.concat(F.lit("rule-"), F.lpad(n.cast("string"), 5, "0"))
    hot = F.when(n % 3 > 0, F.lit("readings")).otherwise(F.concat(F.lit("t"), n % 50))
    queue = spark.range(3000).select(rule.alias("rule_id"), hot.alias("table"))
    placed = review.with_budget(review.with_position(queue)).collect()
    by_table = {}
    for r in placed:
        by_table.setdefault(r.table, []).append(r)
    for rows in by_table.values():
        ordered = sorted(rows, key=lambda r: r.rule_id)
        assert [r.position for r in ordered] == list(range(1, len(rows) + 1))
        assert {r.total for r in rows} == {len(rows)}
        assert ordered[-1].budget.endswith("the last one")


def test_the_queue_of_one_table_is_ranked_in_several_ranges(spark):
    rule = F.concat(F.lit("rule-"), F.lpad(F.col("id").cast("string"), 6, "0"))
    queue = spark.range(0, 20_000, 1, 8).select(rule.alias("rule_id"), F.lit("readings").alias("table"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or ranges this small are put together
    try:
        ranged = review.in_ranges(queue, [F.col("table").asc(), F.col("rule_id").asc()])
        assert ranged.select("_part").distinct().count() > 1
        assert review.with_position(queue).filter("position <> cast(substring(rule_id, 6) as int) + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_records_survive_being_written(waiting, spark, tmp_path):
    _, records = waiting
    path = str(tmp_path / "runs")
    store.append_records(records, path)
    store.append_records(records.withColumn("record_id", F.concat(F.lit("very "), "record_id")), path)
    read = store.read_records(spark, path)
    assert read.count() == 6 and history.find(read, "very new").first().status == "failed"
    assert json.loads(results.documents(history.find(read, "old")).first().results)[1]["verdict"] == "passed"
