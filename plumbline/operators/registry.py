"""The rule registry: an append-only table of revisions, and what it means.

Columns: ``rule_id, revision, table, spec, status, reason, written_at``. A rule is its newest
revision. Changing a rule appends a revision; nothing here rewrites one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import spec as S
from plumbline.functions import text
from plumbline.operators.intake import with_evidence
from plumbline.operators.lint import lint
from plumbline.operators.ranges import written
from plumbline.plans.catalog import catalog

# The four states of a rule.
PROPOSED, NEEDS_REVIEW, ACCEPTED, REJECTED = "proposed", "needs_review", "accepted", "rejected"
STATES = (PROPOSED, NEEDS_REVIEW, ACCEPTED, REJECTED)

UNKNOWN_RULE = "there is no rule with this id"
NO_ORDER = "there is more than one of these for this rule, and no order was given"

REVISION_SCHEMA = (
    "rule_id string, revision int, table string, spec string, status string, "
    "reason string, written_at timestamp"
)
REVISION_COLUMNS = ("rule_id", "revision", "table", "spec", "status", "reason", "written_at")


def revisions(
    rules: DataFrame, table: str | None = None, rule_id: str | None = None
) -> DataFrame:
    """Every revision, or those of one table or one rule, oldest first within each rule."""
    if table is not None:
        rules = rules.filter(F.col("table") == table)
    if rule_id is not None:
        rules = rules.filter(F.col("rule_id") == rule_id)
    return rules.orderBy("table", "rule_id", "revision")


def current(rules: DataFrame) -> DataFrame:
    """The newest revision of each rule.

    Only rows with the highest number of their rule are sorted. Those numbers are counted first, from
    two columns; a number's rows are found by a hash of 64 bits, behind which the ranking is exact.
    """
    last = [F.desc(c) for c in ("revision", "written_at", "spec", "status") if c in rules.columns]
    nth = F.row_number().over(Window.partitionBy("rule_id").orderBy(*last))
    if "revision" in rules.columns:
        highest = rules.groupBy("rule_id").agg(F.max("revision").alias("revision"))
        marks = highest.select(F.xxhash64("rule_id", "revision").alias("__mark")).hint("shuffle_hash")
        marked = rules.withColumn("__mark", F.xxhash64("rule_id", "revision"))
        rules = marked.join(marks, "__mark", "left_semi").drop("__mark")
    # each task passes on one row per rule
    return rules.withColumn("__nth", nth).filter(F.col("__nth") <= 1).drop("__nth")


def accepted(rules: DataFrame) -> DataFrame:
    """What runs, and what counts as coverage: current and accepted."""
    return current(rules).filter(F.col("status") == ACCEPTED)


def executable(rules: DataFrame) -> DataFrame:
    """The specs a run submits: ``table, rule_id, spec, spec_key`` of the accepted rules."""
    return S.with_spec_key(accepted(rules).select("table", "rule_id", "spec"))


def judgment_fault(status: Column, reason: Column) -> Column:
    """Why a judgment cannot be stored, or null."""
    blank = F.coalesce(F.length(text.stripped(reason)) == 0, F.lit(True))
    return F.when(
        ~F.coalesce(status.isin(*STATES), F.lit(False)),
        F.concat(F.coalesce(status, F.lit("nothing")), F.lit(" is no state of a rule")),
    ).when((status == REJECTED) & blank, F.lit("a rejection needs a reason"))


def invalid_revisions(rules: DataFrame) -> DataFrame:
    """Revisions that break an invariant of the table, each with the first fault."""
    parsed = F.try_variant_get(F.try_parse_json("spec"), "$", "map<string,variant>")
    keys = F.array_sort(F.map_keys(parsed))
    shape = F.coalesce(F.array_join(keys, ",") == "kwargs,type", F.lit(False))
    fault = F.coalesce(
        judgment_fault(F.col("status"), F.col("reason")),
        F.when(~shape, F.lit("a spec is exactly type and kwargs")),
        F.when(~F.coalesce(F.col("revision") >= 1, F.lit(False)), F.lit("revisions start at 1")),
    )
    return rules.withColumn("fault", fault).filter(F.col("fault").isNotNull())


def revision_conflicts(rules: DataFrame) -> DataFrame:
    """Revision numbers written more than once for one rule."""
    return (
        rules.groupBy("rule_id", "revision")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


# --- writing -------------------------------------------------------------------------


def rule_id_of(batch: Column, candidate: Column) -> Column:
    """A rule id that a retried task computes again, in the form of a UUID."""
    digest = F.md5(F.concat_ws("|", batch, candidate).cast("binary"))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
        F.substring(digest, 17, 4), F.substring(digest, 21, 12),
    )


def _as_revisions(df: DataFrame, at: Column | None) -> DataFrame:
    stamped = df.withColumn("written_at", F.current_timestamp() if at is None else at)
    return stamped.select(
        "rule_id", F.col("revision").cast("int").alias("revision"), "table", "spec", "status",
        F.col("reason").cast("string").alias("reason"), "written_at",
    )


def propose(
    candidates: DataFrame, schema: DataFrame, batch: str, at: Column | None = None
) -> DataFrame:
    """Revision 1, always ``proposed``, of every candidate that passes lint.

    ``candidates`` has ``candidate_id``, ``table`` and ``spec``; ``batch`` and the candidate id
    make the rule id. ``refused`` returns the others.
    """
    judged = lint(candidates, schema, ["candidate_id"])
    return _as_revisions(_fresh(judged, batch), at)


def _fresh(judged: DataFrame, batch: str) -> DataFrame:
    return judged.filter("ok").withColumns(
        {
            "rule_id": rule_id_of(F.lit(batch), F.col("candidate_id").cast("string")),
            "revision": F.lit(1),
            "status": F.lit(PROPOSED),
            "reason": F.lit(None).cast("string"),
        }
    )


def refused(candidates: DataFrame, schema: DataFrame) -> DataFrame:
    """The candidates ``propose`` leaves out, each with the reason."""
    return lint(candidates, schema, ["candidate_id"]).filter("not ok")


def _numbered(acts: DataFrame, order: Sequence[Column | str] | None) -> DataFrame:
    """Acts on rules with ``__step``, their number among those on one rule.

    Without an order, ``__step`` is null where a rule has more than one.
    """
    same = Window.partitionBy("rule_id")
    if order is not None:
        return acts.withColumn("__step", F.row_number().over(same.orderBy(*order)))
    several = acts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("__acts"))
    counted = acts.join(several, "rule_id")
    return counted.withColumn("__step", F.when(F.col("__acts") == 1, F.lit(1))).drop("__acts")


def judged_edits(
    rules: DataFrame, edits: DataFrame, schema: DataFrame, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """Every edit with the rule it is on, its number, and the ``fault`` against it, or null.

    Edits are judged once and kept in the shared folder, as they are then read to be numbered. Who wants
    both what ``amend`` writes and what ``refused_edits`` leaves out gives this to either.
    """
    newest = current(rules).select("rule_id", "revision", "table")
    joined = edits.join(newest, "rule_id", "left")
    linted = lint(joined, schema, ["rule_id"])
    fault = F.when(F.col("revision").isNull(), F.lit(UNKNOWN_RULE)).when(~F.col("ok"), F.col("reason"))
    judged = written(linted.withColumn("__fault", fault).drop("ok", "reason"))
    sound = _numbered(judged.filter(F.col("__fault").isNull()), order)
    sound = sound.withColumn("__fault", F.when(F.col("__step").isNull(), F.lit(NO_ORDER)))
    return sound.unionByName(judged.filter(F.col("__fault").isNotNull()), allowMissingColumns=True)


def amend(
    rules: DataFrame,
    edits: DataFrame,
    schema: DataFrame,
    at: Column | None = None,
    order: Sequence[Column | str] | None = None,
    judged: DataFrame | None = None,
) -> DataFrame:
    """The next revision of each edited rule (``rule_id, spec``), always held for review.

    Several edits of one rule follow each other by ``order``. Edits that cannot be written are left
    out; ``refused_edits`` returns them. ``judged`` is what ``judged_edits`` told of the same edits, if
    that is known.
    """
    judged = judged_edits(rules, edits, schema, order) if judged is None else judged
    sound = judged.filter(F.col("__fault").isNull())
    return _as_revisions(_next(sound, F.lit(NEEDS_REVIEW), F.lit(None)), at)


def refused_edits(
    rules: DataFrame, edits: DataFrame, schema: DataFrame, order: Sequence[Column | str] | None = None,
    judged: DataFrame | None = None,
) -> DataFrame:
    """The edits ``amend`` leaves out, each with the ``fault``: together they are all edits."""
    judged = judged_edits(rules, edits, schema, order) if judged is None else judged
    return judged.filter(F.col("__fault").isNotNull()).select(*edits.columns, F.col("__fault").alias("fault"))


def judge(
    rules: DataFrame,
    decisions: DataFrame,
    at: Column | None = None,
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """The next revision of each judged rule (``rule_id, status, reason``), its spec unchanged.

    Several decisions on one rule follow each other by ``order``. Decisions that could not be
    stored are left out; ``refused_judgments`` returns them.
    """
    storable = decisions.filter(judgment_fault(F.col("status"), F.col("reason")).isNull())
    numbered = _numbered(storable, order).filter(F.col("__step").isNotNull())
    newest = current(rules).select("rule_id", "revision", "table", "spec")
    joined = newest.join(numbered.select("rule_id", "status", "reason", "__step"), "rule_id")
    return _as_revisions(_next(joined, F.col("status"), F.col("reason")), at)


def _next(df: DataFrame, status: Column, reason: Column) -> DataFrame:
    return df.withColumns(
        {"revision": F.col("revision") + F.col("__step"), "status": status, "reason": reason.cast("string")}
    )


def refused_judgments(
    rules: DataFrame, decisions: DataFrame, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """Decisions on no known rule, that break the rules of judging, or that have no order."""
    known = rules.select("rule_id").distinct().withColumn("__known", F.lit(True))
    marked = decisions.withColumn("__fault", judgment_fault(F.col("status"), F.col("reason")))
    sound = _numbered(marked.filter(F.col("__fault").isNull()), order)
    marked = sound.unionByName(marked.filter(F.col("__fault").isNotNull()), allowMissingColumns=True)
    fault = F.coalesce(
        F.col("__fault"),
        F.when(F.col("__known").isNull(), F.lit(UNKNOWN_RULE)),
        F.when(F.col("__step").isNull(), F.lit(NO_ORDER)),
    )
    joined = marked.join(known, "rule_id", "left").withColumn("fault", fault)
    return joined.filter(F.col("fault").isNotNull()).select(*decisions.columns, "fault")


def judge_batch(
    rules: DataFrame,
    candidates: DataFrame,
    rule_ids: DataFrame,
    status: str,
    reason: str | None,
    schema: DataFrame,
    batch: str,
    cap: int | None = None,
    at: Column | None = None,
) -> DataFrame:
    """One decision over unsaved candidates and stored rules together, as revisions to append.

    Candidates are proposed first and then judged, so both steps are in the history. Nothing
    is returned for writing unless the whole selection can be judged, which one job finds out:
    a single row of counts and first faults. ``cap`` refuses a larger selection. What was selected
    is found once and kept in the shared folder.
    """
    judged = written(lint(candidates, schema, ["candidate_id"]).select("candidate_id", "table", "spec", "ok", "reason"))
    newest = current(rules).select("rule_id", "revision", "table", "spec", F.lit(True).alias("__known"))
    chosen = written(rule_ids.select("rule_id").distinct().join(newest, "rule_id", "left"))
    unknown = F.when(F.col("__known").isNull(), F.concat("rule_id", F.lit(f": {UNKNOWN_RULE}")))
    nothing = F.lit(None).cast("string")
    selection = judged.select(F.when(~F.col("ok"), F.col("reason")).alias("bad"), nothing.alias("unknown")).unionByName(
        chosen.select(nothing.alias("bad"), unknown.alias("unknown"))
    )
    act = judgment_fault(F.lit(status), F.lit(reason).cast("string"))
    row = selection.agg(F.count(F.lit(1)).alias("n"), F.min("bad").alias("bad"), F.min("unknown").alias("unknown"), F.min(act).alias("act")).first()
    if not row.n:
        raise ValueError("nothing was selected to be judged")
    if cap is not None and row.n > cap:
        raise ValueError(f"{row.n} rules were selected, and {cap} may be judged at once")
    if row.act is not None or row.bad is not None:
        raise ValueError(row.act or row.bad)
    if row.unknown is not None:
        raise LookupError(row.unknown)
    both = F.array(
        F.struct(F.lit(1).alias("revision"), F.lit(PROPOSED).alias("status"), nothing.alias("reason")),
        F.struct(F.lit(2).alias("revision"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason")),
    )
    fresh = _fresh(judged, batch).select("rule_id", "table", "spec", F.inline(both))
    # a rule is chosen once, so its decision is the first
    held = chosen.filter("__known").withColumn("__step", F.lit(1))
    return _as_revisions(fresh, at).unionByName(_as_revisions(_next(held, F.lit(status), F.lit(reason)), at))


# --- reading -------------------------------------------------------------------------


def rule_counts(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """The table listing with accepted rules counted; a table without rules says zero."""
    counted = accepted(rules).groupBy("table").agg(F.count(F.lit(1)).alias("__n"))
    joined = tables.drop("accepted_rules").join(counted, "table", "left")
    return joined.withColumn("accepted_rules", F.coalesce("__n", F.lit(0)).cast("bigint")).drop("__n")


def new_proposals(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """The proposals (``table, spec``) whose table does not already hold the same rule."""
    held = S.with_spec_key(current(rules)).select("table", "spec_key").distinct()
    keyed = S.with_spec_key(proposals)
    return keyed.join(held, ["table", "spec_key"], "left_anti")


def catalog_usage(rules: DataFrame, table: str | None = None) -> DataFrame:
    """Every rule type, marked when a current rule (of one table) is of that type."""
    newest = current(rules if table is None else rules.filter(F.col("table") == table))
    used = S.with_parsed(newest).select("type").distinct().withColumn("__used", F.lit(True))
    return (
        catalog(rules.sparkSession)
        .join(used, "type", "left")
        .select("position", "type", "sentence", F.coalesce("__used", F.lit(False)).alias("in_use"))
    )


def described(rules: DataFrame) -> DataFrame:
    """Rules with their sentence, column and the label of their state."""
    return text.with_sentence(rules).withColumn("state_label", text.state_label(F.col("status")))


def workbench(rules: DataFrame, profiled: DataFrame, table: str | None = None) -> DataFrame:
    """The current rules with sentence and evidence, by state and then by id.

    ``bulk`` marks what may be accepted in bulk, ``held`` what waits for one person.
    """
    newest = current(rules if table is None else rules.filter(F.col("table") == table))
    dressed = with_evidence(described(newest), profiled)
    return (
        dressed.withColumns(
            {"bulk": F.col("status") == PROPOSED, "held": F.col("status") == NEEDS_REVIEW}
        )
        .select(
            "rule_id", "revision", "table", "column", "status", "state_label", "statement",
            "evidence", "reason", "bulk", "held",
        )
        .orderBy("status", "rule_id")
    )


def open_judgments(rules: DataFrame) -> DataFrame:
    """Each rule with the judgments open to it: all but the state it is in."""
    choices = F.array(
        *[
            F.struct(
                F.lit(state).alias("target"),
                F.lit(label).alias("label"),
                F.lit(state == ACCEPTED).alias("primary"),
            )
            for state, label in text.JUDGMENTS
        ]
    )
    exploded = rules.select("rule_id", "status", F.explode(choices).alias("j"))
    return exploded.select("rule_id", "status", "j.target", "j.label", "j.primary").filter(
        F.col("target") != F.col("status")
    )
