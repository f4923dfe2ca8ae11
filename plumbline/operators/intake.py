"""Model replies, a table of them at a time: into proposals, or into drafts and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import spec as S
from plumbline.functions import text
from plumbline.operators.lint import lint
from plumbline.operators.profile import with_evidence_line

# The reasons a request can be refused for.
MULTI_COLUMN, UNCLEAR, INVALID = "multi_column", "unclear", "invalid"
PROPOSED = "proposed"

NO_RULES = "there are no rules in this reply"
NOT_A_RULE = "a rule is an object with a type"
PAST_LIMIT = "this rule comes after the number of rules asked for"


def proposals(
    replies: DataFrame, schema: DataFrame, profiled: DataFrame, limit: int | None = None
) -> DataFrame:
    """The rules of each reply, or the reason the reply was refused.

    ``replies`` has ``reply_id``, ``table`` and ``reply`` (JSON text). A reply without rules is
    refused, and one bad rule refuses its whole reply: such replies come out as one row with
    ``refusal`` set. With ``limit``, the rules after the first so many are not judged; each comes
    out as a row whose ``refusal`` says so.
    """
    found = F.try_variant_get(F.try_parse_json("reply"), "$.rules", "array<variant>")
    read = replies.select("reply_id", "table", found.alias("rules"))
    empty = read.filter(F.coalesce(F.size("rules"), F.lit(0)) <= 0)
    rules = read.select("reply_id", "table", F.posexplode("rules").alias("position", "rule")).withColumn(
        "spec", F.to_json("rule")
    )
    asked = F.lit(True) if limit is None else F.col("position") < limit
    past = rules.filter(~asked).select("reply_id", "table", "position", "spec", F.lit(PAST_LIMIT).alias("refusal"))
    typed = rules.filter(asked).withColumn("well_formed", S.rule_type("spec").isNotNull())
    judged = lint(typed, schema, ["reply_id", "position"]).withColumn(
        "fault", F.when(~F.col("well_formed"), F.lit(NOT_A_RULE)).otherwise(F.col("reason"))
    )
    batch = Window.partitionBy("reply_id")
    checked = judged.withColumn(
        "batch_fault", F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).over(batch)
    )
    refused = (
        checked.filter(F.col("batch_fault").isNotNull() & (F.col("position") == 0))
        .select("reply_id", "table", F.col("batch_fault").alias("refusal"))
        .unionByName(empty.select("reply_id", "table", F.lit(NO_RULES).alias("refusal")))
    )
    kept = text.with_sentence(
        checked.filter(F.col("batch_fault").isNull()).select("reply_id", "table", "position", "spec")
    ).withColumn("status", F.lit(PROPOSED))
    dressed = with_evidence(kept, profiled)
    others = refused.unionByName(past, allowMissingColumns=True)
    return dressed.unionByName(others, allowMissingColumns=True).select(
        "reply_id", "table", "position", "type", "column", "spec", "statement", "evidence",
        "status", "refusal",
    )


def with_evidence(rules: DataFrame, profiled: DataFrame) -> DataFrame:
    """Rules (``table``, ``column``) with the profile's line on their column.

    A rule on no column, or on one the profile lacks, gets its table's row count alone.
    """
    lines = with_evidence_line(profiled).select("table", "column", F.col("evidence").alias("__line"))
    sizes = profiled.groupBy("table").agg(
        F.concat(text.digits(F.max("total_rows")), F.lit(" rows scanned")).alias("__size")
    )
    # a table with a large share of the rules is split at run time, on their side
    joined = rules.join(lines, ["table", "column"], "left").join(sizes, ["table"], "left")
    return joined.withColumn("evidence", F.coalesce("__line", "__size")).drop("__line", "__size")


def classify(replies: DataFrame, schema: DataFrame) -> DataFrame:
    """Each authoring reply as a draft, or as a refusal that says nothing was saved.

    ``replies`` has ``reply_id``, ``table`` and ``reply``. A reply that names no known reason
    and holds no usable check is ``unclear``; a check that fails lint is ``invalid``.
    """
    reply = F.try_parse_json("reply")
    read = replies.withColumns(
        {
            "__cannot": F.try_variant_get(reply, "$.cannot", "variant"),
            "__check": F.try_variant_get(reply, "$.check", "variant"),
            "__why": F.try_variant_get(reply, "$.why", "variant"),
        }
    ).withColumn("spec", F.to_json("__check"))
    declined = F.col("__cannot").isNotNull() & ~F.is_variant_null("__cannot")
    usable = (
        F.col("__check").isNotNull() & S.rule_type("spec").isNotNull() & S.has_object_kwargs("spec")
    )
    sorted_out = read.withColumns(
        {
            "__usable": ~declined & F.coalesce(usable, F.lit(False)),
            "__code": F.when(
                (F.schema_of_variant("__cannot") == "STRING")
                & S.text(F.col("__cannot")).isin(MULTI_COLUMN, UNCLEAR),
                S.text(F.col("__cannot")),
            ).otherwise(F.lit(UNCLEAR)),
            "__said": F.when(
                F.schema_of_variant("__why") == "STRING", text.stripped(S.text(F.col("__why")))
            ),
        }
    )
    judged = lint(sorted_out, schema, ["reply_id"])
    drafted = F.col("__usable") & F.col("ok")
    reason = F.when(drafted, F.lit(None)).when(F.col("__usable"), INVALID).otherwise(F.col("__code"))
    explanation = (
        F.when(F.col("__usable"), F.col("fault"))
        .when(F.col("__code") == MULTI_COLUMN, F.lit(text.MULTI_COLUMN_LIMIT))
        .otherwise(F.lit(text.UNCLEAR_REQUEST))
    )
    said = F.when(~F.col("__usable") & (F.length("__said") > 0), F.col("__said"))
    told = text.with_sentence(judged.withColumnRenamed("reason", "fault"))
    return told.select(
        "reply_id",
        "table",
        F.when(drafted, "draft").otherwise("refused").alias("outcome"),
        reason.alias("reason"),
        F.when(drafted, F.col("spec")).alias("spec"),
        F.when(drafted, F.col("statement")).alias("statement"),
        F.when(~drafted, text.refusal(explanation)).alias("message"),
        said.alias("detail"),
    )
