"""The sentences a reader is shown, as Column expressions.

Each sentence is written in one place and travels as one string, so a verdict cannot lose
its sampling clause and a count cannot lose what it is a count of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import spec as S
from plumbline.plans.catalog import BOTH_BOUNDS, LOWER_ONLY, RULE_TYPES, UPPER_ONLY

# Wording of the rendered lines.
SEPARATOR = " · "
PENDING = "PENDING · not yet reported"
ERRORED_DETAIL = "rule could not run"
NEGLIGIBLE_SHARE = "<0.01%"
NEVER_RUN = "NEVER RUN"
NO_RULES = "NO RULES"
EMPTY_VALUE = "(empty)"
LAST_DECISION = "the last one"
OVER_BUDGET = "past the five minutes this is supposed to take"
NOTHING_SAVED = "Nothing was saved. Your coverage did not change."
MULTI_COLUMN_LIMIT = (
    "Not supported yet — this rule compares two columns, and the current rule set "
    "covers single-column and table-level checks only."
)
UNCLEAR_REQUEST = (
    "This could not be read as a check on one column or on the table as a whole. "
    "Name the column and say what would make a row wrong."
)
STATE_LABELS = {
    "proposed": "Unsaved proposal",
    "needs_review": "Held for review",
    "accepted": "In use",
    "rejected": "Rejected",
}
JUDGMENTS = (
    ("accepted", "Accept — I vouch for this"),
    ("rejected", "Reject…"),
    ("needs_review", "Ask business"),
)
DECISION_SECONDS = 20
BUDGET_MINUTES = 5


# Characters that count as blank at either end of a text.
BLANKS = " \t\n\r\x0b\x0c"


def stripped(value: Column) -> Column:
    """A text without blanks at its ends, line breaks included."""
    return F.btrim(value, F.lit(BLANKS))


def digits(count: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(count, 0)


def magnitude(unexpected: Column, scanned: Column) -> Column:
    """``42 violating rows · of 9,600 rows scanned · 0.44%``; null when nothing was counted."""
    share = F.when(
        scanned > 0, (F.lit(100) * unexpected).cast("double") / scanned.cast("double")
    ).otherwise(F.lit(0.0))
    shown = F.when(
        (share == 0) | (F.round(share, 2) != 0), F.concat(F.format_number(share, 2), F.lit("%"))
    ).otherwise(F.lit(NEGLIGIBLE_SHARE))
    line = F.concat(
        digits(unexpected), F.lit(" violating rows" + SEPARATOR + "of "),
        digits(scanned), F.lit(" rows scanned" + SEPARATOR), shown,
    )
    return F.when(unexpected.isNotNull(), line)


def status_atom(verdict: Column, scanned: Column, total: Column) -> Column:
    """``FAILED · sampled 2,500 / 80,000``: a verdict with what it saw in the same string."""
    sampled = F.concat(F.lit("sampled "), digits(scanned), F.lit(" / "), digits(total))
    return F.concat_ws(
        SEPARATOR,
        F.upper(verdict),
        F.when(verdict == "errored", F.lit(ERRORED_DETAIL)),
        F.when(scanned < total, sampled),
    )


def never_run_atom(accepted_rules: Column) -> Column:
    return F.concat_ws(
        SEPARATOR, F.lit(NEVER_RUN), F.when(accepted_rules == 0, F.lit(NO_RULES))
    )


def budget(position: Column, total: Column, table: Column) -> Column:
    """``Decision 2 of 9 for supplier · about 3 minutes left``; null outside ``1..total``."""
    left = F.ceil((total - position) * DECISION_SECONDS / 60)
    minutes = F.concat(
        F.lit("about "), left.cast("string"),
        F.when(left == 1, F.lit(" minute left")).otherwise(F.lit(" minutes left")),
        F.when(left > BUDGET_MINUTES, F.lit(f" — {OVER_BUDGET}")).otherwise(F.lit("")),
    )
    line = F.concat(
        F.lit("Decision "), position.cast("string"), F.lit(" of "), total.cast("string"),
        F.lit(" for "), table, F.lit(SEPARATOR),
        F.when(left == 0, F.lit(LAST_DECISION)).otherwise(minutes),
    )
    return F.when((position >= 1) & (position <= total), line)


def evidence_row(ids: list[Column], value: Column) -> Column:
    """``#77 12.5``: an offending value after the key of its row."""
    shown = F.coalesce(value.cast("string"), F.lit(EMPTY_VALUE))
    keys = [F.concat(F.lit("#"), F.coalesce(c.cast("string"), F.lit(EMPTY_VALUE))) for c in ids]
    return F.trim(F.concat_ws(" ", *keys, shown))


def evidence_line(
    total: Column, non_null: Column, distinct: Column, low: Column, high: Column, values: Column
) -> Column:
    """The numbers behind a rule; a rule on no column, or an unknown one, has the row count only."""
    count = digits(distinct)
    return F.concat_ws(
        SEPARATOR,
        F.concat(digits(total), F.lit(" rows scanned")),
        F.concat(digits(total - non_null), F.lit(" nulls")),
        F.when(
            values.isNotNull(),
            F.concat(count, F.lit(" distinct: "), F.array_join(values, ", ")),
        ).otherwise(F.concat(count, F.lit(" distinct"))),
        F.when(values.isNull(), F.concat(F.lit("min observed "), low)),
        F.when(values.isNull(), F.concat(F.lit("max observed "), high)),
    )


def _scalar(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    plain = F.when(S.is_number(value), F.regexp_replace(F.to_json(value), r"\.0$", ""))
    return (
        plain.when(kind == "BOOLEAN", F.initcap(S.text(value)))
        .when(kind == "VOID", F.lit("None"))
        .otherwise(S.text(value))
    )


def readable(value: Column) -> Column:
    """A parameter as a person reads it: ``0.0`` is 0, a list is its members with commas."""
    members = F.array_join(F.transform(S.elements(value), _scalar), ", ")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), members).otherwise(_scalar(value))


def _template(type_name: Column) -> Column:
    """The sentence of a type, taken from one constant map."""
    sentences = F.create_map(*[F.lit(x) for e in RULE_TYPES for x in (e.name, e.sentence)])
    return F.try_element_at(sentences, type_name)


def statement(type_name: Column, params: Column) -> Column:
    """A rule as the sentence its author confirms; null for a type outside the catalog.

    The template is cut at its braces, so every second piece is the name of a parameter.
    """
    one_sided = (
        F.when(S.argument(params, "max_value").isNull(), F.lit(LOWER_ONLY))
        .when(S.argument(params, "min_value").isNull(), F.lit(UPPER_ONLY))
        .otherwise(F.lit(BOTH_BOUNDS))
    )
    pieces = F.split(F.replace(_template(type_name), F.lit(BOTH_BOUNDS), one_sided), "[{}]")
    sentence = F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(
                i % 2 == 1, F.coalesce(readable(S.argument(params, piece)), F.lit("None"))
            ).otherwise(piece),
        ),
        "",
    )
    mostly = S.number(S.argument(params, "mostly"))
    tolerance = F.concat(
        F.lit(", in at least "), F.format_number(mostly * 100, 0), F.lit("% of rows")
    )
    return F.concat(sentence, F.when(mostly < 1, tolerance).otherwise(F.lit("")))


def with_sentence(rules: DataFrame) -> DataFrame:
    """Rules (``spec``) with ``type``, ``column``, ``spec_key`` and ``statement``.

    The spec is parsed into columns first, so that no expression parses it again.
    """
    parsed = S.with_parsed(rules)
    kind, params = F.col("type"), F.col("__kwargs")
    return parsed.withColumns(
        {
            "column": S.text(S.argument(params, "column")),
            "spec_key": S.identity(F.col("spec"), kind, params),
            "statement": statement(kind, params),
        }
    ).drop("__kwargs")


def refusal(explanation: Column) -> Column:
    """What could not be done, then what did not happen."""
    return F.concat(explanation, F.lit(" " + NOTHING_SAVED))


def state_label(status: Column) -> Column:
    return reduce(
        lambda chain, pair: chain.when(status == pair[0], F.lit(pair[1])),
        STATE_LABELS.items(),
        F.when(F.lit(False), F.lit("")),
    )
