"""Source mixing by entropy balancing (operator 8), in DataFrame operations only.

Each document gets a rate ``exp(tilt * size / scale)``, held to ``most``, whose tilt is one number
per source: the rates nearest to 1 in relative entropy whose tokens meet the source's target.
Tilts are found by Newton steps on the convex dual, each one aggregate over (source, size) counts.
Rates become whole copies by rounding the running total of rates, largest documents first, and
the words still missing or too many are then moved to the smaller documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, checkpointed, in_ranges, text_or_empty, tie_break, totals_before, unused, written

#: Weights of the sources in code-point order, repeating; fixed by the task.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Steps go on until the words taken of each source are within this share of its target.
NEAR = 1e-6
#: Rates are added up in whole parts of this size, so running totals are exact.
PARTS = 1 << 20
#: Up to so many sources, a table with one row per source is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A rate's exponent is kept within this, so rates stay positive and finite.
STEEPEST = 30.0


def _by_source(table: DataFrame, count: int) -> DataFrame:
    return F.broadcast(table) if count <= BROADCAST_SOURCES else table


def _running(df: DataFrame, value: Column, order: Sequence[Column], name: str) -> DataFrame:
    """The sum of ``value`` up to each row of an ``in_ranges`` frame, within its source."""
    parts = df.groupBy("_part", "_rank").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    here = Window.partitionBy("_part", "_rank").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_here", F.sum(value).over(here)).join(parts, ["_part", "_rank"])
    return summed.withColumn(name, F.col("_before") + F.col("_here")).drop("_before", "_here")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Every source with its tokens and its place in code-point order, null last (from 0)."""
    totals = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    order = [F.col("_source").asc_nulls_last()]
    rows = in_ranges(totals, order)
    parts = totals_before(rows, {"n": F.lit(1)})
    starts = rows.sparkSession.createDataFrame([(p["_part"], p["before_n"]) for p in parts], "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    rows = rows.withColumn("_place", place).join(F.broadcast(starts), "_part")  # a row per partition
    return rows.select("_source", "source_size", (F.col("_start") + F.col("_place")).alias("_rank"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> tuple[DataFrame, int]:
    """Sources with their ``target``, and how many there are: shares by weight, held to ``most`` times the source's tokens.

    What a held source leaves over goes to the others by weight, until none is above its bound.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = checkpointed(sources.withColumn("_weight", weight).withColumn("_bound", F.col("source_size") * float(most)))
    level, held = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_bound") <= F.col("_weight") * F.lit(level)
        free = F.when(~full, F.col("_weight"))
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("_bound"))).alias("kept"),
            F.sum(free).alias("weight"), F.count_if(full).alias("held"), F.count(F.lit(1)).alias("n"),
        ).first()
        if row["held"] == held or not row["weight"]:
            break
        held, level = row["held"], (row["all"] - (row["kept"] or 0.0)) / row["weight"]
    return sources.withColumn("target", F.least(F.col("_bound"), F.col("_weight") * F.lit(float(level or 0)))), row["n"]


def _exact(value: Column) -> Column:
    """A sum in whole parts, which no order of adding up changes."""
    return F.sum(F.round(value * PARTS).cast("decimal(38,0)")).cast("double") / PARTS


def tilts(counts: DataFrame, sources: DataFrame, n_sources: int, most: float = MOST) -> DataFrame:
    """Sources with the ``_tilt`` of their rates, by Newton steps on the dual of the balancing problem.

    A step is one aggregate over the ``counts`` of (_rank, size). A bracket per source keeps every
    step inside what earlier steps have ruled out; where Newton leaves it, it is halved, or reaches
    twice as far while it is open on that side. Steps end when every source is near its target or
    its tilt no longer moves. Held sources need no tilt.
    """
    counts = counts.where("size > 0")
    words = F.col("_n") * F.col("size")
    scale = counts.groupBy("_rank").agg((F.sum(words * F.col("size")) / F.sum(words)).alias("_scale"))
    state = checkpointed(
        sources.join(scale, "_rank", "left").select(
            *sources.columns, F.coalesce("_scale", F.lit(1.0)).alias("_scale"), F.lit(0.0).alias("_tilt"),
            F.lit(float("-inf")).alias("_low"), F.lit(float("inf")).alias("_high"),
        )
    )
    x = F.col("size") / F.col("_scale")
    rate = F.exp(F.least(F.lit(STEEPEST), F.col("_tilt") * x))
    while True:
        found = (
            counts.join(_by_source(state.select("_rank", "_tilt", "_scale"), n_sources), "_rank")
            .groupBy("_rank")
            .agg(
                _exact(words * F.least(F.lit(float(most)), rate)).alias("_taken"),
                _exact(F.when(rate < most, words * x * rate).otherwise(0.0)).alias("_slope"),
            )
        )
        taken = F.coalesce("_taken", F.lit(0.0))
        less = taken < F.col("target")
        state = state.join(_by_source(found, n_sources), "_rank", "left").withColumns({
            "_low": F.when(less, F.greatest("_low", "_tilt")).otherwise(F.col("_low")),
            "_high": F.when(less, F.col("_high")).otherwise(F.least("_high", "_tilt")),
        })
        newton = F.col("_tilt") + (F.col("target") - taken) / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = (newton > F.col("_low")) & (newton < F.col("_high"))
        step = (
            F.when(inside, newton)
            .when(F.col("_low") == float("-inf"), 2 * F.col("_high") - STEEPEST)
            .when(F.col("_high") == float("inf"), 2 * F.col("_low") + STEEPEST)
            .otherwise((F.col("_low") + F.col("_high")) / 2)
        )
        far = (F.abs(F.col("target") - taken) > NEAR * F.col("target")) & (F.col("target") < F.col("_bound"))
        state = state.withColumn("_step", F.when(far, step).otherwise(F.col("_tilt")))
        state = checkpointed(state.withColumn("_moved", F.col("_step") != F.col("_tilt")).drop("_taken", "_slope"))
        moved = state.where("_moved").take(1)
        state = state.withColumn("_tilt", F.col("_step")).drop("_step", "_moved")
        if not moved:
            break
    return state


def mixed(
    df: DataFrame, text: str = "text", source: str = "source", order: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, most: int = MOST, keep: Sequence[str] | None = None, corrections: int = 3,
) -> DataFrame:
    """Each row with ``size`` (words), ``source_size``, ``target``, ``rate`` and ``copies`` (0 to ``most``).

    Null texts and texts without words have size 0 and one copy. A null source is a source, after
    all others. Rows that tie on size and id come by a hash of all columns, so reruns agree, and
    repeated rows are rows of their own. No rows give no rows. ``keep`` names the columns to carry
    along (all without it, by a join on a row number); columns named like an output are replaced.
    A source's copies miss its target by about the size of its smallest documents.
    """
    outputs = ("size", "source_size", "target", "rate", "copies")
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in outputs]
    tie = tie_break(df)
    row = None
    if keep is None:
        row = unused(df, "_row")
        df = written(df.withColumn(row, F.monotonically_increasing_id()), compression="zstd")
        keep = [row]
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    narrow = df.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
        F.col(f"`{order}`").alias("_order"), F.col(f"`{source}`").cast("string").alias("_source"),
        size.alias("size"), tie.alias("_tie"),
    )
    narrow = written(narrow)
    sizes = checkpointed(narrow.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_n")))
    found = ranked_sources(sizes.select("_source", (F.col("size") * F.col("_n")).alias("size")))
    sources, n_sources = targets(found, weights, most)
    named = _by_source(sources.select("_rank", F.col("_source").alias("_named")), n_sources)
    ranked = sizes.join(named, F.expr("_source <=> _named")).select("_rank", "size", "_n")
    state = tilts(checkpointed(ranked), sources, n_sources, most)

    held = F.col("target") >= F.col("_bound")
    tilted = F.least(F.lit(float(most)), F.exp(F.least(F.lit(STEEPEST), F.col("_tilt") * F.col("size") / F.col("_scale"))))
    rate = F.when(F.col("size") == 0, 1.0).when(held, float(most)).otherwise(tilted)
    named = _by_source(state.withColumnRenamed("_source", "_named"), n_sources)
    rows = narrow.join(named, F.expr("_source <=> _named")).select(
        *[f"_k{i}" for i in range(len(keep))], "_order", "_tie", "_rank", "size", "source_size", "target", rate.alias("rate"),
    )
    largest = [F.col("size").desc(), F.col("_order").asc_nulls_first(), F.col("_tie").asc(), *[F.col(f"_k{i}") for i in range(len(keep))]]
    rows = in_ranges(rows, [F.col("_rank").asc(), *largest])

    parts = F.round(F.col("rate") * PARTS).cast("long")
    rows = _running(rows, parts, largest, "_sum")
    whole = lambda c: F.floor((c + PARTS // 2) / PARTS).cast("int")  # noqa: E731  exact: totals stay under 2**53
    rows = rows.withColumn("copies", whole(F.col("_sum")) - whole(F.col("_sum") - parts)).drop("_sum")
    for _ in range(corrections):
        rows = checkpointed(rows)
        missing = rows.groupBy("_rank").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_missing"))
        rows = rows.join(_by_source(missing, n_sources), "_rank")
        more = F.col("_missing") > 0
        free = (F.col("size") > 0) & F.when(more, F.col("copies") < most).otherwise(F.col("copies") > 0)
        room = F.when(free, F.col("size")).otherwise(0)
        whole_room = rows.groupBy("_rank").agg(F.sum(room).alias("_room"))
        rows = _running(rows, room, largest, "_upto").join(_by_source(whole_room, n_sources), "_rank")
        # the smallest documents come last: what this one and all smaller ones could add or give up
        smaller = F.col("_room") - F.col("_upto") + room / 2
        step = F.when(free & (smaller < F.abs("_missing")), F.when(more, 1).otherwise(-1)).otherwise(0)
        rows = rows.withColumn("copies", F.col("copies") + step).drop("_missing", "_upto", "_room")
    result = [F.col(c) for c in outputs]
    if row is not None:
        copies = rows.select("_k0", *outputs).withColumnRenamed("_k0", row)
        return df.drop(*[c for c in df.columns if c.lower() in outputs]).join(copies, row).select(*[F.col(f"`{c}`") for c in carried], *result)
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *result)


def repeated(mix: DataFrame, copies: str = "copies") -> DataFrame:
    """The rows as often as their copies say."""
    copy = unused(mix, "_copy")
    return mix.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).drop(copy)
