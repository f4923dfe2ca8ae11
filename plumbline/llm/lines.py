"""Line dedup by a suffix array over line ids (operator 9), in DataFrame operations only.

A line's id is the first place in the corpus that has the line. Prefix doubling names each run of
2, 4, 8, ... lines by the first place that has the run, from the names of its two halves; places
whose run occurs once drop out, so a round works on what still repeats, and the rounds are as many
as the longest repeat has binary digits. Places with one name at the depth of the shortest run are
a longest-common-prefix interval; its later members are deleted, and their union are the maximal
repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, checkpointed, in_ranges, text_or_empty, totals_before, unused, written

#: Lines in the shortest run that is deleted.
LINES = 2
#: Words of a line that goes alone, for callers that ask for it.
ALONE = 20
#: Places: a document's number times this, and the line.
STRIDE = 1 << 28


def _named(places: DataFrame, *keys: str) -> DataFrame:
    """Places whose keys occur more than once, each with the first place of its keys as ``name``."""
    names = places.groupBy(*keys).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("often")).where("often > 1")
    return checkpointed(places.join(names, list(keys)).select("place", F.col("first").alias("name")))


def _ahead(named: DataFrame, lines: int) -> DataFrame:
    """Places of which the place some lines on is there too, with the name of that one as ``then``."""
    later = named.select((F.col("place") - lines).alias("place"), F.col("name").alias("then"))
    return named.join(later, "place").select("place", "name", "then")


def repeated_runs(lines: DataFrame, shortest: int = LINES, named: DataFrame | None = None) -> DataFrame:
    """(place, first, longest) of later copies of runs of ``shortest`` lines, from (place, line_a, line_b).

    ``first`` is the first place that has the run and ``longest`` the longest power of two of lines
    with which an earlier place begins alike (at least 1). ``named`` has the names of lines, if known.
    """
    level, length = named or _named(lines, "line_a", "line_b"), 1
    runs = level if shortest == 1 else None
    longest = level.where("name < place").select("place", F.lit(1).alias("lines"))
    while level.take(1):
        if length < shortest <= 2 * length:
            runs = _named(_ahead(level, shortest - length), "name", "then")
        level = _named(_ahead(level, length), "name", "then")
        length *= 2
        longest = longest.union(level.where("name < place").select("place", F.lit(length).alias("lines")))
    if runs is None:
        runs = level
    longest = longest.groupBy("place").agg(F.max("lines").alias("longest"))
    return runs.where("name < place").join(longest, "place").select("place", F.col("name").alias("first"), "longest")


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = LINES, alone: int | None = None) -> DataFrame:
    """Each row with ``n_lines``, the deleted ``spans`` of lines and the ``kept`` text; other columns stay.

    Lines end at newlines, an empty text is one empty line and a null text has none (kept: null).
    A line goes if a run of ``shortest`` lines that covers it also starts earlier: in a row with a
    smaller key (null is the largest; rows of one key come as they are read) or further up in the same text.
    With ``alone``, so does a line that occurs earlier if it has that many words, or has words and is
    its whole text.
    ``spans`` are structs of the first line and the line after the last. Repeated rows are later
    copies. No rows give no rows; input columns named like an output are replaced.
    """
    row = unused(df, "_row")
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), compression="zstd")
    order = [F.col("key").asc_nulls_last(), F.col("row").asc()]
    numbered = in_ranges(rows.select(F.col(f"`{key}`").alias("key"), F.col(row).alias("row")), order)
    parts = totals_before(numbered, {"n": F.lit(1)})
    starts = rows.sparkSession.createDataFrame([(p["_part"], p["before_n"]) for p in parts], "_part int, _start long")
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = numbered.join(F.broadcast(starts), "_part").select("row", number.alias("number"))  # a row per partition

    split = F.split(text_or_empty(text), "\n", -1)

    def hashes(line: Column) -> Column:
        both = [F.xxhash64(line).alias("line_a"), F.hash(line).alias("line_b")]
        if alone is not None:
            words = F.regexp_count(line, F.lit(WORD))
            both.append(((words >= alone) | ((F.size(split) == 1) & (words > 0))).alias("alone"))
        return F.struct(*both)

    each = F.transform(split, hashes)
    hashed = rows.where(F.col(f"`{text}`").isNotNull()).select(F.col(row).alias("row"), each.alias("lines"))
    places = hashed.join(numbered, "row").select("number", F.posexplode("lines").alias("line", "hashes"))
    places = checkpointed(places.select((F.col("number") * STRIDE + F.col("line")).alias("place"), "hashes.*"))

    named = _named(places, "line_a", "line_b")
    runs = repeated_runs(places, shortest, named).select("place", F.lit(shortest).alias("lines"))
    if alone is not None:
        single = named.where("name < place").join(places.where("alone"), "place", "left_semi")
        runs = runs.union(single.select("place", F.lit(1).alias("lines")))
    line = (F.col("place") % STRIDE).cast("int")
    runs = runs.select(F.floor(F.col("place") / STRIDE).alias("number"), line.alias("line"), (line + F.col("lines")).alias("end"))
    # a document's runs, some lines each, join where one begins before the last has ended
    in_text = Window.partitionBy("number").orderBy("line", "end")
    earlier = in_text.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("line") > F.max("end").over(earlier), F.lit(True))
    islands = runs.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(in_text))
    spans = islands.groupBy("number", "island").agg(F.min("line").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    found = checkpointed(numbered.join(spans, "number").select(F.col("row").alias(row), "spans"))

    lines = F.split(F.col(f"`{text}`").cast("string"), "\n", -1)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    outputs = ("n_lines", "spans", "kept")
    result = rows.drop(*[c for c in rows.columns if c.lower() in outputs and c != text]).join(found, row, "left")
    carried = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outputs]
    return result.select(
        *carried, F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        spans.alias("spans"), F.when(F.size(spans) == 0, F.col(f"`{text}`")).otherwise(_left(lines, spans)).alias("kept"),
    )


def _left(lines: Column, spans: Column) -> Column:
    """The lines outside the spans, joined again."""

    def of(bound: Column) -> Column:
        all_lines, cuts = bound["lines"], bound["spans"]
        before = F.transform(cuts, lambda s, i: F.slice(all_lines, F.when(i == 0, 1).otherwise(F.get(cuts, i - 1)["end"] + 1), s["start"] - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])))
        last = F.element_at(cuts, -1)["end"]
        after = F.slice(all_lines, last + 1, F.size(all_lines) - last)
        return F.array_join(F.flatten(F.concat(before, F.array(after))), "\n")

    # bound once for all slices
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), spans.alias("spans"))), of), F.lit(0))
