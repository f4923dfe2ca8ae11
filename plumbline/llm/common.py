"""Helpers of the corpus operators: shared folders, fixed orders and running totals over partitions."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ranges import checkpointed, in_ranges, shared_folder, written

__all__ = [
    "WORD", "checkpointed", "in_ranges", "replaced", "shared_folder", "shipped", "text_or_empty", "tie_break",
    "totals_before", "unused", "written",
]

#: The pattern of a word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="plumbline-")) / f"{root.name}.zip"
    with zipfile.ZipFile(place, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(place))
    _SHIPPED.add(context.applicationId)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with new columns; columns of these names, in any case, make room for them."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of the frame has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tie_break(df: DataFrame) -> Column:
    """A number from all columns, so that rows that tie on the order come in one order every time."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") for f in df.schema.fields])


def totals_before(df: DataFrame, sums: dict[str, Column], by: Sequence[str] = ("_part",)) -> list[dict]:
    """Per group of ``by`` its sums and what all groups before it sum to: one row per partition and group.

    The groups are partitions of ``in_ranges``, or a partition's few parts; they come in order.
    """
    rows = df.groupBy(*by).agg(*[F.sum(c).alias(k) for k, c in sums.items()]).collect()
    out, running = [], dict.fromkeys(sums, 0)
    for row in sorted(rows, key=lambda r: tuple((r[b] is not None, r[b]) for b in by)):
        out.append({b: row[b] for b in by} | {k: row[k] for k in sums} | {f"before_{k}": running[k] for k in sums})
        for k in sums:
            running[k] += row[k]
    return out
