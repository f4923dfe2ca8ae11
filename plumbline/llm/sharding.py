"""Contiguous shards of nearly equal bytes (operator 1).

Rows are sorted by id over range partitions; the sizes of the partitions, one number each, give
every partition the bytes before it, and a row's shard follows from the bytes before the middle
of the row. Nothing but one number per partition (and per shard within it) leaves the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import in_ranges, shipped, text_or_empty, tie_break, totals_before

#: Bytes that a row takes beside its text.
OVERHEAD = 16


def byte_shards(
    df: DataFrame, shards: int = 40, text: str = "text", order: str = "doc_id", overhead: int = OVERHEAD,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each row with its ``size``, ``shard`` (0 to ``shards`` - 1) and gapless ``slot`` in the shard.

    Shards are contiguous in ``order`` (nulls first; rows that tie come by a hash of all columns)
    and end where the running total of bytes passes equal targets, so a shard's bytes differ from
    the target by at most the size of one row at each end. A null text has no bytes beside the
    overhead. Repeated rows are rows of their own. No rows give no shards; fewer rows than shards
    leave some shards empty. ``keep`` names the columns to carry along (all without it); input
    columns named like an output are replaced.
    """
    size = (F.octet_length(text_or_empty(text)) + F.lit(overhead)).cast("long")
    shipped(df.sparkSession)
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("size", "shard", "slot")]
    df = df.select(
        # under names of their own, so that no column has a helper's name
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)], size.alias("size"), tie_break(df).alias("_tie"),
        F.col(f"`{order}`").alias("_order"),
    )
    rows = in_ranges(df, [F.col("_order").asc_nulls_first(), F.col("_tie").asc()])
    parts = totals_before(rows, {"size": F.col("size")})
    before = {p["_part"]: p["before_size"] for p in parts}
    total = sum(p["size"] for p in parts)

    helpers = ("_part", "_tie", "_order")

    def dealt(batches: Iterator[pa.RecordBatch], starts: dict | None = None) -> Iterator[pa.RecordBatch]:
        running, slots = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            running = before[part] if running is None else running
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            ends = running + np.cumsum(sizes)
            running = int(ends[-1])
            middles = ends * 2 - sizes  # twice the bytes before the middle of the row
            shard = np.minimum(middles.astype(object) * shards // (2 * total), shards - 1).astype(np.int32)
            slot = np.zeros(len(shard), dtype=np.int64)
            for s in np.unique(shard):  # ascending, and a batch has few
                here = np.flatnonzero(shard == s)
                first = slots.get(int(s), (starts or {}).get((part, int(s)), 0))
                slot[here] = first + np.arange(len(here))
                slots[int(s)] = first + len(here)
            keep = [n for n in batch.schema.names if n not in helpers]
            if starts is None:
                yield pa.RecordBatch.from_arrays([batch.column("_part"), pa.array(shard)], ["_part", "shard"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in keep], pa.array(shard), pa.array(slot)], [*keep, "shard", "slot"]
                )

    counted = rows.select("_part", "size").mapInArrow(dealt, "_part int, shard int")
    starts, seen = {}, {}
    for p in totals_before(counted, {"n": F.lit(1)}, ("_part", "shard")):
        starts[p["_part"], p["shard"]] = seen.get(p["shard"], 0)
        seen[p["shard"]] = seen.get(p["shard"], 0) + p["n"]
    fields = [f for f in rows.schema.fields if f.name not in helpers]
    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return rows.mapInArrow(lambda it: dealt(it, starts), schema).toDF(*carried, "size", "shard", "slot")
