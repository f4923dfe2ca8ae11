"""Rows in one order over all partitions, and running totals from one row per partition."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local session that names none."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, in the order and partitions they were computed in, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again; each is computed once.

    Columns of nothing but untyped nulls, which Parquet does not hold, are left out and come back.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    stored = df.drop(*void)
    stored.write.options(**options).parquet(path)
    read = df.sparkSession.read.schema(stored.schema).parquet(path)
    return read.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else read


def in_ranges(df: DataFrame, order: Sequence[Column], part: str = "_part") -> DataFrame:
    """The rows sorted over all partitions and kept that way, with the number of their partition.

    The order should end in a tie break: ranges then also split equal keys.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(dealt.withColumn(part, F.spark_partition_id()))
