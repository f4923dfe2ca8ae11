"""Tables laid out by a key, so that several jobs on that key shuffle nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranges import shared_folder
from plumbline.plans.compile import quoted

#: A key with this many times the rows of a mean bucket is hot.
HOT = 4


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, bucketed and sorted by ``key``.

    Groups and joins on the key plan without a shuffle, and so do joins of two tables with the
    same number of buckets and keys of one type. A bucket is read by one task; if a key holds more
    than ``HOT`` mean buckets, ``df`` comes back as it is, since a shuffle, unlike a bucket,
    is split at run time. Rows with a null key are one key. The table stays until its folder is cleared.
    """
    if buckets < 1:
        raise ValueError("a table has one bucket at least")
    per_key = df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("__n"))
    rows, most = per_key.agg(F.sum("__n"), F.max("__n")).first()
    if buckets > 1 and rows and most > max(HOT * rows / buckets, HOT):
        return df
    name = f"layout_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, quoted(key))  # a file per bucket
    path = f"{shared_folder(df.sparkSession)}/{name}"
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
