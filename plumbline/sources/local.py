"""Small frames from rows the driver holds, without a job or a Python worker."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], ddl: str | T.StructType) -> DataFrame:
    """``rows`` as a DataFrame. Handed over as Arrow, which the plan holds as a local relation."""
    given = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in given.fields])
    arrow = to_arrow_schema(schema)
    columns = [pa.array([row[i] for row in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=schema)
