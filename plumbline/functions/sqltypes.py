"""SQL type names and the Spark types that answer to them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.local import local_frame

# The SQL type names a rule may use, with the Spark types each one describes.
SQL_TYPES: dict[str, tuple[type[T.DataType], ...]] = {
    "SMALLINT": (T.ShortType,),
    "INTEGER": (T.IntegerType,),
    "SERIAL": (T.IntegerType,),
    "BIGINT": (T.LongType,),
    "BIGSERIAL": (T.LongType,),
    "NUMERIC": (T.DecimalType,),
    "DECIMAL": (T.DecimalType,),
    "MONEY": (T.DecimalType,),
    "REAL": (T.FloatType,),
    "FLOAT": (T.DoubleType,),
    "DOUBLE_PRECISION": (T.DoubleType,),
    "CHAR": (T.StringType,),
    "VARCHAR": (T.StringType,),
    "TEXT": (T.StringType,),
    "UUID": (T.StringType,),
    "XML": (T.StringType,),
    "ENUM": (T.StringType,),
    "INET": (T.StringType,),
    "CIDR": (T.StringType,),
    "MACADDR": (T.StringType,),
    "TSVECTOR": (T.StringType,),
    "BYTEA": (T.BinaryType,),
    "BIT": (T.BinaryType,),
    "JSON": (T.VariantType, T.StringType),
    "JSONB": (T.VariantType, T.StringType),
    "ARRAY": (T.ArrayType,),
    "BOOLEAN": (T.BooleanType,),
    "DATE": (T.DateType,),
    "TIME": (),
    "TIMESTAMP": (T.TimestampNTZType, T.TimestampType),
    "TIMESTAMPTZ": (T.TimestampType,),
    "INTERVAL": (T.DayTimeIntervalType, T.YearMonthIntervalType),
}

NUMERIC = (T.NumericType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.CharType, T.VarcharType)

# Types with no useful order: profiled without bounds, counted through their text.
UNORDERED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def in_order(column: Column, data_type: T.DataType) -> Column:
    """A map with its entries in the order of their keys, so that equal maps print alike."""
    if not isinstance(data_type, T.MapType):
        return column
    entry = lambda k: F.struct(k.alias("key"), F.element_at(column, k).alias("value"))
    return F.map_from_entries(F.transform(F.array_sort(F.map_keys(column)), entry))


def is_of_type(data_type: T.DataType, sql_name: str) -> bool:
    """Whether a column of ``data_type`` is stored as the SQL type ``sql_name``."""
    wanted = SQL_TYPES[sql_name.upper()]
    if T.StringType in wanted and isinstance(data_type, TEXT):
        return True
    return isinstance(data_type, wanted) if wanted else data_type.simpleString().startswith("time(")


def sql_name(data_type: T.DataType) -> str:
    """The SQL name a result reports for a column's stored type."""
    if isinstance(data_type, T.StringType):
        return "TEXT"
    if isinstance(data_type, T.VariantType):
        return "JSON"
    if isinstance(data_type, T.DoubleType):
        return "DOUBLE_PRECISION"
    for name, wanted in SQL_TYPES.items():
        if wanted and isinstance(data_type, wanted):
            return name
    return data_type.simpleString().upper()


def failing_literals(spark: SparkSession, literals: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """Those of a suite's dates and times, as (type, text), that Spark does not read as their type."""
    if not literals:
        return set()
    probe = local_frame(spark, sorted(literals), "type string, text string")
    read = [(F.col("type") == kind) & F.col("text").try_cast(kind).isNotNull() for kind in sorted({k for k, _ in literals})]
    unread = probe.filter(~F.coalesce(F.greatest(*read, F.lit(False)), F.lit(False)))
    return {(row.type, row.text) for row in unread.collect()}
