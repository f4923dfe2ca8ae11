"""Patterns: bracket classes rewritten for Java, and a test that a pattern compiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.local import local_frame

# POSIX bracket classes and the Java class each one means.
POSIX_CLASSES: dict[str, str] = {
    "[:alpha:]": r"\p{Alpha}",
    "[:digit:]": r"\d",
    "[:alnum:]": r"\p{Alnum}",
    "[:upper:]": r"\p{Upper}",
    "[:lower:]": r"\p{Lower}",
    "[:punct:]": r"\p{Punct}",
    "[:space:]": r"\s",
    "[:blank:]": r"\p{Blank}",
    "[:cntrl:]": r"\p{Cntrl}",
    "[:graph:]": r"\p{Graph}",
    "[:print:]": r"\p{Print}",
    "[:xdigit:]": r"\p{XDigit}",
}


def to_java(pattern: str) -> str:
    """Java reads ``[:space:]`` as a set of letters, so such classes are replaced."""
    return reduce(lambda p, pair: p.replace(*pair), POSIX_CLASSES.items(), pattern)


def to_java_column(pattern: Column) -> Column:
    return reduce(
        lambda p, pair: F.replace(p, F.lit(pair[0]), F.lit(pair[1])), POSIX_CLASSES.items(), pattern
    )


def compiles(pattern: Column) -> Column:
    """True where a pattern compiles in the regex library ``rlike`` itself uses."""
    compiled = F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("compile"), to_java_column(pattern)
    )
    return F.coalesce(compiled.isNotNull(), F.lit(False))


def failing_patterns(spark: SparkSession, patterns: set[str]) -> set[str]:
    """Those of a suite's patterns that do not compile, found before the table is read."""
    if not patterns:
        return set()
    probe = local_frame(spark, [(p,) for p in sorted(patterns)], "pattern string")
    return {row.pattern for row in probe.filter(~compiles(F.col("pattern"))).collect()}
