"""One rule and a table's schema in, Column expressions out.

Nothing here reads data. A rule that cannot run on this table (a missing column, a bound of
another kind than its column, a pattern that does not compile, a date that Spark does not read)
becomes an errored check with the reason, so that it never reaches the query the other rules
share. So does a rule whose compilation fails in any other way.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Mapping, Sequence, Set
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, localcontext
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import regex, sqltypes
from plumbline.functions.spec import PROVENANCE
from plumbline.plans.catalog import BY_NAME

# Up to this many members a value set is part of the scan's own expression; a longer one is
# joined to the column's grouped values. Both compare the same members in the column's own type.
INLINE_SET = 1000


class CannotRun(ValueError):
    """This rule cannot run on this table; the message says why."""


@dataclass(frozen=True)
class Check:
    """One rule made ready for one table.

    ``kind`` names how its numbers are computed: ``row`` (a conditional count in the shared
    aggregate), ``unique``, ``distinct`` and ``members`` (from the column's grouped values),
    ``mean``, ``rows``, ``schema`` and ``errored``.
    """

    position: int
    spec: str
    type: str
    kind: str
    spec_key: str | None = None
    statement: str | None = None
    column: str | None = None
    violation: Column | None = None
    counts_nulls: bool = False
    mostly: float = 1.0
    low: Any = None
    high: Any = None
    members: tuple[Any, ...] = ()
    negated: bool = False
    observed: str | None = None
    success: bool = False
    detail: str | None = None

    @property
    def counted(self) -> bool:
        """Whether the check counts violating rows, and so can name some of them."""
        return self.kind in ("row", "unique", "members")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: What of a suite is known not to work here: patterns, and literals as (type, text).
Broken = Set[str | tuple[str, str]]


def compile_rules(
    schema: T.StructType, specs: Sequence[Mapping[str, Any]], broken: Broken = frozenset()
) -> list[Check]:
    """Every spec as a check, in order. ``broken`` holds patterns and literals known not to work."""
    return [_compile(schema, i, spec, broken) for i, spec in enumerate(specs)]


def _kwargs(spec: Mapping[str, Any]) -> dict[str, Any]:
    given = spec.get("kwargs") or {}
    return dict(given) if isinstance(given, Mapping) else {}


def patterns(specs: Sequence[Mapping[str, Any]]) -> set[str]:
    found = (_kwargs(s).get("regex") for s in specs)
    return {p for p in found if isinstance(p, str)}


def literals(schema: T.StructType, specs: Sequence[Mapping[str, Any]]) -> set[tuple[str, str]]:
    """What the specs compare dates and times with, as (type, text)."""
    types = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, sqltypes.TEMPORAL)}
    found = set()
    for kwargs in map(_kwargs, specs):
        column = kwargs.get("column")
        if isinstance(column, str) and column in types:
            members = kwargs.get("value_set")
            values = list(members) if isinstance(members, list | tuple | set | frozenset) else []
            values += [kwargs.get("min_value"), kwargs.get("max_value")]
            found |= {(types[column].simpleString(), _shown(v)) for v in values if v is not None}
    return found


def _finite(value: Any) -> Any:
    """The value with infinite and NaN numbers as text, since JSON has none."""
    if isinstance(value, Mapping):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_finite(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return value


def _shown(value: Any) -> str:
    return value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)


def _compile(
    schema: T.StructType, position: int, spec: Mapping[str, Any], broken: Broken
) -> Check:
    given = spec.get("kwargs") or {}
    text = json.dumps({"type": spec.get("type"), "kwargs": _finite(given)}, default=str, skipkeys=True)
    name = str(spec.get("type"))
    try:
        if not isinstance(given, Mapping):
            raise CannotRun("kwargs is not an object")
        parts = _parts(schema, name, dict(given), broken)
    except CannotRun as exc:
        parts = {"kind": "errored", "detail": str(exc)}
    except Exception as exc:  # whatever a rule holds, the others run
        parts = {"kind": "errored", "detail": f"{type(exc).__name__}: {exc}"}
    return Check(position=position, spec=text, type=name, **parts)


def _parts(
    schema: T.StructType, name: str, kwargs: dict[str, Any], broken: Broken
) -> dict[str, Any]:
    if name not in BY_NAME:
        raise CannotRun(f"{name} is not a rule type of this catalog")
    entry = BY_NAME[name]
    kwargs = {k: v for k, v in kwargs.items() if v is not None and k != PROVENANCE}
    if missing := [p for p in entry.required if p not in kwargs]:
        raise CannotRun(f"{name} lacks {', '.join(missing)}")
    if unknown := sorted(set(kwargs) - set(entry.parameters)):
        raise CannotRun(f"{name} does not take {', '.join(unknown)}")
    if "at_least_one_bound" in entry.checks and not {"min_value", "max_value"} & set(kwargs):
        raise CannotRun(f"{name} has neither min_value nor max_value")

    column = kwargs.get("column")
    fields = {f.name: f.dataType for f in schema.fields}
    if name == "expect_column_to_exist":
        return {"kind": "schema", "column": column, "success": column in fields}
    if name == "expect_table_row_count_to_be_between":
        return {"kind": "rows", **_number_bounds(kwargs)}
    if column not in fields:
        raise CannotRun(f"the table has no column {column}")

    mostly = kwargs.get("mostly", 1.0)
    if isinstance(mostly, bool) or not isinstance(mostly, int | float) or not 0 <= mostly <= 1:
        raise CannotRun(f"mostly={mostly!r} is not a proportion between 0 and 1")
    shared = {"column": column, "mostly": float(mostly)}
    return {**shared, **_on_column(name, quoted(column), fields[column], kwargs, broken)}


def _on_column(
    name: str, c: Column, data_type: T.DataType, kwargs: dict[str, Any], broken: Broken
) -> dict[str, Any]:
    if name == "expect_column_values_to_not_be_null":
        return {"kind": "row", "violation": c.isNull(), "counts_nulls": True}
    if name == "expect_column_values_to_be_null":
        return {"kind": "row", "violation": c.isNotNull(), "counts_nulls": True}
    if name == "expect_column_values_to_be_unique":
        return {"kind": "unique"}
    if name == "expect_column_unique_value_count_to_be_between":
        return {"kind": "distinct", **_number_bounds(kwargs)}
    if name in ("expect_column_values_to_be_in_set", "expect_column_values_to_not_be_in_set"):
        negated = name.endswith("to_not_be_in_set")
        return _membership(c, data_type, kwargs, negated, broken)
    if name == "expect_column_values_to_be_between":
        return {"kind": "row", "violation": _outside(c, *_typed_bounds(data_type, kwargs, broken))}
    if name == "expect_column_mean_to_be_between":
        if not isinstance(data_type, sqltypes.NUMERIC):
            raise CannotRun(f"a mean needs numbers, and the column is {data_type.simpleString()}")
        return {"kind": "mean", **_number_bounds(kwargs)}
    if name in ("expect_column_values_to_match_regex", "expect_column_values_to_not_match_regex"):
        _require_text(data_type, "a pattern")
        if not isinstance(kwargs["regex"], str) or kwargs["regex"] in broken:
            raise CannotRun(f"the pattern {kwargs['regex']} does not compile")
        matches = c.rlike(regex.to_java(kwargs["regex"]))
        return {"kind": "row", "violation": matches if "not_match" in name else ~matches}
    if name == "expect_column_value_lengths_to_be_between":
        _require_text(data_type, "a length")
        low, high = _number_bounds(kwargs)["low"], _number_bounds(kwargs)["high"]
        return {
            "kind": "row",
            "violation": _outside(F.char_length(c), _literal(low), _literal(high)),
        }
    return _stored_as(data_type, kwargs)


def _stored_as(data_type: T.DataType, kwargs: dict[str, Any]) -> dict[str, Any]:
    names = kwargs["type_list"] if "type_list" in kwargs else [kwargs["type_"]]
    for sql_type in names:
        if not isinstance(sql_type, str) or sql_type.upper() not in sqltypes.SQL_TYPES:
            raise CannotRun(f"{sql_type} is not a SQL type name")
    return {
        "kind": "schema",
        "observed": sqltypes.sql_name(data_type),
        "success": any(sqltypes.is_of_type(data_type, n) for n in names),
    }


def _require_text(data_type: T.DataType, what: str) -> None:
    if not isinstance(data_type, sqltypes.TEXT):
        raise CannotRun(f"{what} needs text, and the column is {data_type.simpleString()}")


def _membership(
    c: Column, data_type: T.DataType, kwargs: dict[str, Any], negated: bool, broken: Broken
) -> dict[str, Any]:
    given = kwargs["value_set"]
    if not isinstance(given, list | tuple | set | frozenset):
        raise CannotRun("value_set is not a list")
    # x IN (..., NULL) is never false, so a null member would hide every violation.
    typed = dict.fromkeys(_typed(data_type, v, broken) for v in given if v is not None)
    if not typed:
        raise CannotRun("value_set is empty")
    members = tuple(m for m in typed if _representable(data_type, m))
    if len(members) > INLINE_SET:
        return {"kind": "members", "members": members, "negated": negated}
    # null for a null, as the comparison with members is
    found = c.isin([_in_type(data_type, v) for v in members]) if members else F.when(c.isNotNull(), F.lit(False))
    return {"kind": "row", "violation": found if negated else ~found}


# The bits of Spark's whole number types.
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _representable(data_type: T.DataType, member: Any) -> bool:
    """Whether a column of this type can hold the member exactly; no row equals one it cannot hold."""
    exact_type = type(data_type) in _BITS or isinstance(data_type, T.DecimalType)
    if exact_type and isinstance(member, float) and not math.isfinite(member):
        return False
    if type(data_type) in _BITS:
        most = 1 << (_BITS[type(data_type)] - 1)
        return member == int(member) and -most <= member < most
    if isinstance(data_type, T.DecimalType):
        exact = Decimal(repr(member)) if isinstance(member, float) else Decimal(member)
        with localcontext(prec=400):
            scaled = exact.scaleb(data_type.scale)
            return scaled == scaled.to_integral_value() and abs(scaled) < 10**data_type.precision
    if isinstance(data_type, T.FloatType):
        try:
            return struct.unpack("f", struct.pack("f", member))[0] == member
        except OverflowError:
            return False
    return True


def _outside(value: Column, low: Column | None, high: Column | None) -> Column:
    sides = ([] if low is None else [value < low]) + ([] if high is None else [value > high])
    return reduce(lambda a, b: a | b, sides) if sides else F.lit(False)


def _literal(value: Any) -> Column | None:
    return None if value is None else _number(value)


def _number(value: Any) -> Column:
    """A number as a literal: a long, else a decimal, else the nearest double, which no such column reaches."""
    if not isinstance(value, int) or isinstance(value, bool) or -(1 << 63) <= value < 1 << 63:
        return F.lit(value)
    if abs(value) < 10**38:
        return F.lit(Decimal(value))
    return F.lit(as_double(value))


def as_double(value: Any) -> float:
    """The nearest double; infinity for a whole number beyond them all."""
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _number_bounds(kwargs: Mapping[str, Any]) -> dict[str, Any]:
    bounds = {"low": kwargs.get("min_value"), "high": kwargs.get("max_value")}
    for value in bounds.values():
        if isinstance(value, bool) or not isinstance(value, int | float | Decimal | None):
            raise CannotRun(f"the bound {value!r} is not a number")
    return {k: None if v is None else _plain(v) for k, v in bounds.items()}


def _typed_bounds(
    data_type: T.DataType, kwargs: Mapping[str, Any], broken: Broken
) -> tuple[Column | None, Column | None]:
    if isinstance(data_type, sqltypes.UNORDERED):
        raise CannotRun(f"a column of type {data_type.simpleString()} has no order")
    low, high = kwargs.get("min_value"), kwargs.get("max_value")
    return tuple(
        None if v is None else _in_type(data_type, _typed(data_type, v, broken)) for v in (low, high)
    )


def _plain(value: Any) -> Any:
    """3.0 as 3, so that whole numbers are compared with integer columns exactly."""
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _typed(data_type: T.DataType, value: Any, broken: Broken) -> Any:
    """A parameter checked against the kind of its column, before any row is read."""
    if isinstance(data_type, sqltypes.NUMERIC):
        if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
            raise CannotRun(f"{value!r} is not a number, and the column is {data_type.simpleString()}")
        return _plain(value)
    if isinstance(data_type, T.BooleanType):
        if not isinstance(value, bool):
            raise CannotRun(f"{value!r} is not true or false")
        return value
    if isinstance(data_type, sqltypes.TEMPORAL):
        shown = _shown(value)
        try:
            (date if isinstance(data_type, T.DateType) and len(shown) == 10 else datetime).fromisoformat(shown)
        except ValueError as exc:
            raise CannotRun(f"{shown!r} is not a {data_type.simpleString()}") from exc
        if (data_type.simpleString(), shown) in broken:
            raise CannotRun(f"{shown!r} is not read as a {data_type.simpleString()}")
        return shown
    if isinstance(data_type, sqltypes.TEXT):
        if not isinstance(value, str):
            raise CannotRun(f"{value!r} is not text, and the column is {data_type.simpleString()}")
        return value
    raise CannotRun(f"values of a {data_type.simpleString()} column cannot be compared")


def _in_type(data_type: T.DataType, value: Any) -> Column:
    if isinstance(data_type, sqltypes.TEMPORAL):
        return F.lit(value).cast(data_type)
    if isinstance(data_type, T.DecimalType) and isinstance(value, float) and math.isfinite(value):
        return F.lit(Decimal(repr(value)))
    return _number(value)
