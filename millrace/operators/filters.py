"""Conditions on cleaned columns as SQL, with the value taken as the column's type."""

from __future__ import annotations

import re
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation

from pyspark.sql.types import (
    BooleanType, DataType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType,
)

from millrace.functions.casts import FALSE_WORDS, TIME_TEXT, TRUE_WORDS
from millrace.spec import FilterSpec, SpecError


def condition_sql(spec: FilterSpec, column: str, data_type: DataType, *, ansi: bool = True) -> str:
    """The condition of one filter on the SQL expression ``column`` of the given type."""
    if spec.operator in ("IS NULL", "IS NOT NULL"):
        return f"{column} {spec.operator}"
    if spec.operator == "LIKE":
        if not isinstance(data_type, StringType):
            raise SpecError(f"LIKE needs a text column, {spec.column!r} is {data_type.simpleString()}")
        return f"{column} LIKE {sql_text(contains_pattern(spec.value))}"
    if isinstance(data_type, DecimalType):
        return _compare_decimal(column, spec, data_type.scale)
    return f"{column} {spec.operator} {_literal(spec, data_type, ansi)}"


def sql_text(value: str) -> str:
    """A text literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_pattern(value: str) -> str:
    """``%value%`` where ``%`` and ``_`` stay wildcards and a backslash takes the next character literally."""
    pattern, escaped = [], False
    for char in f"%{value}%":
        if escaped:
            pattern.append("\\" + char if char in "%_\\" else char)
            escaped = False
        elif char == "\\":
            escaped = True
        else:
            pattern.append(char)
    if escaped:
        raise SpecError("a LIKE value must not end in a backslash")
    return "".join(pattern)


def _literal(spec: FilterSpec, data_type: DataType, ansi: bool) -> str:
    text, kind = spec.value.strip(), data_type.simpleString()
    if isinstance(data_type, StringType):
        return sql_text(spec.value)
    if isinstance(data_type, IntegralType):
        try:
            return f"cast({int(text)} as {kind})"
        except ValueError:
            raise _bad_value(spec, data_type) from None
    if isinstance(data_type, BooleanType):
        word = text.lower()
        if word in ("t", "true", "y", "yes", "1", *TRUE_WORDS):
            return "true"
        if word in ("f", "false", "n", "no", "0", *FALSE_WORDS):
            return "false"
        raise _bad_value(spec, data_type)
    if isinstance(data_type, (DateType, TimestampNTZType, TimestampType)) and not re.fullmatch(TIME_TEXT, text):
        raise _bad_value(spec, data_type)
    if ansi:
        return f"cast({sql_text(text)} as {kind})"
    error = sql_text(str(_bad_value(spec, data_type)))
    return f"coalesce(try_cast({sql_text(text)} as {kind}), cast(raise_error({error}) as {kind}))"


def _compare_decimal(column: str, spec: FilterSpec, scale: int) -> str:
    """Compare on the column's own grid of digits, so that a finer value is never rounded."""
    try:
        exact = Decimal(spec.value.strip())
        if not exact.is_finite():
            raise InvalidOperation
    except InvalidOperation:
        raise _bad_value(spec, DecimalType(38, scale)) from None
    step = Decimal(1).scaleb(-scale)
    floor = exact.quantize(step, ROUND_FLOOR)
    if floor == exact:
        return f"{column} {spec.operator} {floor:f}BD"
    if spec.operator in ("=", "!="):
        return f"case when {column} is not null then {str(spec.operator == '!=').lower()} end"
    if spec.operator in (">", ">="):
        return f"{column} > {floor:f}BD"
    return f"{column} < {exact.quantize(step, ROUND_CEILING):f}BD"


def _bad_value(spec: FilterSpec, data_type: DataType) -> SpecError:
    return SpecError(f"filter on {spec.column!r}: {spec.value!r} is not a {data_type.simpleString()}")
