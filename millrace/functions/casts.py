"""From raw text to the six column types.

A value that does not fit its type fails the job. Spark's ANSI casts do that by themselves; in a
session without ANSI mode the cast is guarded, because NULL in place of an error would lose data.
"""

from __future__ import annotations

# The Spark type of each column type. NUMERIC rounds to two digits, half away from
# zero; casting to the scale at once rounds a single time. TIMESTAMP ignores any zone in the text.
SPARK_TYPES = {
    "TEXT": "string",
    "INTEGER": "int",
    "NUMERIC": "decimal(38,2)",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}
UNROUNDED_NUMERIC = "decimal(38,18)"

# Boolean words that the cast below does not take by itself.
TRUE_WORDS = ("on", "tr", "tru", "ye")
FALSE_WORDS = ("off", "of", "fa", "fal", "fals")


#: Fixed value: the text that may become a DATE or a TIMESTAMP. Spark's casts ignore what follows a date after a blank or T.
TIME_TEXT = (r"[0-9]{4,6}-[0-9]{1,2}-[0-9]{1,2}"
             r"([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]+)?)? ?(Z|UTC|[+-][0-9]{1,2}(:?[0-9]{2})?)?)?")


def typed(value: str, kind: str, *, ansi: bool, rounded: bool = True, trimmed: bool = False) -> str:
    """SQL for the expression ``value`` as the column type ``kind``; ``trimmed`` text needs no trim."""
    if kind == "TEXT":
        return f"cast({value} as string)" if trimmed else f"trim(cast({value} as string))"
    if kind == "NUMERIC" and not rounded:
        return _cast(value, UNROUNDED_NUMERIC, ansi)
    if kind == "BOOLEAN":
        word = f"lower(trim(cast({value} as string)))"
        return (f"case when {word} in ({_quoted(TRUE_WORDS)}) then true "
                f"when {word} in ({_quoted(FALSE_WORDS)}) then false else {_cast(value, 'boolean', ansi)} end")
    if kind in ("DATE", "TIMESTAMP"):
        return _whole_time(value, SPARK_TYPES[kind], ansi)
    return _cast(value, SPARK_TYPES[kind], ansi)


def _whole_time(value: str, spark_type: str, ansi: bool) -> str:
    """The cast of text that is a time as a whole; any other text fails the job."""
    return (f"case when {value} is null or trim(cast({value} as string)) rlike '^{TIME_TEXT}$' then {_cast(value, spark_type, ansi)} "
            f"else cast(raise_error(concat('invalid {spark_type}: ', cast({value} as string))) as {spark_type}) end")


def _cast(value: str, spark_type: str, ansi: bool) -> str:
    if ansi:
        return f"cast({value} as {spark_type})"
    tried = f"try_cast({value} as {spark_type})"
    return (f"case when {value} is null or {tried} is not null then {tried} "
            f"else cast(raise_error(concat('invalid {spark_type}: ', {value})) as {spark_type}) end")


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)
