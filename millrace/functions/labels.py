"""Small expressions the reports share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The placeholder for missing text, the rate tiers and the error text length.
MISSING = "—"
TIER_HIGH = 90
TIER_MIDDLE = 70
ERROR_LENGTH = 80


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with three decimals, NULL if either end is missing."""
    micros = _micros(end) - _micros(start)
    return F.round(micros.cast("decimal(20,0)") / F.lit(1000000), 3).cast("decimal(18,3)")


def whole_seconds_label(start: Column, end: Column) -> Column:
    """``'12s'`` from the times cut to whole seconds."""
    seconds = _micros(F.date_trunc("second", end)) - _micros(F.date_trunc("second", start))
    return F.coalesce(F.concat((seconds / 1000000).cast("bigint").cast("string"), F.lit("s")), F.lit(MISSING))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_label(seconds: Column) -> Column:
    return F.coalesce(F.concat(seconds.cast("string"), F.lit("s")), F.lit(MISSING))


def minute_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(MISSING))


def success_pct(ok: Column, total: Column) -> Column:
    """Percentage with one decimal, half to even; NULL without any finished run."""
    ratio = ok.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    return F.bround(ratio * 100, 1)


def rate_tier(pct: Column) -> Column:
    return F.when(pct >= TIER_HIGH, "hi").when(pct >= TIER_MIDDLE, "mid").when(pct.isNotNull(), "lo")


def arrow_label(kind: Column, place: Column) -> Column:
    """``'jdbc → public.t'``; an unknown place stays visible as ``None``."""
    return F.when(F.coalesce(kind, F.lit("")) == "", MISSING).otherwise(
        F.concat(kind, F.lit(" → "), F.coalesce(place, F.lit("None")))
    )


def bracket_label(kind: Column, place: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")) == "", MISSING).otherwise(
        F.concat(kind, F.lit(" ("), F.coalesce(place, F.lit("None")), F.lit(")"))
    )


def stage_of(task_id: Column) -> Column:
    """The part of a task id before the first dot, without ``_skipped``."""
    return F.replace(F.split_part(task_id, F.lit("."), F.lit(1)), F.lit("_skipped"), F.lit(""))
