"""Times given on the driver, as columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def time_literal(at: datetime) -> Column:
    """A time without zone stays as written; ``F.lit`` would shift it by the driver's own zone."""
    if at.tzinfo is not None:
        return F.lit(at)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
