"""Column and table names that are safe to use unquoted."""

from __future__ import annotations

import re
from collections.abc import Iterable


# Fixed value: the characters a name may keep.
_NOT_ALLOWED = re.compile(r"[^a-z0-9_]")


def safe_name(name: str) -> str:
    """``' Unit Price ($)'`` becomes ``'unit_price'``; a name with nothing left becomes ``'col'``."""
    return _NOT_ALLOWED.sub("_", name.strip().lower()).strip("_") or "col"


def safe_names(names: Iterable[str | None]) -> list[str]:
    """Normalise a header; two columns that end up with one name are an error."""
    result = [safe_name(n or "") for n in names]
    twice = sorted({n for n in result if result.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after normalising: {', '.join(twice)}")
    return result
