"""The typed description of a cleaning job: one ``TableSpec`` per output table.

Mistakes raise here, before any Spark job starts, instead of being dropped silently.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from millrace.functions.names import safe_name

# The accepted type, operator, join and aggregate names.
COLUMN_TYPES = ("TEXT", "INTEGER", "NUMERIC", "DATE", "TIMESTAMP", "BOOLEAN")
FILTER_OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "LIKE", "IS NULL", "IS NOT NULL")
JOIN_TYPES = ("INNER", "LEFT", "RIGHT")
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")

# Words that may not occur in a computed expression.
FORBIDDEN_WORDS = (
    "DROP", "DELETE", "INSERT", "UPDATE", "TRUNCATE", "CREATE", "ALTER", "GRANT", "REVOKE",
    "EXEC", "EXECUTE", "CALL", "COPY", "pg_sleep", "pg_read_file",
)
_FORBIDDEN = re.compile(r"\b(?:" + "|".join(FORBIDDEN_WORDS) + r")\b", re.IGNORECASE)


class SpecError(ValueError):
    """The description of a job is not valid."""


@dataclass(frozen=True)
class ColumnSpec:
    """Keep (or drop) one raw column, give it a type and a name."""

    name: str
    type: str = "TEXT"
    output_name: str = ""
    include: bool = True

    @property
    def source(self) -> str:
        return safe_name(self.name)

    @property
    def output(self) -> str:
        return safe_name(self.output_name or self.name)

    @property
    def kind(self) -> str:
        """The type name; an unknown one counts as TEXT."""
        return self.type if self.type in COLUMN_TYPES else "TEXT"


@dataclass(frozen=True)
class FilterSpec:
    """One condition on the cleaned columns; several are joined by AND."""

    column: str
    operator: str = "="
    value: str = ""

    def __post_init__(self):
        if not self.column.strip():
            raise SpecError("a filter needs a column")
        if self.operator not in FILTER_OPERATORS:
            raise SpecError(f"unknown filter operator {self.operator!r}; use one of {FILTER_OPERATORS}")


@dataclass(frozen=True)
class JoinSpec:
    """Join another raw table on one pair of columns, compared as text.

    ``salt`` > 1 spreads a hot key of the row-keeping side (the base table, or the joined one for
    RIGHT) over that many tasks; the other side is copied ``salt`` times. The result is unchanged.
    """

    table: str
    left_col: str
    right_col: str
    join_type: str = "LEFT"
    alias: str = ""
    salt: int = 0

    def __post_init__(self):
        if not (self.table.strip() and self.left_col.strip() and self.right_col.strip()):
            raise SpecError("a join needs a table and a column on both sides")
        if self.how not in JOIN_TYPES:
            raise SpecError(f"unknown join type {self.join_type!r}; use one of {JOIN_TYPES}")
        if self.salt < 0:
            raise SpecError("salt must not be negative")

    @property
    def how(self) -> str:
        return self.join_type.upper()

    @property
    def name(self) -> str:
        """The name expressions use for this side."""
        return safe_name(self.alias or self.table)


@dataclass(frozen=True)
class ComputedSpec:
    """A further output column from a Spark SQL expression.

    ``over="raw"`` sees the raw text columns; ``over="typed"`` sees the base table's columns with
    the types of their ``ColumnSpec`` (numbers unrounded). Joined tables are reached as ``t.col``.
    """

    name: str
    expression: str
    over: str = "raw"

    def __post_init__(self):
        if not (self.name.strip() and self.expression.strip()):
            raise SpecError("a computed column needs a name and an expression")
        if self.over not in ("raw", "typed"):
            raise SpecError("over must be 'raw' or 'typed'")
        word = _FORBIDDEN.search(self.expression)
        if word:
            raise SpecError(f"computed column {self.name!r} uses the forbidden word {word.group(0)!r}")

    @property
    def output(self) -> str:
        return safe_name(self.name)


@dataclass(frozen=True)
class MetricSpec:
    """One aggregate over the cleaned table; COUNT of ``*`` or of nothing counts rows."""

    column: str
    fn: str
    output_name: str = ""

    def __post_init__(self):
        if self.function not in AGGREGATES:
            raise SpecError(f"unknown aggregate {self.fn!r}; use one of {AGGREGATES}")
        if self.column.strip() in ("", "*") and self.function != "COUNT":
            raise SpecError(f"{self.function} needs a column")

    @property
    def function(self) -> str:
        return self.fn.upper()

    @property
    def counts_rows(self) -> bool:
        return self.column.strip() in ("", "*")

    @property
    def output(self) -> str:
        if self.output_name:
            return safe_name(self.output_name)
        if self.counts_rows:
            return "row_count"
        return f"{safe_name(self.column)}_{self.function.lower()}"


@dataclass(frozen=True)
class TableSpec:
    """Everything that turns one raw table into a clean and, with metrics, an aggregated one."""

    table: str
    columns: Sequence[ColumnSpec] = ()
    filters: Sequence[FilterSpec] = ()
    joins: Sequence[JoinSpec] = ()
    computed: Sequence[ComputedSpec] = ()
    group_by: Sequence[str] = ()
    metrics: Sequence[MetricSpec] = ()

    def __post_init__(self):
        if not self.table.strip():
            raise SpecError("a table needs a name")
        _no_repeats([self.name, *(j.name for j in self.joins)], "table name (give the join an alias)")
        _no_repeats([c.source for c in self.columns], "source column")
        _no_repeats([c.output for c in self.kept] + [c.output for c in self.computed], "output column")
        _no_repeats([safe_name(g) for g in self.group_by] + [m.output for m in self.metrics], "analytics column")

    @property
    def name(self) -> str:
        return safe_name(self.table)

    @property
    def kept(self) -> list[ColumnSpec]:
        return [c for c in self.columns if c.include]

    @classmethod
    def from_dict(cls, config: Mapping) -> "TableSpec":
        """Build a spec from the JSON form of a saved cleaning job."""
        renamed = {"computed" if k == "computed_cols" else k: v for k, v in config.items()}
        parts = {"columns": ColumnSpec, "filters": FilterSpec, "joins": JoinSpec,
                 "computed": ComputedSpec, "metrics": MetricSpec}
        _known(cls, renamed)
        return cls(**{
            key: tuple(_make(parts[key], item) for item in value) if key in parts else value
            for key, value in renamed.items()
        })


@dataclass(frozen=True)
class JobSpec:
    """Several tables of one run; ``custom_sql`` replaces what the tables would generate."""

    tables: Sequence[TableSpec]
    custom_sql: str | None = None

    def __post_init__(self):
        if not self.tables:
            raise SpecError("a job needs at least one table")
        _no_repeats([t.name for t in self.tables], "table")

    @classmethod
    def from_dict(cls, config: Mapping) -> "JobSpec":
        _known(cls, config)
        return cls(tuple(TableSpec.from_dict(t) for t in config.get("tables", ())), config.get("custom_sql"))


def _known(kind, config: Mapping) -> None:
    unknown = set(config) - {f.name for f in fields(kind)}
    if unknown:
        raise SpecError(f"unknown {kind.__name__} keys: {sorted(unknown)}")


def _make(kind, config: Mapping):
    _known(kind, config)
    try:
        return kind(**config)
    except TypeError as error:
        raise SpecError(f"{kind.__name__}: {error}") from None


def _no_repeats(names: Sequence[str], what: str) -> None:
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SpecError(f"duplicate {what}: {', '.join(twice)}")
