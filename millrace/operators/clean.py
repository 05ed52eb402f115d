"""The clean projection: join, type, rename, compute, then filter what came out.

Every step is a list of SQL expressions, so that a spec runs as a DataFrame (``clean``) and, with the same
expressions, as the text of a view over the catalog (``clean_sql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.functions.casts import typed
from millrace.functions.cells import is_stripped
from millrace.functions.names import safe_name
from millrace.operators.filters import condition_sql
from millrace.operators.joins import Tables, join_chain, table_of
from millrace.session import is_ansi
from millrace.spec import ColumnSpec, ComputedSpec, SpecError, TableSpec

_OUT = "_millrace_out_"
_HIDDEN = "_millrace_by_"

#: (SQL expression, name) for each column that a step selects.
Step = list[tuple[str, str]]


def clean(spec: TableSpec, tables: Tables) -> DataFrame:
    """The clean table of ``spec``, lazily, over raw tables given by name."""
    result, _, hidden = _projected(spec, tables)
    conditions = _conditions(spec, result.schema, hidden, is_ansi(result.sparkSession))
    return result.filter(" and ".join(conditions)).drop(*hidden) if conditions else result


def clean_sql(spec: TableSpec, tables: Tables, layer: str = "raw") -> str:
    """The clean table of ``spec`` as one SELECT over ``<layer>.<table>``; ``tables`` only gives their columns.

    ``JoinSpec.salt`` spreads work and changes no row; here it is left to adaptive execution.
    """
    result, steps, hidden = _projected(spec, tables)
    body, source = f"select * from {_joins_sql(spec, layer)}", _joins_sql(spec, layer)
    for step in steps:
        body = f"select {', '.join(f'{e} as `{name}`' for e, name in step)} from {source}"
        source = f"({body}) as `{spec.name}`"
    conditions = _conditions(spec, result.schema, hidden, is_ansi(result.sparkSession))
    if not conditions:
        return body
    names = ", ".join(f"`{c}`" for c in result.columns if c not in hidden)
    return f"select {names} from ({body}) where {' and '.join(conditions)}"


def _projected(spec: TableSpec, tables: Tables) -> tuple[DataFrame, list[Step], dict[str, ColumnSpec]]:
    """What the steps make of the joined tables, the steps, and the hidden columns that filters need."""
    base = table_of(tables, spec.table)
    result = join_chain(base, spec.name, list(spec.joins), tables)
    if not spec.kept and not spec.computed:
        return _everything(result), [], {}
    hidden = _hidden_filters(spec, base)
    steps = _steps(spec, _Typing(base, spec), hidden)
    for step in steps:
        result = result.alias(spec.name) if step is not steps[0] else result
        result = result.select(*[F.expr(e).alias(name) for e, name in step])
    return result, steps, hidden


def _joins_sql(spec: TableSpec, layer: str) -> str:
    parts = [f"{layer}.`{spec.name}` as `{spec.name}`"]
    for j in spec.joins:
        left, right = f"`{spec.name}`.`{safe_name(j.left_col)}`", f"`{j.name}`.`{safe_name(j.right_col)}`"
        parts.append(f"{j.how} join {layer}.`{safe_name(j.table)}` as `{j.name}` on cast({left} as string) = cast({right} as string)")
    return " ".join(parts)


class _Typing:
    """Typed expressions for the base table's columns."""

    def __init__(self, base: DataFrame, spec: TableSpec):
        self.ansi = is_ansi(base.sparkSession)
        self.table = spec.name
        self.fields = {f.name.lower(): f for f in base.schema.fields}
        self.specs = {c.source: c for c in spec.columns}

    def column(self, column: ColumnSpec, rounded: bool = True) -> str:
        field = self.fields.get(column.source)
        if field is None:
            raise SpecError(f"table {self.table!r} has no column {column.source!r}")
        return typed(f"`{self.table}`.`{column.source}`", column.kind, ansi=self.ansi, rounded=rounded,
                     trimmed=is_stripped(field))

    def scope(self) -> Step:
        """Every base column under its own name, typed where the spec gives a type."""
        return [
            (self.column(self.specs[name], rounded=False) if name in self.specs else f"`{self.table}`.`{name}`", name)
            for name in self.fields
        ]


def _steps(spec: TableSpec, types: _Typing, hidden: dict[str, ColumnSpec]) -> list[Step]:
    """One step, or with expressions over typed columns two: first the typed columns, then those expressions.

    Finished columns wait under private names, and each joined table becomes one struct, so that an
    expression finds ``col`` typed and ``t.col`` as it is. Catalyst folds both steps into one.
    """
    carried = [(types.column(c), name) for name, c in hidden.items()]
    if all(c.over == "raw" for c in spec.computed):
        columns = [(types.column(c), c.output) for c in spec.kept]
        return [[*columns, *[(f"({c.expression})", c.output) for c in spec.computed], *carried]]

    finished = [(types.column(c), f"{_OUT}{c.output}") for c in spec.kept]
    finished += [(f"({c.expression})", f"{_OUT}{c.output}") for c in spec.computed if c.over == "raw"]
    sides = [(f"struct(`{j.name}`.*)", j.name) for j in spec.joins]

    def output(column: ColumnSpec | ComputedSpec) -> tuple[str, str]:
        if isinstance(column, ComputedSpec) and column.over == "typed":
            return f"({column.expression})", column.output
        return f"`{_OUT}{column.output}`", column.output

    last = [*[output(c) for c in [*spec.kept, *spec.computed]], *[(f"`{name}`", name) for name in hidden]]
    return [[*types.scope(), *sides, *finished, *carried], last]


def _hidden_filters(spec: TableSpec, base: DataFrame) -> dict[str, ColumnSpec]:
    """Dropped source columns that a filter still needs, by the private name that carries them."""
    outputs = {c.output for c in spec.kept} | {c.output for c in spec.computed}
    kept_sources = {c.source for c in spec.kept}
    by_source = {c.source: c for c in spec.columns}
    in_base = {name.lower() for name in base.columns}
    hidden = {}
    for condition in spec.filters:
        name = safe_name(condition.column)
        if name in outputs or name in kept_sources:
            continue
        if name not in in_base:
            raise SpecError(f"filter on unknown column {condition.column!r}")
        hidden[f"{_HIDDEN}{name}"] = by_source.get(name, ColumnSpec(name))
    return hidden


def _conditions(spec: TableSpec, schema: StructType, hidden: dict[str, ColumnSpec], ansi: bool) -> list[str]:
    types = {f.name: f.dataType for f in schema.fields}
    renamed = {c.source: c.output for c in spec.kept}
    conditions = []
    for condition in spec.filters:
        name = safe_name(condition.column)
        for candidate in (name, renamed.get(name), f"{_HIDDEN}{name}"):
            if candidate in types:
                conditions.append(f"({condition_sql(condition, f'`{candidate}`', types[candidate], ansi=ansi)})")
                break
        else:
            raise SpecError(f"filter on unknown column {condition.column!r}")
    return conditions


def _everything(joined: DataFrame) -> DataFrame:
    names = [c.lower() for c in joined.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SpecError(f"nothing is selected and the joined tables share columns: {', '.join(twice)}")
    return joined
