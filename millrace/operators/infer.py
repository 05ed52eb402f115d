"""Find the narrowest type that every value of a column fits, for all columns in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.cells import as_text, normalize_cells

# The types in order of precedence, each with its bit, and what a value must look like.
BITS = {"INTEGER": 1, "NUMERIC": 2, "DATE": 4, "TIMESTAMP": 8, "BOOLEAN": 16}
INTEGER = r"^-?\d+$"
NUMERIC = r"^-?\d+\.?\d*$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")


def fitting_types(value: str) -> str:
    """SQL for the set of types one stripped value fits, as bits; NULL for NULL.

    Every integer is a number and nothing else overlaps but ``0`` and ``1``, so the first match
    decides. Patterns are the expensive part: byte comparisons keep words away from all of them, and
    the dash in fifth place tells dates and times from numbers.
    """
    number = BITS["INTEGER"] | BITS["NUMERIC"]
    words = ", ".join(f"'{w}'" for w in BOOLEAN_WORDS)
    longest = max(map(len, BOOLEAN_WORDS))
    return f"""case
        when {value} is null then cast(null as int)
        when {value} < '-' or {value} >= ':' then
            case when octet_length({value}) > {longest} then 0
                 when lower({value}) in ({words}) then {BITS['BOOLEAN']} else 0 end
        when substring({value}, 5, 1) = '-' then
            case when {value} rlike r'{DATE}' then {BITS['DATE']}
                 when {value} rlike r'{TIMESTAMP}' then {BITS['TIMESTAMP']} else 0 end
        when {value} rlike r'{INTEGER}' then
            case when {value} in ('0', '1') then {number | BITS['BOOLEAN']} else {number} end
        when {value} rlike r'{NUMERIC}' then {BITS['NUMERIC']}
        else 0 end"""


def infer_types(df: DataFrame, order_by: list[Column] | None = None, sample_values: int | None = None) -> DataFrame:
    """``(ordinal, column, type)`` for every column of a text table.

    All rows are looked at. ``sample_values`` looks only at that many non-empty values among the
    first 50 rows in ``order_by``, as ``column_samples`` returns them.
    """
    if sample_values is not None:
        from millrace.operators.sample import sample_arrays

        arrays = sample_arrays(df, order_by, values=sample_values)
        masks = arrays.selectExpr(*[
            f"aggregate(transform(`{c}`, v -> {fitting_types('v')}), cast(null as int), "
            f"(common, bits) -> coalesce(common & bits, bits)) as `{c}`"
            for c in df.columns
        ])
        return _by_column(masks, df.columns)
    # One row per cell and one expression for all of them, so that the generated code does not grow with the columns.
    # The second table gives each column a row, also where the first has none.
    cells = normalize_cells(as_text(df))
    each = ", ".join(f"`{c}`" for c in df.columns)
    values = cells.selectExpr(f"posexplode(array({each})) as (ordinal, cell)").selectExpr("ordinal", f"{fitting_types('cell')} as bits")
    none = df.sparkSession.range(len(df.columns)).selectExpr("int(id) as ordinal", "cast(null as int) as bits")
    masks = values.unionByName(none).groupBy("ordinal").agg(F.bit_and("bits").alias("bits"))
    names = ", ".join(f"'{c}'" for c in df.columns)
    return masks.selectExpr("ordinal", f"element_at(array({names}), ordinal + 1) as column", f"{type_of_bits('bits')} as type").orderBy("ordinal")


def _by_column(masks: DataFrame, names: list[str]) -> DataFrame:
    rows = ", ".join(f"struct({i} as ordinal, '{n}' as column, {type_of_bits(f'`{n}`')} as type)"
                     for i, n in enumerate(names))
    return masks.selectExpr(f"inline(array({rows}))")


def type_of_bits(mask: str) -> str:
    """SQL for the type that a set of bits stands for."""
    chosen = " ".join(f"when {mask} & {bit} != 0 then '{name}'" for name, bit in BITS.items())
    return f"case when {mask} is null then 'TEXT' {chosen} else 'TEXT' end"
