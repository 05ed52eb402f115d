"""Bounded looks at the head of a table, in a stated row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.cells import strip_cell

# How many rows a preview holds, and how many rows are searched for example values.
PREVIEW_ROWS = 1000
SAMPLE_ROWS = 50
SAMPLE_VALUES = 3


def file_order() -> list[Column]:
    """The order of rows in the files read: by file, by split, then by row within the split.

    Only for a DataFrame that comes straight from a file scan.
    """
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def preview(df: DataFrame, order_by: list[Column], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, each with the table's ``total_rows`` and whether rows were left out (``sampled``).

    Every task keeps only its own first rows. Both totals are scalar subqueries, which Spark answers
    from one count; a single projection on top lets the sort and limit plan as a top-k.
    """
    count = F.count(F.lit(1))
    total, more = df.agg(count.alias("n")).scalar(), df.agg((count > rows).alias("more")).scalar()
    head = _ordered(df, order_by).limit(rows)
    return head.select(*[F.col(f"`{c}`") for c in df.columns], total.alias("total_rows"), more.alias("sampled"))


def sample_arrays(df: DataFrame, order_by: list[Column] | None, rows: int = SAMPLE_ROWS,
                  values: int = SAMPLE_VALUES) -> DataFrame:
    """One row; per column the first non-empty values among the first rows, in order."""
    head = _ordered(df, order_by or file_order()).limit(rows)

    def first_values(name: str) -> str:
        cell = strip_cell(f"cast(`{name}` as string)")
        pairs = f"collect_list(if({cell} is null, null, struct(_millrace_order, {cell} as cell)))"
        return f"slice(transform(array_sort({pairs}), p -> p.cell), 1, {values}) as `{name}`"

    return head.selectExpr(*[first_values(c) for c in df.columns])


def column_samples(df: DataFrame, order_by: list[Column] | None = None, rows: int = SAMPLE_ROWS,
                   values: int = SAMPLE_VALUES) -> DataFrame:
    """``(ordinal, column, samples)`` for every column."""
    arrays = sample_arrays(df, order_by, rows, values)
    pairs = ", ".join(f"struct({i} as ordinal, '{c}' as column, `{c}` as samples)" for i, c in enumerate(df.columns))
    return arrays.selectExpr(f"inline(array({pairs}))")


def _ordered(df: DataFrame, order_by: list[Column]) -> DataFrame:
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_by)])
    return df.withColumn("_millrace_order", order).orderBy("_millrace_order")
