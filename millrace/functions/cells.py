"""Raw text cells: surrounding whitespace is not data, and an empty cell is NULL."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField

# Every character that counts as whitespace around a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)

#: Column metadata that marks text as already stripped. Parquet files and catalog tables keep it, so
#: a later TEXT projection needs no trim and its filters can reach the scan.
STRIPPED = {"millrace.stripped": True}


def strip_cell(cell: str) -> str:
    """SQL for the stripped content of the SQL expression ``cell``."""
    return f"nullif(btrim({cell}, '{WHITESPACE}'), '')"


def is_stripped(field: StructField) -> bool:
    return bool(field.metadata.get("millrace.stripped"))


def normalize_cells(df: DataFrame, columns: Collection[str] | None = None) -> DataFrame:
    """Strip every text column (or those named) and turn empty cells into NULL, in one projection."""
    cells = {f.name for f in df.schema.fields if _is_cell(f) and (columns is None or f.name in columns)}
    if not cells:
        return df
    return df.select(*[
        F.expr(strip_cell(f"`{f.name}`")).alias(f.name, metadata={**f.metadata, **STRIPPED})
        if f.name in cells else f"`{f.name}`" for f in df.schema.fields
    ])


def _is_cell(field: StructField) -> bool:
    return isinstance(field.dataType, StringType) and not is_stripped(field)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: the raw layer's form of a typed table. Text columns stay as they are."""
    return df.selectExpr(*[
        f"`{f.name}`" if isinstance(f.dataType, StringType) else f"cast(`{f.name}` as string) as `{f.name}`"
        for f in df.schema.fields
    ])
