"""JSON payloads of an API, landed as files or held in a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_payloads(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, *,
                  whole_document: bool = False, unreadable: str | None = None) -> DataFrame:
    """Landed JSON files: one record per line, or one document (or array of records) per file.

    A record that does not parse fails the job; ``unreadable`` names a column that keeps its text instead, and all others of the row are NULL.
    """
    schema, options = _with_text(schema, unreadable)
    return spark.read.schema(schema).options(**options).json(path, multiLine=whole_document)


def expand_payload(df: DataFrame, column: str, schema: StructType | str, *, unreadable: str | None = None) -> DataFrame:
    """Replace a JSON text column by the columns of ``schema``.

    Text that does not parse fails the job; ``unreadable`` names a column that keeps it instead, and the columns of ``schema`` are NULL.
    """
    schema, options = _with_text(schema, unreadable)
    parsed = F.from_json(F.col(column), schema, options)
    others = [c for c in df.columns if c != column]
    return df.select(*others, parsed.alias("_payload")).select(*others, "_payload.*")


def _with_text(schema: StructType | str, unreadable: str | None) -> tuple[StructType | str, dict[str, str]]:
    if unreadable is None:
        return schema, {"mode": "FAILFAST"}
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    if unreadable in [f.name for f in fields]:
        raise ValueError(f"the payload has a column {unreadable!r} of its own")
    return StructType([*fields, StructField(unreadable, StringType())]), {"columnNameOfCorruptRecord": unreadable}
