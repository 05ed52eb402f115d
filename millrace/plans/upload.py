"""From CSV files to a stored raw table with a profile of its columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.cells import normalize_cells
from millrace.functions.names import safe_name
from millrace.operators.infer import infer_types
from millrace.operators.sample import SAMPLE_ROWS, column_samples
from millrace.sinks.export import export_csv
from millrace.sinks.tables import replace_raw
from millrace.sources.csv import PROVENANCE, read_raw, scan_csv
from millrace.sources.files import as_pattern, list_files


@dataclass(frozen=True)
class Upload:
    """``columns`` has ``(ordinal, column, type, samples)``; ``sampled`` says that rows were left out.

    ``snapshot`` is the folder with the stored rows as CSV, if one was asked for.
    """

    table: str
    raw: DataFrame
    columns: DataFrame
    rows: int
    total_rows: int
    snapshot: str | None = None

    @property
    def sampled(self) -> bool:
        return self.rows < self.total_rows


def load_csv(spark: SparkSession, path: str | Sequence[str], table: str, dest: str, *, as_of: datetime | None = None,
             first_rows: int | None = None, sample_values: int | None = None, multi_line: bool | None = None,
             snapshot_to: str | None = None) -> Upload:
    """Store all rows of ``path`` as the raw table at ``dest/<table>`` and profile them.

    ``first_rows`` stores only that many, from the head of the files in path order. Types are inferred
    over all stored rows, or over ``sample_values`` values at the head. No data rows is an error,
    and so is a row with more cells than the header.
    ``snapshot_to`` also keeps the stored rows as CSV below that folder, under the time of the load.
    """
    name = safe_name(table)
    head = _head(spark, path, max(SAMPLE_ROWS, first_rows or 0), multi_line is not False)
    if head is None:
        raise ValueError(f"no data rows under {path}")
    order = [F.col("_row")]
    if first_rows is None:
        rows = read_raw(spark, path, multi_line=multi_line)
    else:
        rows = head.filter(F.col("_row") < first_rows).drop("_row")
    raw = replace_raw(rows, f"{dest.rstrip('/')}/{name}", as_of)
    text = raw.drop("uploaded_at")
    stored = raw.count()
    total = stored if first_rows is None else scan_csv(spark, path, multi_line=multi_line).count()

    hidden = F.col("column") != "_row"
    samples = column_samples(head, order).filter(hidden)
    types = infer_types(text) if sample_values is None else infer_types(head, order, sample_values).filter(hidden)
    columns = types.join(samples, ["ordinal", "column"]).orderBy("ordinal")
    at = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    snapshot = None if snapshot_to is None else export_csv(text, snapshot_to, name, at)
    return Upload(name, raw, columns, stored, total, snapshot)


def _head(spark: SparkSession, path: str | Sequence[str], rows: int, multi_line: bool) -> DataFrame | None:
    """The first rows of the files in path order, numbered; None if there are none.

    One file in one task keeps its order under ``limit``, and is read no further. Only if the first
    file has too few rows are more files looked at, ever more at once, as many files of a folder may
    have none.
    """
    files = list_files(spark, path, recursive=False)
    if files.isEmpty():
        raise FileNotFoundError(f"no files under {path}")
    files = files.filter("length > 0").orderBy("path")
    parts, found, seen, many = [], 0, 0, 1
    while found < rows:
        paths = [r["path"] for r in files.offset(seen).limit(many).select("path").collect()]
        if not paths:
            break
        scan = scan_csv(spark, [as_pattern(p) for p in paths], multi_line=multi_line, provenance=len(paths) > 1)
        if len(paths) == 1:
            part = normalize_cells(scan).withColumn("_row", found + F.monotonically_increasing_id()).limit(rows - found)
        else:
            place = F.struct("source_path", F.monotonically_increasing_id().alias("at"))
            first = scan.withColumn("_row", place).orderBy("_row").limit(rows - found)
            number = found - 1 + F.row_number().over(Window.orderBy("_row")).cast("bigint")
            cells = scan.columns[:-len(PROVENANCE)]
            part = normalize_cells(first.select(*cells, number.alias("_row")), cells)
        if n := part.count():
            parts.append(part)
        found, seen, many = found + n, seen + len(paths), many * 8
    return reduce(DataFrame.unionByName, parts) if parts else None
