"""CSV files as raw text tables.

Quoted cells may hold line breaks, so Spark's reader takes such a file from its start, in one task. The lines are looked at
first, in splits: when each is a whole record, the files are read in plain splits; otherwise their records are put together
from the splits. Neither depends on the size of the files.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.cells import normalize_cells
from millrace.functions.names import safe_names
from millrace.sources.files import as_pattern, decoded_path, file_name, list_files
from millrace.sources.records import WHOLE_RECORD, assemble_records, parse_records, refuse_surplus, split_lines, surplus_of

# The dialect, comma-separated UTF-8 with doubled quotes; every cell is text.
DIALECT = {"sep": ",", "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}

#: The column in which Spark's reader puts the text of a record that has not as many cells as the header.
RECORD = "_millrace_record"

#: The column with the text of cells beyond the header, if they are kept.
SURPLUS = "surplus_cells"

#: Lines that a header may have.
HEADER_LINES = 100

#: The column that says where a record came from, under a name that no header gives.
PLACE = "_millrace_place"

PROVENANCE = ("source_path", "source_name", "source_modified_at")


def scan_csv(spark: SparkSession, path: str | Sequence[str], *, glob: str | None = None, recursive: bool = False,
             multi_line: bool | None = None, provenance: bool = False, surplus: str = "raise", header: Sequence[str | None] | None = None) -> DataFrame:
    """All rows of the CSV files under ``path``: normalised column names, text cells as written.

    The header of the first file, or the one given, names the columns; a file with another header is an error. Short
    rows are filled with NULL. A row with cells beyond the header fails the job by the name of its file; ``surplus="keep"`` adds
    a column SURPLUS with the text of these cells instead, NULL for all other rows, and ``"drop"`` leaves them out.
    ``multi_line`` looks at the lines when None; False promises that no cell holds a line break, True reads each file in one task.
    ``provenance`` adds where each row came from.
    """
    if surplus not in ("drop", "raise", "keep"):
        raise ValueError(f"surplus is raise, keep or drop, not {surplus}")
    header = list(header) if header is not None else first_header(spark, path, glob, recursive)
    names, n = safe_names(header), len(header)
    if surplus == "keep" and SURPLUS in names:
        raise ValueError(f"the files have a column {SURPLUS!r} of their own")
    where = {"recursiveFileLookup": recursive, **({"pathGlobFilter": glob} if glob else {})}
    added = (PROVENANCE if provenance else ()) + ((SURPLUS,) if surplus == "keep" else ())
    if multi_line is None and has_split_records(spark, path, **where):
        schema = StructType([StructField(name, StringType()) for name in names])
        records = assemble_records(spark, path, **where)
        if surplus == "raise":
            records = refuse_surplus(records, F.col("record"), decoded_path(F.col("file")), n)
        rows = parse_records(records, header, schema, DIALECT)
        file = decoded_path(F.col("file"))
        source, record = [file, file_name(file), F.col("modified_at")], F.col("record")
        cells = [F.col(f"cells.`{name}`") for name in names]
    else:
        schema = StructType([StructField(h or "", StringType()) for h in header])
        reader = spark.read.options(**DIALECT, **where)
        reader = reader.schema(schema) if surplus == "drop" else with_record(reader, schema)
        rows = reader.csv(path, header=True, multiLine=bool(multi_line), enforceSchema=False)
        if surplus != "drop":
            rows = whole_records(rows)
        if surplus == "raise":
            rows = refuse_surplus(rows, F.col(RECORD), decoded_path(F.col("_metadata.file_path")), n)
        source = [decoded_path(F.col("_metadata.file_path")), decoded_path(F.col("_metadata.file_name")),
                  F.col("_metadata.file_modification_time")]
        cells, record = [F.col(f"`{c}`") for c in rows.columns[:n]], F.col(RECORD)
    beyond = [surplus_of(record, n)] if surplus == "keep" else []
    return rows.select(*cells, *[c.alias(name) for c, name in zip([*(source if provenance else []), *beyond], added)]).toDF(*names, *added)


def read_raw(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """``scan_csv`` with stripped cells, empty ones as NULL: the content of a raw table."""
    scan = scan_csv(spark, path, **options)
    added = len(PROVENANCE) * bool(options.get("provenance")) + (options.get("surplus") == "keep")
    return normalize_cells(scan, scan.columns[:len(scan.columns) - added])


_FITS = "_millrace_fits"


@dataclass(frozen=True)
class Stored:
    """``raw`` has the rows that fit the header; ``rejects`` the others: file, line, cells, and the text of the cells beyond.

    ``rows`` and ``rejected`` are their numbers, counted while they were written.
    """

    raw: DataFrame
    rejects: DataFrame
    rows: int
    rejected: int


def store_csv(spark: SparkSession, path: str | Sequence[str], dest: str, *, glob: str | None = None, recursive: bool = False) -> Stored:
    """Store the CSV files under ``path`` below ``dest``: rows that fit, and beside them rows with more cells than the header.

    Both are written in one pass over the text. ``line`` is the line of the file on which a rejected row begins, from 1 on. A second look
    at the files, only if there are rejects, counts the lines of each split.
    """
    header = first_header(spark, path, glob, recursive)
    names, n = safe_names(header), len(header)
    where = {"recursiveFileLookup": recursive, **({"pathGlobFilter": glob} if glob else {})}
    beyond = surplus_of(F.col(f"{PLACE}.record"), n)
    place = F.struct(F.col(f"{PLACE}.file"), F.col(f"{PLACE}.block"), F.col(f"{PLACE}.first"), beyond.alias("surplus")).alias(PLACE)
    cells = scan_records(spark, path, header, names, **where).select(*[f"`{c}`" for c in names], place, beyond.isNull().alias(_FITS))
    watch = Observation()
    counted = normalize_cells(cells, names).observe(watch, F.count_if(_FITS).alias("rows"), F.count_if(~F.col(_FITS)).alias("rejected"))
    counted.write.mode("error").partitionBy(_FITS).parquet(dest)
    stored = spark.read.schema(counted.schema).parquet(dest)
    kept = [f"`{c}`" for c in names]
    raw, rejects = stored.filter(_FITS).select(*kept), stored.filter(~F.col(_FITS))
    lines = split_lines(spark, path, **where) if watch.get["rejected"] else spark.createDataFrame([], "file string, block long, before long")
    lines = lines.select(F.struct("file", "block").alias("_millrace_split"), F.col("before").alias("_millrace_before"))
    split = F.struct(F.col(f"{PLACE}.file"), F.col(f"{PLACE}.block"))
    rejects = rejects.withColumn("_millrace_split", split).join(lines, "_millrace_split", "left").select(
        decoded_path(F.col(f"{PLACE}.file")).alias("source_path"), (F.col("_millrace_before") + F.col(f"{PLACE}.first")).alias("line"), *kept,
        F.col(f"{PLACE}.surplus").alias(SURPLUS))
    return Stored(raw, rejects, watch.get["rows"], watch.get["rejected"])


def scan_records(spark: SparkSession, path: str | Sequence[str], header: Sequence[str | None], names: Sequence[str], **where) -> DataFrame:
    """The cells of all records, put together in splits, with PLACE: file, block, n (records of the split so far), first (line of the split), record."""
    schema = StructType([StructField(name, StringType()) for name in names])
    rows = parse_records(assemble_records(spark, path, **where), header, schema, DIALECT)
    return rows.select(*[F.col(f"cells.`{c}`").alias(c) for c in names], F.struct("file", "block", "n", "first", "record").alias(PLACE))


def with_record(reader, schema: StructType):
    """A batch or stream reader of ``schema`` and the record of each row that has more or fewer cells."""
    return reader.schema(StructType([*schema.fields, StructField(RECORD, StringType())])).option("columnNameOfCorruptRecord", RECORD)


def whole_records(rows: DataFrame) -> DataFrame:
    """The rows of such a reader, with the records whatever columns are asked for later."""
    # Spark compares only the cells that a query asks for, so this asks for all; nothing of the hash is added.
    record = F.concat(F.col(RECORD), F.substring(F.hash("*").cast("string"), 1, 0))
    return rows.withColumn(RECORD, F.when(F.col(RECORD).isNotNull(), record))


def has_split_records(spark: SparkSession, path: str | Sequence[str], **options) -> bool:
    """Whether some line is not a whole record."""
    return not spark.read.options(**options).text(path).filter(~F.col("value").rlike(WHOLE_RECORD)).isEmpty()


def first_header(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = True) -> list[str | None]:
    """The header of the first file by path."""
    first = list_files(spark, path, glob=glob, recursive=recursive).agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        raise FileNotFoundError(f"no files under {path}")
    return _header(spark, first)


def _header(spark: SparkSession, file: str) -> list[str | None]:
    """The cells of a file's first record, of which only the first lines are read."""
    lines = spark.read.option("lineSep", "\n").text(as_pattern(file)).limit(HEADER_LINES).collect()
    record = None
    for line in (r["value"].removeprefix("\ufeff") if i == 0 else r["value"] for i, r in enumerate(lines)):
        if record is None and not line.strip():
            continue
        record = line if record is None else f"{record}\n{line}"
        if re.match(WHOLE_RECORD, record.removesuffix("\r")):
            cells = next(csv.reader(io.StringIO(record.removesuffix("\r"), newline="")))
            return [c or None for c in cells]
    raise ValueError(f"no header in {file}")
