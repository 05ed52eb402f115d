"""CSV files with line breaks inside quoted cells, read in parallel splits.

Whether a line starts inside a quoted cell depends on all lines before it in the file. Each line says how it would end if
it started outside a cell, and if it started inside one. A first pass puts these answers together to one small row per split;
carried over the splits of a file they tell which splits start inside a cell. The second pass puts the lines of each split together to
records, one line after the other as they are read, so nothing is sorted and no text is shuffled but the pieces of records that
cross from one split to the next.

Both passes go along the lines of a split in Python, as no built-in expression keeps a state from row to row without a sort; what each line
says is found by built-in expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

# The functions go to the executors by value; these need Python with numpy and pyarrow, but not this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A cell is quoted if it begins with a quote, and then ends with the next quote that is not doubled; text after
# that, up to the comma, and quotes in other cells are plain text. Possessive, so that a long line costs one pass.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_CELL = rf'(?:"{_QUOTED}|[^",][^,]*+|)'
#: A line that ends outside a cell, if it starts outside one and if it starts inside one.
WHOLE_RECORD = f"^{_CELL}(?:,{_CELL})*+$"
CLOSING = f"^{_QUOTED}(?:,{_CELL})*+$"


def longer_than(n: int) -> str:
    """A record of more than ``n`` cells."""
    return rf"^{_CELL}(?:,{_CELL}){{{n}}}+"


#: A record that is longer raises: Spark cannot hold much longer texts.
LONGEST_RECORD = 2**30

_PIECE = "file string, modified_at timestamp, block long, n long, first long, record string, crosses boolean, open boolean"


def assemble_records(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """``(file, modified_at, block, n, first, record)``: every record of the files as one text, and the line of its split on which it begins."""
    quoted = F.contains("value", F.lit('"'))
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_block_start").alias("block"),
        (quoted & ~F.col("value").rlike(WHOLE_RECORD)).alias("open0"), (~(quoted & F.col("value").rlike(CLOSING))).alias("open1"), "value")
    inside, longest = _splits_inside(lines), LONGEST_RECORD

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n, line, first, state = None, 0, 0, 0, False
        waiting: list[pa.Array] = []  # lines of a record that is not whole yet

        def rows(numbers, firsts, records: pa.Array, is_open: bool) -> pa.RecordBatch:
            k = len(records)
            crosses = pa.array(np.asarray(numbers) == 0) if not is_open else pa.repeat(True, k)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(split[0], k), pa.repeat(split[1], k), pa.repeat(split[2], k), pa.array(numbers, pa.int64()), pa.array(firsts, pa.int64()), records,
                 crosses, pa.repeat(is_open, k)], ["file", "modified_at", "block", "n", "first", "record", "crosses", "open"])

        def ended(is_open: bool) -> pa.RecordBatch:
            # Before the first record of a split lies the end of one from an earlier split.
            lines = pa.concat_arrays(waiting)
            waiting.clear()
            return rows([n], [first], _joined_lines(lines, np.array([0, len(lines)])), is_open)

        for batch in batches:
            for begin, end in _same_split(batch, 0, 2):
                here = tuple(batch.column(i)[begin] for i in range(3))
                if split is None or here[0] != split[0] or here[2] != split[2]:
                    if waiting:
                        yield ended(True)
                    split, n, line = here, 0, 0
                    state = (here[0].as_py(), here[2].as_py()) in inside
                value = batch.column(5).slice(begin, end - begin)
                after = _states(*(batch.column(i).slice(begin, end - begin).to_numpy(zero_copy_only=False) for i in (3, 4)), state)
                before = np.concatenate(([state], after[:-1]))
                starts = np.flatnonzero(~before)
                head = int(starts[0]) if len(starts) else end - begin
                if head:
                    if not waiting:
                        first = line + 1
                    waiting.append(value.slice(0, head))
                    if sum(x.nbytes for x in waiting) > longest:
                        raise ValueError(f"a quoted cell is not closed, or too long, in {split[0]}")
                if waiting and len(starts):
                    yield ended(False)
                if len(starts):
                    whole = len(starts) - bool(after[-1])
                    bounds = np.append(starts, end - begin)
                    if whole:
                        yield rows(n + 1 + np.arange(whole), line + 1 + starts[:whole], _joined_lines(value, bounds[: whole + 1]), False)
                    n += len(starts)
                    if after[-1]:
                        first = line + 1 + int(starts[-1])
                        waiting.append(value.slice(int(starts[-1])))
                state = bool(after[-1])
                line += end - begin
                if waiting and not state:
                    yield ended(False)
        if waiting:
            yield ended(True)

    pieces = lines.mapInArrow(assemble, _PIECE)
    whole = pieces.filter("not crosses").drop("crosses", "open")

    # A piece that starts a record opens a new group; those without a start continue it.
    along = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = pieces.filter("crosses").withColumn("group", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(along))
    total = F.sum(F.length("record").cast("bigint")).over(Window.partitionBy("file", "group"))
    message = F.concat(F.lit("a quoted cell is not closed, or too long, in "), F.col("file"))
    bounded = crossing.withColumn("total", total).withColumn(
        "record", F.when(F.col("total") <= LONGEST_RECORD, F.col("record")).otherwise(F.raise_error(message).cast("string")))
    stitched = bounded.groupBy("file", "group").agg(
        F.max("modified_at").alias("modified_at"), F.min_by(F.struct("n", "first"), F.struct("block", "n")).alias("at"),
        F.min("block").alias("block"), _joined(F.struct("block", "n", F.col("record").alias("value"))).alias("record"))
    # Where lines end in CR LF, line breaks inside cells become LF, as Spark's own reader does it.
    unix = F.replace(F.expr("left(record, length(record) - 1)"), F.lit("\r\n"), F.lit("\n"))
    return whole.unionByName(stitched.select("file", "modified_at", "block", "at.*", "record")).select(
        "file", "modified_at", "block", "n", "first",
        F.when(F.endswith("record", F.lit("\r")), unix).otherwise(F.col("record")).alias("record"))


def _same_split(batch: pa.RecordBatch, file: int, block: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of one split."""
    names = batch.column(file).dictionary_encode().indices.to_numpy()
    blocks = batch.column(block).to_numpy()
    cuts = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]) if batch.num_rows else iter(())


def _states(open0: np.ndarray, open1: np.ndarray, start: bool) -> np.ndarray:
    """Whether the file is inside a cell after each line."""
    flips = np.cumsum(open0 & ~open1)
    fixes = np.where(open0 == open1, np.arange(len(open0)), -1)
    last = np.maximum.accumulate(fixes)
    at = np.maximum(last, 0)
    return np.where(last < 0, start + flips, open0[at] + flips - flips[at]) % 2 == 1


def _joined_lines(lines: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The lines from each bound to the next one as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines), "\n")


def split_lines(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """``(file, block, before)``: the lines of each file before each of its splits."""
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _splits_inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that start inside a cell, by file and first byte. The driver gets a row per such split, as it does for files."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            open0, open1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for begin, end in _same_split(batch, 0, 1):
                ends = found.setdefault((batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py()), [False, True])
                ends[:] = [bool(_states(open0[begin:end], open1[begin:end], s)[-1]) for s in ends]
        if found:
            rows = [(*k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "open0", "open1"])

    splits = lines.select("file", "block", "open0", "open1").mapInArrow(ends, "file string, block long, open0 boolean, open1 boolean")
    # A split that ends alike however it starts fixes the state; between such splits every other one either keeps or turns it.
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flips = F.sum(F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)).over(along)
    fixed = F.last(F.when(F.col("open0") == F.col("open1"), F.struct("open0", F.col("flips"))), ignorenulls=True).over(along)
    state = F.when(fixed.isNull(), F.col("flips") % 2).otherwise((fixed["open0"].cast("int") + F.col("flips") - fixed["flips"]) % 2)
    ended = splits.withColumn("flips", flips).withColumn("state", state)
    starts = ended.withColumn("inside", F.lag("state").over(Window.partitionBy("file").orderBy("block"))).filter("inside = 1")
    return {(r["file"], r["block"]) for r in starts.select("file", "block").collect()}


def parse_records(records: DataFrame, header: Sequence[str | None], schema: StructType, dialect: dict[str, str]) -> DataFrame:
    """``(cells, file, modified_at, block, n, first, record)`` of the data rows: without blank lines and each file's header, which must be ``header``."""
    parsed = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), dialect)
    cells = records.withColumn("cells", parsed)
    names = F.array(*[F.coalesce(F.col(f"cells.`{f.name}`"), F.lit("")) for f in schema.fields])
    message = F.concat(F.lit("the header of "), F.col("file"), F.lit(" differs from that of the first file"))
    same = F.when(names == F.array(*[F.lit(h or "") for h in header]), False).otherwise(F.raise_error(message).cast("boolean"))
    is_header = (F.col("block") == 0) & (F.col("n") == 1)
    rows = cells.filter(F.when(is_header, same).otherwise(F.trim("record") != ""))
    return rows.select("cells", "file", "modified_at", "block", "n", "first", "record")


def surplus_of(record: Column, n: int) -> Column:
    """The text of the cells of a record beyond the first ``n``, as written; NULL if there are none."""
    first = rf"^{_CELL}(?:,{_CELL}){{{n - 1}}},"
    return F.when(record.rlike(longer_than(n)), F.regexp_replace(record, first, ""))


def refuse_surplus(rows: DataFrame, record: Column, file: Column, n: int) -> DataFrame:
    """``rows``, of which one with a ``record`` of more than ``n`` cells fails the job by the name of its file."""
    message = F.concat(F.lit("a row has more cells than the header in "), file)
    return rows.filter(F.when(record.rlike(longer_than(n)), F.raise_error(message).cast("boolean")).otherwise(True))


def _joined(piece: Column) -> Column:
    ordered = F.array_sort(F.collect_list(piece))
    return F.array_join(F.transform(ordered, lambda p: p["value"]), "\n")
