"""Extract only new rows by a high-water mark.

Rows are written to a folder of their own attempt. Then a commit file with the next number, which only one writer can create, makes
them part of the result and moves the mark: it holds the audit record and the new mark. A run that comes too late, as another one has
committed while it was writing, reads the newer mark and extracts again. So runs that overlap give each row once, and a run that dies or is
cancelled anywhere leaves either nothing that a reader sees, or a whole commit, and can simply be repeated.

The audit record is then appended to the ingestion log, where the reports read it; a run that dies between is logged by
the next one. Failed and cancelled runs are logged as such.

What follows from ``column > watermark``: rows with a NULL watermark are never extracted. Rows that arrive later with a time at or
below the mark are missed, unless ``overlap`` reads that much of the time before the mark again; what was extracted of it before is
left out, found by a digest of the rows. Marks are kept without zone; for a zoned column they are read in the session's zone, so keep
that at UTC.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from millrace.functions.times import time_literal
from millrace.operators.latest import latest_by, newest_first
from millrace.reports.metadata import INGESTION_LOG, append_row, compact_if_many, read_log
from millrace.sinks.commits import CommitLog, State

# Where the first run starts, and the default watermark column.
WATERMARK_INIT = "1970-01-01 00:00:00"
WATERMARK_COLUMN = "updated_at"

_SAFE_PART = re.compile(r"[A-Za-z0-9_.:-]+")


def current_watermarks(log: DataFrame) -> DataFrame:
    """``(pipeline_id, table_name, last_watermark, updated_at)``: the newest successful mark of each."""
    return latest_by(_marks(log), ["pipeline_id", "table_name"], ["updated_at", "last_watermark"])


def _marks(log: DataFrame) -> DataFrame:
    return log.filter((F.col("status") == "success") & F.col("watermark_to").isNotNull()).select(
        "pipeline_id", "table_name", F.col("watermark_to").alias("last_watermark"),
        F.col("extracted_at").alias("updated_at"),
    )


@dataclass(frozen=True)
class ExtractResult:
    rows: int
    watermark_from: datetime
    watermark_to: datetime | None
    path: str | None


@dataclass(frozen=True)
class IncrementalExtract:
    """One source table's extraction, with its landed data and its log."""

    pipeline_id: str
    table_name: str
    data_path: str
    log_path: str
    watermark_column: str = WATERMARK_COLUMN
    watermark_init: str = WATERMARK_INIT
    #: How much of the time before the mark is read again for rows that came late or have the time of the mark.
    overlap: timedelta | None = None

    def commits(self, spark: SparkSession) -> CommitLog:
        name = hashlib.sha256(f"{self.pipeline_id}\n{self.table_name}".encode()).hexdigest()[:16]
        return CommitLog(spark, f"{self.data_path.rstrip('/')}/_commits/{name}")

    def watermark(self, spark: SparkSession, state: State | None = None) -> datetime:
        """Where the next run starts."""
        state = state or self.commits(spark).state()
        marks = [e["mark"] for e in state.entries.values() if e["mark"]]
        if marks:
            return max(map(datetime.fromisoformat, marks))
        # A log from before there were commits; only this pipeline's part of it is read.
        row = newest_first(_marks(self.log(spark)), "updated_at", 1, (F.col("last_watermark").desc(),)).first()
        return row["last_watermark"] if row else datetime.fromisoformat(self.watermark_init)

    def log(self, spark: SparkSession) -> DataFrame:
        """The audit records; one that two runs have completed is there once."""
        log = read_log(spark, self.log_path, INGESTION_LOG)
        return log.filter((F.col("pipeline_id") == self.pipeline_id) & (F.col("table_name") == self.table_name)).distinct()

    def committed(self, spark: SparkSession, run_id: str) -> ExtractResult | None:
        """What a run that has succeeded under this id has committed; a repeated call answers with it and writes nothing."""
        return self._answer(self.commits(spark).state(), run_id)

    @staticmethod
    def _answer(state: State, run_id: str) -> "ExtractResult | None":
        entry = state.entries.get(run_id)
        if entry is None:
            return None
        row = _record(entry)
        return ExtractResult(row["rows_extracted"], row["watermark_from"], row["watermark_to"], row["path"])

    def run(self, source: DataFrame, ds: str, run_id: str | None = None) -> ExtractResult:
        """Extract the rows above the watermark; log the run whether it succeeds or not."""
        run_id = run_id or uuid.uuid4().hex
        for part in (ds, run_id):
            if not _SAFE_PART.fullmatch(part):
                raise ValueError(f"{part!r} cannot name a folder")
        spark = source.sparkSession
        commits = self.commits(spark)
        started, mark_from = time.monotonic(), None
        try:
            while True:
                state = commits.state()
                self._complete_log(spark, state)
                done = self._answer(state, run_id)
                if done is not None:
                    return done
                mark_from = self.watermark(spark, state)
                attempt = f"ds={ds}/run_id={run_id}/attempt={uuid.uuid4().hex[:12]}"
                rows, mark_to = self._write(source, mark_from, f"{self.data_path.rstrip('/')}/{attempt}", state)
                record = self._record_of(run_id, started, mark_from, rows, mark_to, f"{self.data_path.rstrip('/')}/{attempt}" if rows else None)
                mark = max(mark_from, mark_to) if mark_to else mark_from if state.entries else None
                entry = {"record": _json_of(record), "mark": mark and mark.isoformat(), "attempt": attempt if rows else None}
                if commits.commit(state, run_id, entry):
                    break
        except BaseException as error:
            # The session may be gone when a run is cancelled; the commit alone decides, so this cannot log a success.
            self._append(spark, self._record_of(run_id, started, mark_from, 0, None, None, f"{type(error).__name__}: {error}"))
            raise
        self._append(spark, record)
        compact_if_many(spark, self.log_path, INGESTION_LOG, self.pipeline_id)
        return ExtractResult(rows, mark_from, mark_to, record["path"])

    def _write(self, source: DataFrame, mark_from: datetime, target: str, state: State) -> tuple[int, datetime | None]:
        """Write the new rows; their number and greatest mark."""
        spark, column = source.sparkSession, F.col(self.watermark_column)
        kind = source.schema[self.watermark_column].dataType
        low = mark_from if self.overlap is None or not state.entries else mark_from - self.overlap
        new = source.filter(column > time_literal(low).cast(kind))
        if low < mark_from:
            new = _not_yet(new, self._extracted(spark, source.schema, state).select(*source.columns).filter(column > time_literal(low).cast(kind)))
        new.sortWithinPartitions(self.watermark_column).write.parquet(target)
        # The source may have moved on, so count what was written, not what is there now.
        written = spark.read.schema(source.schema).parquet(target).agg(
            F.count(F.lit(1)).alias("rows"), F.max(column).cast("timestamp_ntz").alias("mark")).first()
        return written["rows"], written["mark"]

    def _record_of(self, run_id, started, mark_from, rows, mark_to, path, error=None) -> dict[str, Any]:
        return {
            "id": run_id, "pipeline_id": self.pipeline_id, "table_name": self.table_name, "extracted_at": _now(), "rows_extracted": rows,
            "watermark_from": mark_from, "watermark_to": mark_to, "duration_seconds": round(time.monotonic() - started, 3),
            "path": path, "status": "failed" if error else "success", "error_message": error,
        }

    def _append(self, spark: SparkSession, record: dict[str, Any]) -> None:
        append_row(spark, self.log_path, INGESTION_LOG, record)

    def _complete_log(self, spark: SparkSession, state: State) -> None:
        """Log the newest commit if its run died before it did so; every run does this, so older ones are logged."""
        if state.last is not None:
            record = _record(state.entries[state.last])
            if self.log(spark).filter((F.col("id") == state.last) & (F.col("status") == "success")).isEmpty():
                self._append(spark, record)

    def extracted(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The rows of all committed runs, with their ``ds`` and ``run_id``; folders of other attempts are not read."""
        return self._extracted(spark, schema, self.commits(spark).state())

    def _extracted(self, spark: SparkSession, schema: StructType, state: State) -> DataFrame:
        layout = StructType(list(schema.fields)).add("ds", StringType()).add("run_id", StringType())
        base = self.data_path.rstrip("/")
        folders = [f"{base}/{e['attempt']}" for e in state.entries.values() if e["attempt"]]
        if not folders:
            return spark.createDataFrame([], layout)
        return spark.read.schema(layout).option("basePath", base).parquet(*folders).select(*[f"`{c}`" for c in layout.names])


def _not_yet(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` that are not in ``old``. Only digests are shuffled on one side; equal rows count as one."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in new.columns])), 256)
    seen = old.select(digest.alias("_millrace_digest"))
    return new.withColumn("_millrace_digest", digest).dropDuplicates(["_millrace_digest"]).join(seen, "_millrace_digest", "left_anti").drop("_millrace_digest")


def _json_of(record: dict[str, Any]) -> dict[str, Any]:
    return {k: v.isoformat() if isinstance(v, datetime) else v for k, v in record.items()}


def _record(entry: dict[str, Any]) -> dict[str, Any]:
    times = ("extracted_at", "watermark_from", "watermark_to")
    return {k: datetime.fromisoformat(v) if k in times and v else v for k, v in entry["record"].items()}


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
