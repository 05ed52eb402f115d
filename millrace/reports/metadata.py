"""The run, task, ingestion and lineage logs.

Plain Parquet has no upsert, so each log only grows and its current state is the newest row per key.
Logs are partitioned by ``pipeline_id``: a pipeline reads its own part alone.

Every append is a small JSON file, created as a whole by the driver: Spark jobs that write to one folder at the same time would take
each other's work away. ``compact_log`` draws them together into a snapshot, sorted by pipeline so that filters skip the rest of
it; a commit says which snapshot counts and which small files it holds. Readers take the snapshot and all other files, so a
writer that appends at the same time loses nothing, and a compaction that dies changes nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
    TimestampType,
)

from millrace.functions.labels import seconds_between, stage_of
from millrace.sinks.commits import CommitLog, Files, State

def _columns(**types) -> StructType:
    return StructType([StructField(name, kind) for name, kind in types.items()])


_TEXT, _TIME, _LOCAL = StringType(), TimestampType(), TimestampNTZType()

# The columns of each log.
INGESTION_LOG = _columns(
    id=_TEXT, table_name=_TEXT, extracted_at=_LOCAL, rows_extracted=LongType(), watermark_from=_LOCAL,
    watermark_to=_LOCAL, duration_seconds=DoubleType(), path=_TEXT, status=_TEXT, error_message=_TEXT,
    pipeline_id=_TEXT,
)
PIPELINE_RUNS = _columns(
    dag_run_id=_TEXT, logical_date=_TIME, state=_TEXT, started_at=_TIME, finished_at=_TIME,
    duration_seconds=DecimalType(10, 3), error_message=_TEXT, created_at=_TIME, pipeline_id=_TEXT,
)
TASK_RUNS = _columns(
    dag_run_id=_TEXT, task_id=_TEXT, stage=_TEXT, state=_TEXT, started_at=_TIME, finished_at=_TIME,
    duration_seconds=DecimalType(10, 3), try_number=IntegerType(), error_message=_TEXT, created_at=_TIME,
    pipeline_id=_TEXT,
)
PIPELINE_LINEAGE = _columns(
    source_type=_TEXT, source_location=_TEXT, transform_type=_TEXT, transform_target=_TEXT,
    delivery_type=_TEXT, delivery_location=_TEXT, updated_at=_TIME, pipeline_id=_TEXT,
)


#: Small files of one pipeline from which on a writer draws its log together.
COMPACT_FILES = 100
#: Rows in a file of a snapshot, about.
SNAPSHOT_ROWS = 1_000_000


def append_row(spark: SparkSession, path: str, schema: StructType, row: Mapping[str, Any]) -> None:
    """Append one row. Times with a zone are kept as UTC, others as they are."""
    unknown = set(row) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown log columns: {sorted(unknown)}")
    folder = f"{path.rstrip('/')}/pipeline_id={_in_path(row['pipeline_id'])}"
    cells = {c: _plain(v) for c, v in row.items() if v is not None and c != "pipeline_id"}
    Files(spark, folder).create(f"{uuid.uuid4().hex}.json", json.dumps(cells).encode())


def _plain(value: Any) -> Any:
    if isinstance(value, datetime):
        utc = value.astimezone(timezone.utc) if value.tzinfo else value
        return utc.isoformat(timespec="microseconds")
    return str(value) if isinstance(value, Decimal) else value


def _in_path(value: str) -> str:
    """A value as it names a folder of a partition."""
    return re.sub(r"""["#%'*/:=?\\{}\[\]^\x00-\x1f\x7f]""", lambda m: f"%{ord(m[0]):02X}", value)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a log, its snapshot and what was appended since; no rows where nothing has been written yet."""
    path = path.rstrip("/")
    snapshot = _snapshot(spark, path).entries.get("snapshot")
    if snapshot is None:
        return _small_rows(spark, schema, path)
    covered = set(snapshot["covered"])
    fresh = [f for f in _small_files(spark, path) if f not in covered]
    return spark.read.schema(schema).parquet(f"{path}/{snapshot['folder']}").unionByName(_small_rows(spark, schema, *fresh, base=path))


def _small_rows(spark: SparkSession, schema: StructType, *paths: str, base: str | None = None) -> DataFrame:
    """The rows of appended files."""
    if not paths:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).options(mode="FAILFAST", **({"basePath": base} if base else {})).json(list(paths)).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _snapshot(spark: SparkSession, path: str) -> State:
    return CommitLog(spark, f"{path}/_commits").state()


def _small_files(spark: SparkSession, path: str) -> list[str]:
    """What was appended, listed by Spark; folders whose name begins with an underscore are not looked at."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["path"] for r in files.select("path").collect())


def compact_log(spark: SparkSession, path: str, schema: StructType, keep_hours: float = 1.0) -> bool:
    """Draw the small files of a log together; False if someone else did so at the same time.

    Files and snapshots that no reader of the newest commit needs are removed one compaction later, if they are older than
    ``keep_hours``, for readers that began before.
    """
    path = path.rstrip("/")
    commits = CommitLog(spark, f"{path}/_commits")
    state = commits.state()
    old = state.entries.get("snapshot") or {"folder": None, "covered": []}
    small = _small_files(spark, path)
    fresh = [f for f in small if f not in set(old["covered"])]
    rows = _small_rows(spark, schema, *fresh, base=path)
    if old["folder"]:
        rows = spark.read.schema(schema).parquet(f"{path}/{old['folder']}").unionByName(rows)
    folder = f"_snapshots/{uuid.uuid4().hex}"
    rows.repartitionByRange(rows.count() // SNAPSHOT_ROWS + 1, "pipeline_id").sortWithinPartitions("pipeline_id").write.parquet(f"{path}/{folder}")
    snapshots = Files(spark, f"{path}/_snapshots")
    if not commits.commit(state, "snapshot", {"folder": folder, "covered": small}):
        snapshots.remove(folder.split("/")[1])
        return False
    commits.trim()
    before = time.time() * 1000 - keep_hours * 3_600_000
    stale = {f"_snapshots/{n}" for n, changed in snapshots.names().items() if changed < before} - {folder, old["folder"]}
    for name in stale:
        snapshots.remove(name.split("/")[1])
    by_folder: dict[str, list[str]] = {}
    for file in set(old["covered"]) & set(small):
        parent, name = file.rsplit("/", 1)
        by_folder.setdefault(parent, []).append(name)
    for parent, names in by_folder.items():
        files = Files(spark, parent)
        there = files.names()
        for name in names:
            if there.get(name, before) < before:
                files.remove(name)
    return True


def compact_if_many(spark: SparkSession, path: str, schema: StructType, pipeline_id: str, most: int = COMPACT_FILES) -> bool:
    """``compact_log`` if a pipeline has more small files than ``most`` that no snapshot holds; costs a look at one folder."""
    part = f"{path.rstrip('/')}/pipeline_id={_in_path(pipeline_id)}"
    names = [n for n in Files(spark, part).names() if n.endswith(".json")]
    if len(names) <= most:
        return False
    covered = {f.rsplit("/", 1)[1] for f in (_snapshot(spark, path.rstrip("/")).entries.get("snapshot") or {"covered": []})["covered"]}
    return sum(n not in covered for n in names) > most and compact_log(spark, path, schema)


def timed(df: DataFrame) -> DataFrame:
    """Set ``duration_seconds`` from the start and end times."""
    seconds = seconds_between(F.col("started_at"), F.col("finished_at"))
    return df.withColumn("duration_seconds", seconds.cast("decimal(10,3)"))


def with_stage(tasks: DataFrame) -> DataFrame:
    """Set ``stage`` of task attempts from their task id."""
    return tasks.withColumn("stage", stage_of(F.col("task_id")))


def current_runs(log: DataFrame, written_at: str = "created_at") -> DataFrame:
    """One row per (pipeline, run): what was written last, but the start of the first writing."""
    return _upserted(log, ["pipeline_id", "dag_run_id"], written_at,
                     first=("logical_date", "started_at", "created_at"))


def current_lineage(log: DataFrame, written_at: str = "updated_at") -> DataFrame:
    """One row per pipeline, as registered last; ``registered_at`` is the first registration."""
    first = log.withColumn("registered_at", F.col(written_at))
    return _upserted(first, ["pipeline_id"], written_at, first=("registered_at",))


def _upserted(log: DataFrame, keys: list[str], written_at: str, first: tuple[str, ...]) -> DataFrame:
    """Newest row per key with some columns kept from the oldest; both combine before the shuffle."""
    others = [c for c in log.columns if c not in keys]
    oldest = [c for c in others if c in first]
    newest = [c for c in others if c not in first]
    order: Column = F.struct(F.col(written_at), *[F.col(c) for c in newest if c != written_at])
    found = log.groupBy(*keys).agg(
        F.max_by(F.struct(*newest), order).alias("newest"),
        F.min_by(F.struct(*oldest), order).alias("oldest"),
    )
    return found.select(*keys, "newest.*", "oldest.*").select(*log.columns)
