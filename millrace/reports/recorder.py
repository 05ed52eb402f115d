"""Writers of the run, task and lineage logs: what a job leaves behind, also when it fails."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.labels import stage_of
from millrace.reports.metadata import (
    PIPELINE_LINEAGE, PIPELINE_RUNS, TASK_RUNS, append_row, compact_if_many, compact_log, current_lineage, current_runs, read_log,
)


LOGS = {"runs": PIPELINE_RUNS, "tasks": TASK_RUNS, "lineage": PIPELINE_LINEAGE}


class RunLog:
    """The logs below ``folder``, as one run of a pipeline writes them. Each row is appended; readers take the newest."""

    def __init__(self, spark: SparkSession, folder: str, pipeline_id: str, run_id: str, try_number: int = 1):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pipeline_id, self.run_id, self.try_number = pipeline_id, run_id, try_number

    @contextmanager
    def run(self, logical_date: datetime | None = None) -> Iterator[None]:
        """A row when the run starts, and one when it has ended; an error is logged and raised again."""
        start = _now()
        row = {"pipeline_id": self.pipeline_id, "dag_run_id": self.run_id, "logical_date": logical_date or start, "started_at": start}
        append_row(self.spark, f"{self.folder}/runs", PIPELINE_RUNS, {**row, "state": "running", "created_at": start})
        with self._ending(start) as end:
            yield
        append_row(self.spark, f"{self.folder}/runs", PIPELINE_RUNS, {**row, **end, "created_at": end["finished_at"]})
        end.throw()
        for name, schema in LOGS.items():
            compact_if_many(self.spark, f"{self.folder}/{name}", schema, self.pipeline_id)

    @contextmanager
    def task(self, task_id: str) -> Iterator[None]:
        """A row when the task has ended; its stage is the part of ``task_id`` before the first dot."""
        start = _now()
        with self._ending(start) as end:
            yield
        row = {"pipeline_id": self.pipeline_id, "dag_run_id": self.run_id, "task_id": task_id, "started_at": start,
               "try_number": self.try_number, "created_at": end["finished_at"], **end}
        stage = self.spark.range(1).select(stage_of(F.lit(task_id))).first()[0]
        append_row(self.spark, f"{self.folder}/tasks", TASK_RUNS, {**row, "stage": stage})
        end.throw()

    def lineage(self, **stages: str | None) -> None:
        """Where the pipeline's data comes from and goes to; the newest registration counts."""
        row = {"pipeline_id": self.pipeline_id, "updated_at": _now(), **stages}
        append_row(self.spark, f"{self.folder}/lineage", PIPELINE_LINEAGE, row)

    def runs(self) -> DataFrame:
        return current_runs(read_log(self.spark, f"{self.folder}/runs", PIPELINE_RUNS))

    def tasks(self) -> DataFrame:
        return read_log(self.spark, f"{self.folder}/tasks", TASK_RUNS)

    def lineages(self) -> DataFrame:
        return current_lineage(read_log(self.spark, f"{self.folder}/lineage", PIPELINE_LINEAGE))

    def compact(self) -> None:
        """Draw the small files of all three logs together."""
        for name, schema in LOGS.items():
            compact_log(self.spark, f"{self.folder}/{name}", schema)

    @contextmanager
    def _ending(self, start: datetime) -> Iterator["_End"]:
        """The columns that say how the body ended; its error is kept until they are written."""
        end = _End()
        try:
            yield end
        except BaseException as error:  # a run that is cancelled has failed too
            end.error = error
        at = _now()
        end.update(finished_at=at, duration_seconds=Decimal(str(round((at - start).total_seconds(), 3))),
                   state="failed" if end.error else "success",
                   error_message=f"{type(end.error).__name__}: {end.error}" if end.error else None)


class _End(dict):
    error: BaseException | None = None

    def throw(self) -> None:
        if self.error is not None:
            raise self.error


def _now() -> datetime:
    return datetime.now(timezone.utc)
