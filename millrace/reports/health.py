"""Reports over the logs. Times are compared with ``as_of``, never with the clock of the machine."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.labels import (
    ERROR_LENGTH, MISSING, minute_label, rate_tier, seconds_label, success_pct, whole_seconds_label,
)
from millrace.functions.times import time_literal
from millrace.operators.latest import latest_by, newest_first

# How many rows the lists show and how far back the rates look.
HISTORY_ROWS = 25
FAILED_TASK_ROWS = 20
RATE_DAYS = 30
RECENT_DAYS = 7


def _is(state: str) -> Column:
    return F.col("state") == state


def _finished() -> Column:
    return F.col("state").isin("success", "failed")


def run_history(runs: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The newest runs, as text for display."""
    return newest_first(runs, "started_at", n, ("pipeline_id", "dag_run_id")).select(
        "pipeline_id", "dag_run_id", "state", minute_label(F.col("started_at")).alias("started_at"),
        seconds_label(F.col("duration_seconds")).alias("duration"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def failed_tasks(tasks: DataFrame, n: int = FAILED_TASK_ROWS) -> DataFrame:
    """The newest failed attempts; error text is cut for display."""
    failed = newest_first(tasks.filter(_is("failed")), "started_at", n, ("pipeline_id", "dag_run_id", "task_id"))
    return failed.select(
        "pipeline_id", "task_id", "stage", "try_number",
        F.substring("error_message", 1, ERROR_LENGTH).alias("error_message"), "started_at",
    )


def retry_counts(tasks: DataFrame) -> DataFrame:
    """Tasks that needed more than one attempt."""
    return tasks.groupBy("pipeline_id", "task_id").agg(
        F.max("try_number").alias("max_tries"), F.count(F.lit(1)).alias("total_attempts"),
    ).filter(F.col("max_tries") > 1).orderBy(F.col("max_tries").desc(), "pipeline_id", "task_id")


def stage_state_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("count")).orderBy("stage", "state")


def task_success_pct(tasks: DataFrame) -> DataFrame:
    """Share of successful attempts among all, half away from zero."""
    share = F.lit(100.0) * F.count_if(_is("success")) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return tasks.agg(F.round(share, 1).alias("success_pct"))


def state_summary(pipelines: DataFrame) -> DataFrame:
    """How many pipelines are in each of the shown states."""
    return pipelines.agg(
        F.count_if(_is("success")).alias("ok"), F.count_if(_is("failed")).alias("failed"),
        F.count_if(_is("paused")).alias("paused"), F.count(F.lit(1)).alias("total"),
    )


def success_rate(runs: DataFrame, as_of: datetime, days: int = RECENT_DAYS) -> DataFrame:
    """Per pipeline over the last days: finished runs and the share that succeeded, worst first."""
    recent = runs.filter(F.col("started_at") >= time_literal(as_of - timedelta(days=days)))
    counted = recent.groupBy("pipeline_id").agg(
        F.count_if(_is("success")).alias("ok"), F.count_if(_is("failed")).alias("failed"),
        F.count_if(_finished()).alias("finished"),
    )
    share = F.col("ok") / F.nullif(F.col("finished"), F.lit(0)) * 100
    return counted.select("pipeline_id", "ok", "failed", F.round(share, 1).alias("success_pct")).orderBy(
        F.col("success_pct").asc_nulls_last(), "pipeline_id"
    )


def latest_ingestion(log: DataFrame) -> DataFrame:
    """The newest ingestion of each pipeline."""
    needed = log.select(
        "pipeline_id", "id", "extracted_at", "rows_extracted", "duration_seconds", "status", "watermark_to")
    return latest_by(needed, ["pipeline_id"], ["extracted_at", "id"]).select(
        "pipeline_id", "rows_extracted",
        F.round(F.col("duration_seconds").cast("decimal(18,3)"), 1).alias("duration_seconds"),
        "status", F.coalesce(F.col("watermark_to").cast("string"), F.lit("")).alias("watermark"),
    )


def search(df: DataFrame, text: str, columns: tuple[str, ...] = ("pipeline_id", "description")) -> DataFrame:
    """Rows that hold ``text`` in one of the columns, in any case; no pattern characters."""
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.lower(F.col(column)).contains(text.lower()), F.lit(False))
    return df.filter(found)


def pipeline_health(pipelines: DataFrame, runs: DataFrame, ingestions: DataFrame, as_of: datetime) -> DataFrame:
    """One line per pipeline: its newest run, its rate over 30 days and its newest ingestion.

    ``pipelines`` has ``pipeline_id`` and ``is_paused``; ``runs`` needs ``finished_at``. One pass
    over the runs gives both the newest run and the counts, so only one row per pipeline is joined.
    """
    since = as_of - timedelta(days=RATE_DAYS)
    recent = f"started_at >= timestamp_ntz'{since.isoformat(sep=' ')}'"
    by_pipeline = runs.groupBy("pipeline_id").agg(
        F.expr("max_by(struct(state, started_at, finished_at), struct(started_at, dag_run_id)) as run"),
        F.expr(f"count_if({recent} and state in ('success', 'failed')) as runs_30d"),
        F.expr(f"count_if({recent} and state = 'success') as ok_30d"),
    )
    ingested = latest_ingestion(ingestions).withColumnRenamed("duration_seconds", "seconds")
    joined = pipelines.join(by_pipeline, "pipeline_id", "left").join(ingested, "pipeline_id", "left")
    duration = F.when(F.col("seconds") != 0, seconds_label(F.col("seconds"))).otherwise(
        whole_seconds_label(F.col("run.started_at"), F.col("run.finished_at")))
    pct = success_pct(F.col("ok_30d"), F.col("runs_30d"))
    return joined.select(
        "pipeline_id",
        F.expr("if(is_paused, 'paused', coalesce(run.state, 'no runs')) as state"),
        minute_label(F.col("run.started_at")).alias("last_run"),
        duration.alias("duration"),
        F.expr(f"coalesce(cast(rows_extracted as string), '{MISSING}') as rows"),
        F.expr(f"coalesce(nullif(watermark, ''), '{MISSING}') as watermark"),
        F.expr("coalesce(runs_30d, 0) as runs_30d"),
        F.expr("coalesce(ok_30d, 0) as ok_30d"),
        pct.alias("pct_30d"),
    ).withColumn("tier", rate_tier(F.col("pct_30d"))).orderBy("pipeline_id")
