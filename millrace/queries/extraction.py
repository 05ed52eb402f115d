"""Incremental extraction over the events table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.functions.times import time_literal
from millrace.plans.incremental import IncrementalExtract, current_watermarks
from millrace.queries.inputs import read
from millrace.queries.registry import query
from millrace.session import shared_folder

CUT = datetime(2024, 1, 15)
CUT_SQL = "timestamp '2024-01-15 00:00:00'"
FIRST_MARK = f"(select max(ts) from events where ts < {CUT_SQL})"


def _job(spark):
    base = shared_folder(spark, "extract")
    return IncrementalExtract("events_daily", "public.events", f"{base}/data", f"{base}/log", watermark_column="ts")


def _three_runs(spark, sf_dir):
    """The source as it was before the cut, as it is now, and again without anything new."""
    job, events = _job(spark), read(spark, sf_dir, "events")
    job.run(events.filter(F.col("ts") < time_literal(CUT)), "2024-01-15", "a")
    job.run(events, "2024-01-31", "b")
    job.run(events, "2024-01-31", "c")
    return job, events


@query("incremental_extract", f"""
    select event_id, ts, user_id, event_type, value, props,
           case when ts < {CUT_SQL} then 'a' else 'overlapping' end as run_id,
           case when ts < {CUT_SQL} then '2024-01-15' else '2024-01-31' end as ds
    from events""")
def incremental_extract(spark, sf_dir):
    """A first run, and then two that overlap: each row comes once, by whichever of the two commits first."""
    job, events = _job(spark), read(spark, sf_dir, "events")
    job.run(events.filter(F.col("ts") < time_literal(CUT)), "2024-01-15", "a")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda run: job.run(events, "2024-01-31", run), ("b", "c")))
    rows = job.extracted(spark, events.schema)
    return rows.withColumn("run_id", F.when(F.col("run_id") == "a", "a").otherwise("overlapping"))


@query("incremental_late", f"""
    select event_id, ts, user_id, event_type, value, props, case when ts < {CUT_SQL} and event_id % 9 <> 0 then 'a' else 'b' end as run_id
    from events where not (ts < {CUT_SQL} - interval '3 days' and event_id % 9 = 0)""")
def incremental_late(spark, sf_dir):
    """Rows that come up to three days late are extracted once; the rest of that time is read again and left out."""
    base = shared_folder(spark, "extract")
    job = IncrementalExtract("events_daily", "public.events", f"{base}/data", f"{base}/log", watermark_column="ts", overlap=timedelta(days=3))
    events = read(spark, sf_dir, "events")
    last = events.filter(F.col("ts") < time_literal(CUT)).agg(F.max("ts")).first()[0]
    early = events.filter(F.col("ts") < time_literal(CUT))
    job.run(early.filter((F.col("event_id") % 9 != 0) | (F.col("ts") == time_literal(last))), "2024-01-15", "a")
    shifted = events.filter((F.col("event_id") % 9 != 0) | (F.col("ts") >= time_literal(CUT - timedelta(days=3))))
    job.run(shifted, "2024-01-31", "b")
    return job.extracted(spark, events.schema).drop("ds").withColumn("run_id", F.when((F.col("ts") < time_literal(CUT)) & (F.col("event_id") % 9 != 0), "a").otherwise("b"))


@query("incremental_first_run", """
    select event_id, ts, user_id, event_type, value, props, timestamp '1970-01-01 00:00:00' as watermark_from
    from events""")
def incremental_first_run(spark, sf_dir):
    job, events = _job(spark), read(spark, sf_dir, "events")
    result = job.run(events, "2024-01-31", "a")
    return job.extracted(spark, events.schema).drop("ds", "run_id").withColumn(
        "watermark_from", time_literal(result.watermark_from))


@query("incremental_noop", """
    select max(ts) as last_watermark, 0::bigint as rows_extracted, true as mark_is_null, true as path_is_null
    from events""")
def incremental_noop(spark, sf_dir):
    job, _ = _three_runs(spark, sf_dir)
    log = job.log(spark)
    last = current_watermarks(log).select(F.col("last_watermark")).scalar()
    return log.filter(F.col("id") == "c").select(
        last.alias("last_watermark"), "rows_extracted", F.col("watermark_to").isNull().alias("mark_is_null"),
        F.col("path").isNull().alias("path_is_null"))


@query("watermark_state", """
    select 'events_daily' as pipeline_id, 'public.events' as table_name, max(ts) as last_watermark from events""")
def watermark_state(spark, sf_dir):
    job, _ = _three_runs(spark, sf_dir)
    return current_watermarks(job.log(spark)).drop("updated_at")


@query("ingestion_audit", f"""
    select 'a' as id, count(*) as rows_extracted, timestamp '1970-01-01 00:00:00' as watermark_from,
           max(ts) as watermark_to, 'success' as status, '' as error_message
    from events where ts < {CUT_SQL}
    union all
    select 'b', count(*), {FIRST_MARK}, max(ts), 'success', '' from events where ts > {FIRST_MARK}
    union all
    select 'broken', 0, max(ts), null, 'failed', 'NoSuchColumn' from events""")
def ingestion_audit(spark, sf_dir):
    job, events = _job(spark), read(spark, sf_dir, "events")
    job.run(events.filter(F.col("ts") < time_literal(CUT)), "2024-01-15", "a")
    job.run(events, "2024-01-31", "b")
    try:
        # A source that fails while it is read: the run is logged and the mark stays.
        failing = events.withColumn("value", F.when(
            F.col("event_id") >= 0, F.raise_error(F.lit("NoSuchColumn")).cast("double")))
        job.run(failing.withColumn("ts", time_literal(datetime(2030, 1, 1))), "2024-01-31", "broken")
    except Exception:
        pass
    return job.log(spark).select(
        "id", "rows_extracted", "watermark_from", "watermark_to", "status",
        F.regexp_extract(F.coalesce("error_message", F.lit("")), "NoSuchColumn", 0).alias("error_message"))
