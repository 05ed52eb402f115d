"""Reports over run logs derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.labels import seconds_between, whole_seconds_label
from millrace.queries.inputs import AS_OF, AS_OF_SQL, derived, with_derived
from millrace.queries.registry import query
from millrace.reports.health import (
    failed_tasks, latest_ingestion, pipeline_health, retry_counts, run_history, search, stage_state_counts,
    state_summary, success_rate, task_success_pct,
)
from millrace.reports.lineage import describe_stages, lineage_report
from millrace.reports.metadata import current_lineage, current_runs, with_stage

STAGE_SQL = "replace(split_part(task_id, '.', 1), '_skipped', '')"


@query("upsert_runs", with_derived("run_log", """
    , ranked as (
        select *, row_number() over (partition by pipeline_id, dag_run_id order by created_at desc) as n,
               first_value(started_at) over (partition by pipeline_id, dag_run_id order by created_at) as first_start,
               first_value(created_at) over (partition by pipeline_id, dag_run_id order by created_at) as first_made
        from run_log)
    select pipeline_id, dag_run_id, state, first_start as started_at, finished_at,
           cast(duration_seconds as double) as duration_seconds, error_message, first_start as logical_date,
           first_made as created_at
    from ranked where n = 1"""))
def upsert_runs(spark, sf_dir):
    return current_runs(derived(spark, sf_dir, "run_log"))


@query("task_stage", with_derived("tasks", f"""
    select pipeline_id, dag_run_id, task_id, try_number, {STAGE_SQL} as stage from tasks"""))
def task_stage(spark, sf_dir):
    return with_stage(derived(spark, sf_dir, "tasks")).select(
        "pipeline_id", "dag_run_id", "task_id", "try_number", "stage")


@query("run_duration", with_derived("runs", """
    , ended as (select *, started_at + to_microseconds(cast(duration_seconds * 1000000 as bigint)) as ended_at from runs)
    select dag_run_id, cast(round((epoch_us(ended_at) - epoch_us(started_at)) / 1000000, 3) as double) as seconds,
           coalesce(cast(epoch(date_trunc('second', ended_at))::bigint
                         - epoch(date_trunc('second', started_at))::bigint as varchar) || 's', '—') as label
    from ended"""))
def run_duration(spark, sf_dir):
    ended = derived(spark, sf_dir, "runs").withColumn("ended_at", F.expr(
        "timestampadd(MICROSECOND, cast(duration_seconds * 1000000 as bigint), started_at)"))
    start, end = F.col("started_at"), F.col("ended_at")
    return ended.select("dag_run_id", seconds_between(start, end).alias("seconds"),
                        whole_seconds_label(start, end).alias("label"))


@query("run_history", with_derived("runs", """
    select pipeline_id, dag_run_id, state, coalesce(strftime(started_at, '%Y-%m-%d %H:%M'), '—') as started_at,
           coalesce(cast(duration_seconds as varchar) || 's', '—') as duration,
           coalesce(error_message, '') as error_message
    from (select * from runs order by runs.started_at desc nulls last, pipeline_id, dag_run_id limit 25)"""))
def history(spark, sf_dir):
    return run_history(derived(spark, sf_dir, "runs"))


LINEAGE_SQL = """
    select concat('p', cast(user_id % 20 as string)) as pipeline_id, ts as updated_at,
           case event_id % 6 when 0 then 's3_csv' when 1 then 'http_api' when 2 then 'jdbc' when 3 then 'minio_csv'
                             when 4 then 'wizard_csv' end as source_kind,
           case when event_id % 4 = 0 then null when event_id % 4 = 1 then 'spark' else 'sql' end as transform_kind,
           case event_id % 5 when 0 then 's3_publish' when 1 then 'slack_notify' when 2 then 'webhook' end
               as delivery_kind,
           event_type as name
    from events"""


@query("lineage_report", f"""
    with configs as ({LINEAGE_SQL}), latest as (
        select * from (select *, row_number() over (partition by pipeline_id order by updated_at desc) as n
                       from configs) where n = 1)
    select pipeline_id,
           case source_kind when 's3_csv' then concat('s3_csv → s3://landing/', name, '/*.csv')
                            when 'http_api' then concat('http_api → https://api.test/', name)
                            when 'jdbc' then concat('jdbc → public.', name)
                            when 'minio_csv' then concat('minio_csv → s3://raw/', name, '.csv')
                            when 'wizard_csv' then concat('wizard_csv → s3://raw/', name, '.csv')
                            else '—' end as source,
           case transform_kind when 'sql' then concat('sql (', name, '.sql)') when 'spark' then 'spark (None)'
                               else '—' end as transform,
           case delivery_kind when 's3_publish' then concat('s3_publish → s3://curated/', name)
                              when 'slack_notify' then concat('slack_notify → #', name)
                              when 'webhook' then concat('webhook → https://hook.test/', name)
                              else '—' end as delivery
    from latest""")
def lineage(spark, sf_dir):
    from millrace.queries.inputs import read

    configs = spark.sql(LINEAGE_SQL.replace("from events", "from {events}"), events=read(spark, sf_dir, "events"))
    stages = configs.selectExpr(
        "pipeline_id", "updated_at",
        "if(source_kind is null, null, named_struct('type', source_kind, 'source_bucket', 'landing', "
        "'source_key', concat(name, '/*.csv'), 'bucket', 'raw', 'key', concat(name, '.csv'), "
        "'url', concat('https://api.test/', name), 'table', concat('public.', name))) as ingestion",
        "if(transform_kind is null, null, named_struct('type', transform_kind, 'sql_file', concat(name, '.sql'))) "
        "as transformation",
        "if(delivery_kind is null, null, named_struct('type', delivery_kind, 'dest_bucket', 'curated', "
        "'dest_prefix', name, 'channel', concat('#', name), 'url', concat('https://hook.test/', name))) as delivery",
    )
    log = describe_stages(stages)
    return lineage_report(current_lineage(log))


@query("failed_tasks", with_derived("tasks", f"""
    select pipeline_id, task_id, {STAGE_SQL} as stage, try_number, substring(error_message, 1, 80) as error_message,
           started_at
    from (select * from tasks where state = 'failed'
          order by tasks.started_at desc nulls last, pipeline_id, dag_run_id, task_id limit 20)"""))
def failed(spark, sf_dir):
    return failed_tasks(with_stage(derived(spark, sf_dir, "tasks")))


@query("retry_counts", with_derived("tasks", """
    select * from (
        select task_id, pipeline_id, count(task_id) as total_attempts, max(try_number) as max_tries from tasks group by 1, 2) t
    where max_tries >= 2"""))
def retries(spark, sf_dir):
    return retry_counts(derived(spark, sf_dir, "tasks"))


@query("stage_state_counts", with_derived("tasks", f"""
    select {STAGE_SQL} as stage, state, count(*) as "count" from tasks group by 1, 2"""))
def by_stage(spark, sf_dir):
    return stage_state_counts(with_stage(derived(spark, sf_dir, "tasks")))


@query("task_success_pct", with_derived("tasks", """
    select round(avg(case state when 'success' then 100.0 else 0 end), 1) as success_pct from tasks"""))
def task_success(spark, sf_dir):
    return task_success_pct(derived(spark, sf_dir, "tasks"))


@query("success_rate_7d", with_derived("runs", f"""
    , recent as (
    select pipeline_id, sum(case state when 'success' then 1 else 0 end) as ok, sum(case state when 'failed' then 1 else 0 end) as failed
    from runs where {AS_OF_SQL} - interval '7 days' <= started_at group by 1)
    select pipeline_id, cast(ok as bigint) as ok, cast(failed as bigint) as failed,
           case when ok + failed > 0 then round(ok / (ok + failed) * 100, 1) end as success_pct
    from recent"""))
def success_rate_7d(spark, sf_dir):
    return success_rate(derived(spark, sf_dir, "runs"), AS_OF)


HEALTH_SQL = f"""
    , newest as (
        select * from (select *, row_number() over (partition by pipeline_id
                              order by started_at desc nulls last, dag_run_id desc) as n from runs) where n = 1),
    counts as (
        select pipeline_id, count(*) filter (where state in ('success', 'failed')) as runs_30d,
               count(*) filter (where state = 'success') as ok_30d
        from runs where started_at >= {AS_OF_SQL} - interval '30 days' group by pipeline_id),
    ingested as (
        select *, cast(round(duration_seconds, 1) as decimal(18,1)) as seconds
        from (select *, row_number() over (partition by pipeline_id order by extracted_at desc, id desc) as n
              from ilog) where n = 1),
    health as (
        select p.pipeline_id, case when is_paused then 'paused' else coalesce(r.state, 'no runs') end as state,
               coalesce(strftime(r.started_at, '%Y-%m-%d %H:%M'), '—') as last_run,
               case when seconds <> 0 then concat(cast(seconds as varchar), 's')
                    when r.finished_at is null or r.started_at is null then '—'
                    else concat(cast(epoch(date_trunc('second', r.finished_at))::bigint
                                     - epoch(date_trunc('second', r.started_at))::bigint as varchar), 's')
                    end as duration,
               coalesce(cast(rows_extracted as varchar), '—') as "rows",
               coalesce(cast(watermark_to as varchar), '—') as watermark,
               coalesce(runs_30d, 0) as runs_30d, coalesce(ok_30d, 0) as ok_30d,
               round_even(cast(ok_30d as double) / nullif(runs_30d, 0) * 100, 1) as pct_30d
        from pipelines p left join newest r using (pipeline_id) left join counts using (pipeline_id)
             left join ingested using (pipeline_id)) """


def _health(spark, sf_dir):
    return pipeline_health(
        derived(spark, sf_dir, "pipelines"), derived(spark, sf_dir, "runs"), derived(spark, sf_dir, "ilog"), AS_OF)


@query("pipeline_health", with_derived("pipelines runs ilog", HEALTH_SQL + """
    select *, case when pct_30d >= 90 then 'hi' when pct_30d >= 70 then 'mid' when pct_30d is not null then 'lo' end
        as tier from health"""))
def pipelines(spark, sf_dir):
    return _health(spark, sf_dir)


@query("state_summary", with_derived("pipelines runs ilog", HEALTH_SQL + """
    select count(*) filter (where state = 'success') as ok, count(*) filter (where state = 'failed') as failed,
           count(*) filter (where state = 'paused') as paused, count(*) as total from health"""))
def summary(spark, sf_dir):
    return state_summary(_health(spark, sf_dir))


@query("latest_ingestion", with_derived("ilog", """
    select pipeline_id, rows_extracted, cast(round(duration_seconds, 1) as double) as duration_seconds, status,
           coalesce(cast(watermark_to as varchar), '') as watermark
    from (select *, row_number() over (partition by pipeline_id order by extracted_at desc, id desc) as n from ilog)
    where n = 1"""))
def ingestion(spark, sf_dir):
    return latest_ingestion(derived(spark, sf_dir, "ilog"))


@query("search_substring", with_derived("pipelines", """
    select pipeline_id, is_paused, description from pipelines
    where contains(lower(pipeline_id), 'source 3') or contains(lower(description), 'source 3')"""))
def search_substring(spark, sf_dir):
    return search(derived(spark, sf_dir, "pipelines"), "SOURCE 3")
