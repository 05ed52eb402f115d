import datetime
import os
from decimal import Decimal

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from millrace.functions.labels import seconds_between, stage_of, whole_seconds_label
from millrace.operators.latest import latest_by
from millrace.operators.quality import (
    CheckFailed, ExpectedColumn, dedupe, freshness, require, row_count, schema,
)
from millrace.plans.script import created_views, run_script
from millrace.plans.job import build_tables, run_catalog_job, run_job
from millrace.reports import health, lineage, metadata
from millrace.reports.recorder import RunLog
from millrace.spec import ColumnSpec, ComputedSpec, FilterSpec, JobSpec, JoinSpec, MetricSpec, TableSpec

AS_OF = datetime.datetime(2024, 1, 31)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_script_runs_in_order_and_lists_views(spark):
    done = run_script(spark, """
        create or replace temporary view first as select ';' as c, :n as n; -- a; comment
        CREATE OR REPLACE TEMP VIEW `second` AS select c, n + 1 as n from first;
        select * from second
    """, {"n": 41})
    assert done.views == ["first", "second"] and rows(done.result) == [(";", 42)]


def test_script_stops_at_the_first_error(spark):
    with pytest.raises(Exception, match="no_such_table"):
        run_script(spark, "create or replace temp view made as select 1 a; select * from no_such_table; "
                          "create or replace temp view never as select 1 a")
    assert not spark.catalog.tableExists("made") and not spark.catalog.tableExists("never")
    with pytest.raises(ValueError):
        run_script(spark, " ; ")


def test_view_names_are_found():
    assert created_views('CREATE VIEW clean.orders AS x; create or replace view analytics . `or ders` as y') == [
        "clean.orders", "analytics.orders"]


def test_inline_rows_and_a_two_step_model(spark):
    result = run_script(spark, """
        create or replace temp view weighed as
        select shelf, grams / 1000 as kilos from values ('low', 1500), ('top', 250), ('low', 500) as v(shelf, grams);
        select shelf, sum(kilos) as kilos from weighed group by shelf order by shelf
    """).result
    assert rows(result) == [("low", 2.0), ("top", 0.25)]


def test_views_in_comments_and_text_do_not_count():
    assert created_views("""-- was: create view old_v as select 1
        /* create view b as */ create view `a b` as select 'create view c as' x; create or replace temp view d as select 1""") == ["ab", "d"]


SPECS = [
    TableSpec("Orders", [ColumnSpec("amount", "INTEGER"), ColumnSpec("kind")], group_by=["kind"],
              metrics=[MetricSpec("amount", "SUM")]),
    TableSpec("plain", [ColumnSpec("x")], group_by=["x"]),
]


def test_a_job_builds_every_table_lazily(spark, raw, tmp_path):
    tables = {"orders": raw("amount kind", ("1", "a"), ("2", "a"), ("5", "b")), "plain": raw("x", " 1 ")}
    results = build_tables(SPECS, tables)
    assert sorted(rows(results["orders"].analytics)) == [("a", 3), ("b", 5)]
    assert results["plain"].analytics is None and rows(results["plain"].clean) == [("1",)]
    out = run_job(spark, JobSpec(SPECS), tables, export_to=str(tmp_path), at=AS_OF)
    assert list(out) == ["clean_orders", "analytics_orders", "clean_plain"]
    assert spark.read.csv(out["analytics_orders"], header=True).count() == 2


def test_custom_sql_replaces_the_generated_views(spark, raw):
    job = JobSpec([SPECS[1]], custom_sql="create or replace temp view mine as select upper(x) x from raw_plain")
    assert list(run_job(spark, job, {"plain": raw("x", "q")})) == ["mine"]
    assert rows(spark.table("mine")) == [("Q",)]


def test_catalog_views_are_read_by_another_session(spark, raw, tmp_path):
    spark.sql("create database if not exists raw")
    raw("id amount d kind", ("1", "1.105", "2024-01-01", "it's \\ 50%"), ("2", "7", "2024-01-02", "b"), ("3", None, None, None)).write.mode(
        "overwrite").option("path", str(tmp_path / "sold")).saveAsTable("raw.sold")
    raw("k w", ("b", "5")).write.mode("overwrite").option("path", str(tmp_path / "kinds")).saveAsTable("raw.kinds")
    spec = TableSpec(
        "Sold", [ColumnSpec("id", "INTEGER"), ColumnSpec("amount", "NUMERIC", "price"), ColumnSpec("d", "DATE", include=False), ColumnSpec("kind")],
        joins=[JoinSpec("kinds", "kind", "k", salt=3)],
        computed=[ComputedSpec("twice", "amount * 2", over="typed"), ComputedSpec("w", "kinds.w")],
        filters=[FilterSpec("price", "<", "100.001"), FilterSpec("d", ">=", "2024-01-01"), FilterSpec("kind", "!=", "it's")],
        group_by=["w"], metrics=[MetricSpec("price", "MAX"), MetricSpec("*", "COUNT")])
    assert list(run_catalog_job(spark, JobSpec([spec]))) == ["clean.sold", "analytics.sold"]
    other = spark.newSession()
    expected = build_tables([spec], lambda name: spark.table(f"raw.{name}"))["sold"]
    assert other.table("clean.sold").schema == expected.clean.schema
    assert sorted(rows(other.table("clean.sold"))) == sorted(rows(expected.clean)) and expected.clean.count() == 2
    assert sorted(rows(other.table("analytics.sold")), key=str) == sorted(rows(expected.analytics), key=str)
    for kept in (("kind", "=", "it's \\ 50%"), ("kind", "LIKE", "t's \\\\"), ("price", "=", "1.11")):
        one = TableSpec("sold", [ColumnSpec("amount", "NUMERIC", "price"), ColumnSpec("kind")], filters=[FilterSpec(*kept)])
        run_catalog_job(spark, JobSpec([one]))
        assert other.table("clean.sold").count() == 1


def test_a_job_leaves_its_run_tasks_and_lineage(spark, raw, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), "sales", "r1")
    run_job(spark, JobSpec(SPECS[1:]), {"plain": raw("x", "q")}, export_to=str(tmp_path / "out"), at=AS_OF, log=log)
    failing = RunLog(spark, str(tmp_path / "log"), "sales", "r2")
    with pytest.raises(Exception, match="unknown table"):
        run_job(spark, JobSpec(SPECS[1:]), {}, log=failing)
    assert sorted((r.dag_run_id, r.state) for r in log.runs().collect()) == [("r1", "success"), ("r2", "failed")]
    tasks = sorted((r.dag_run_id, r.task_id, r.stage, r.state) for r in log.tasks().collect())
    assert tasks == [("r1", "delivery.clean_plain", "delivery", "success"), ("r1", "transformation.plain", "transformation", "success"),
                     ("r2", "transformation.plain", "transformation", "failed")]
    assert all("unknown table" in r.error_message and r.duration_seconds >= 0 for r in log.tasks().where("state = 'failed'").collect())
    assert [(r.pipeline_id, r.source_location, r.delivery_type) for r in log.lineages().collect()] == [("sales", "plain", None)]


def test_latest_by_breaks_ties_and_combines_before_the_shuffle(spark):
    df = spark.sql("select * from values ('a', 1, 'x'), ('a', 2, 'y'), ('a', 2, 'z'), (null, 1, 'n') as t(k, v, w)")
    out = latest_by(df, ["k"], ["v", "w"])
    assert sorted(rows(out), key=str) == [("a", 2, "z"), (None, 1, "n")]
    assert out.columns == ["k", "v", "w"] and "partial_max_by" in plan_of(out)
    assert rows(latest_by(df, [], ["v", "w"])) == [("a", 2, "z")]


def test_quality_checks(spark):
    df = spark.sql("select * from values (1, 'a', timestamp_ntz'2024-01-30'), (2, null, timestamp_ntz'2024-01-29 12:00:00') "
                   "as t(id, name, at)")
    assert rows(row_count(df, 2)) == [("row_count", 2, 2, True)]
    assert rows(row_count(df, 3)) == [("row_count", 2, 3, False)]
    day = 86400
    assert rows(freshness(df, "at", datetime.timedelta(days=1), AS_OF)) == [("freshness", day, day, True)]
    assert rows(freshness(df, "at", datetime.timedelta(hours=23), AS_OF))[0][3] is False
    assert rows(freshness(df.filter("false"), "at", datetime.timedelta(days=1), AS_OF))[0][3] is False
    found = schema(df, {"id": ExpectedColumn("int", False), "name": ExpectedColumn("string", False),
                        "gone": ExpectedColumn("date", False)})
    assert rows(found) == [("id", "int", "int", 0, True), ("name", "string", "string", 1, False),
                           ("gone", "date", None, 0, False), ("at", None, "timestamp_ntz", 0, False)]
    with pytest.raises(CheckFailed, match="name"):
        require(found)
    assert require(row_count(df, 1)).count() == 1
    assert rows(dedupe(df.union(df).withColumn("id", F.lit(1)), ["id"], ["at"]).select("name")) == [("a",)]


def test_durations_and_stages(spark):
    df = spark.sql("""select * from values
        (timestamp_ntz'2024-01-01 00:00:00.900', timestamp_ntz'2024-01-01 00:00:03.1004', 'validation.row_count'),
        (null, timestamp_ntz'2024-01-01', 'delivery_skipped') as t(a, b, task)""")
    out = df.select(seconds_between(F.col("a"), F.col("b")).cast("double"), whole_seconds_label(F.col("a"), F.col("b")),
                    stage_of(F.col("task")))
    assert rows(out) == [(2.2, "3s", "validation"), (None, "—", "delivery")]


def test_run_log_is_an_upsert(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = {"pipeline_id": "p", "dag_run_id": "r", "state": "running", "started_at": AS_OF, "created_at": AS_OF}
    metadata.append_row(spark, path, metadata.PIPELINE_RUNS, first)
    later = AS_OF + datetime.timedelta(minutes=1)
    metadata.append_row(spark, path, metadata.PIPELINE_RUNS, {
        **first, "state": "failed", "started_at": later, "finished_at": later, "error_message": "boom",
        "created_at": later})
    metadata.append_row(spark, path, metadata.PIPELINE_RUNS, {**first, "dag_run_id": "s"})
    log = metadata.read_log(spark, path, metadata.PIPELINE_RUNS)
    runs = {r["dag_run_id"]: r for r in metadata.timed(metadata.current_runs(log)).collect()}
    assert runs["r"]["state"] == "failed" and runs["r"]["error_message"] == "boom"
    assert runs["r"]["started_at"] == AS_OF and runs["r"]["duration_seconds"] == Decimal("60.000")
    assert runs["s"]["state"] == "running" and runs["s"]["duration_seconds"] is None
    assert metadata.read_log(spark, str(tmp_path / "none"), metadata.TASK_RUNS).count() == 0
    with pytest.raises(ValueError):
        metadata.append_row(spark, path, metadata.PIPELINE_RUNS, {"colour": 1})


def test_lineage_covers_every_source_type(spark):
    configs = spark.sql("""select * from values
        ('a', named_struct('type', 's3_csv', 'source_bucket', 'b', 'source_key', 'k/*', 'url', null, 'table', null,
                           'bucket', null, 'key', null),
              named_struct('type', 'sql', 'sql_file', 'f.sql'), timestamp'2024-01-01'),
        ('a', named_struct('type', 'wizard_csv', 'source_bucket', null, 'source_key', null, 'url', null, 'table', null,
                           'bucket', 'raw', 'key', 'w/t.csv'),
              named_struct('type', 'spark', 'sql_file', null), timestamp'2024-01-02'),
        ('b', null, null, timestamp'2024-01-01') as t(pipeline_id, ingestion, transformation, updated_at)""")
    log = lineage.describe_stages(configs)
    current = metadata.current_lineage(log)
    assert {r["pipeline_id"]: str(r["registered_at"])[:10] for r in current.collect()} == {
        "a": "2024-01-01", "b": "2024-01-01"}
    assert rows(lineage.lineage_report(current)) == [
        ("a", "wizard_csv → s3://raw/w/t.csv", "spark (None)", "—"), ("b", "—", "—", "—")]


RUNS = """select * from values
    ('p1', 'r1', 'success', timestamp_ntz'2024-01-30 10:00:00', timestamp_ntz'2024-01-30 10:00:09', 9.0, null),
    ('p1', 'r2', 'failed',  timestamp_ntz'2024-01-30 11:00:00', timestamp_ntz'2024-01-30 11:01:00', 60.0, 'boom'),
    ('p1', 'r3', 'queued',  null, null, null, null),
    ('p1', 'r0', 'success', timestamp_ntz'2023-12-01 10:00:00', timestamp_ntz'2023-12-01 10:00:01', 1.0, null),
    ('p2', 'r9', 'success', timestamp_ntz'2024-01-02 10:00:00', null, null, null)
    as t(pipeline_id, dag_run_id, state, started_at, finished_at, duration_seconds, error_message)"""


def test_health_report(spark):
    pipelines = spark.sql("select * from values ('p1', false), ('p2', true), ('p3', false) as t(pipeline_id, is_paused)")
    log = spark.sql("""select * from values
        (1, 'p2', 't', timestamp_ntz'2024-01-01', 7, timestamp_ntz'2024-01-01 01:02:03.5', 12.34, 'success'),
        (2, 'p2', 't', timestamp_ntz'2024-01-01', null, null, 0.0, 'failed') as
        t(id, pipeline_id, table_name, extracted_at, rows_extracted, watermark_to, duration_seconds, status)""")
    out = health.pipeline_health(pipelines, spark.sql(RUNS), log, AS_OF)
    assert rows(out) == [
        ("p1", "failed", "2024-01-30 11:00", "60s", "—", "—", 2, 1, 50.0, "lo"),
        ("p2", "paused", "2024-01-02 10:00", "—", "—", "—", 1, 1, 100.0, "hi"),
        ("p3", "no runs", "—", "—", "—", "—", 0, 0, None, None),
    ]
    assert rows(health.latest_ingestion(log.filter("id = 1"))) == [
        ("p2", 7, Decimal("12.3"), "success", "2024-01-01 01:02:03.5")]
    assert rows(health.state_summary(out)) == [(0, 1, 1, 3)]


def test_run_lists(spark):
    runs = spark.sql(RUNS)
    listed = health.run_history(runs, 4)
    assert [r[1] for r in rows(listed)] == ["r2", "r1", "r9", "r0"]
    assert rows(health.run_history(runs))[-1][3:] == ("—", "—", "")
    assert "TakeOrderedAndProject" in plan_of(listed)
    assert rows(health.success_rate(runs, AS_OF)) == [("p1", 1, 1, 50.0)]
    found = health.search(spark.sql("select * from values ('A_b', null), ('c', 'x A_B y'), ('axb', 'z') as "
                                    "t(pipeline_id, description)"), "a_B")
    assert [r[0] for r in rows(found)] == ["A_b", "c"]


def test_half_a_percent_rounds_to_even(spark):
    from millrace.functions.labels import rate_tier, success_pct

    for ok, total in ((1, 16), (3, 16), (1, 3), (2, 3), (0, 5), (7, 8)):
        out = spark.range(1).select(success_pct(F.lit(ok), F.lit(total)).alias("p"))
        assert out.first()["p"] == round(ok / total * 100, 1)
    tiers = spark.sql("select * from values (90.0D), (89.9D), (70.0D), (69.9D), (null) as t(p)")
    assert [r[0] for r in rows(tiers.select(rate_tier(F.col("p"))))] == ["hi", "mid", "mid", "lo", None]


def test_task_lists(spark):
    tasks = spark.sql(f"""select 'p' pipeline_id, 'r' || id dag_run_id, 'ingestion' task_id, 'ingestion' stage,
        case when id % 2 = 0 then 'failed' else 'success' end state, cast(id % 3 as int) try_number,
        '{'e' * 100}' error_message, timestamp_ntz'2024-01-01' + make_dt_interval(0, id) started_at from range(50)""")
    failed = health.failed_tasks(tasks)
    listed = rows(failed)
    assert len(listed) == 20 and listed[0][5] == datetime.datetime(2024, 1, 3) and len(listed[0][4]) == 80
    assert "TakeOrderedAndProject" in plan_of(failed)
    assert rows(health.retry_counts(tasks)) == [("p", "ingestion", 2, 50)]
    assert rows(health.stage_state_counts(tasks)) == [("ingestion", "failed", 25), ("ingestion", "success", 25)]
    assert rows(health.task_success_pct(tasks)) == [(50.0,)]


def test_a_log_is_drawn_together_beside_a_writer(spark, tmp_path):
    """Many small files become a few; a row appended while they are read is not lost, and an old reader still can read."""
    path, schema = str(tmp_path / "log"), metadata.PIPELINE_RUNS

    def add(run, pipeline="p/1 {x}", state="success"):
        at = datetime.datetime(2024, 1, 1, 0, run % 60, tzinfo=datetime.timezone.utc)
        metadata.append_row(spark, path, schema, {"pipeline_id": pipeline, "dag_run_id": f"r{run}", "state": state, "created_at": at, "started_at": at,
                                                  "duration_seconds": Decimal("1.250")})

    for run in range(120):
        add(run, f"p{run % 3}" if run % 2 else "p/1 {x}")
    before = metadata.read_log(spark, path, schema)
    rows = sorted(map(str, before.collect()))
    assert len(rows) == 120 and len(before.inputFiles()) == 120 and {r.pipeline_id for r in before.collect()} == {"p0", "p1", "p2", "p/1 {x}"}
    state = metadata._snapshot(spark, path)
    assert metadata.compact_log(spark, path, schema) and not metadata.CommitLog(spark, f"{path}/_commits").commit(state, "snapshot", {})
    after = metadata.read_log(spark, path, schema)
    assert sorted(map(str, after.collect())) == rows == sorted(map(str, before.collect())) and len(after.inputFiles()) == 1
    assert sorted(map(str, metadata.current_runs(after).collect())) == sorted(map(str, metadata.current_runs(before).collect()))
    for run in range(120, 125):
        add(run, "p1")
    add(7, "p1", "failed")
    later = metadata.read_log(spark, path, schema)
    assert later.count() == 126 and len(later.inputFiles()) == 7
    assert later.filter("pipeline_id = 'p1'").count() == sum(1 for run in range(120) if run % 2 and run % 3 == 1) + 6
    assert "PushedFilters: [IsNotNull(pipeline_id), EqualTo(pipeline_id,p1)]" in plan_of(later.filter("pipeline_id = 'p1'"))
    # The second time, files that the first one holds are removed, as no reader needs them.
    assert metadata.compact_log(spark, path, schema, keep_hours=0)
    assert metadata.read_log(spark, path, schema).count() == 126 and len(metadata._small_files(spark, path)) == 6
    assert metadata.compact_log(spark, path, schema, keep_hours=0) and len(metadata._small_files(spark, path)) == 0
    assert metadata.read_log(spark, path, schema).count() == 126 and len(os.listdir(tmp_path / "log/_snapshots")) <= 4


def test_a_compaction_that_loses_or_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "log"), metadata.PIPELINE_LINEAGE
    for i in range(4):
        metadata.append_row(spark, path, schema, {"pipeline_id": f"p{i}", "source_type": "x", "updated_at": datetime.datetime(2024, 1, 1)})
    with monkeypatch.context() as patch:
        patch.setattr(metadata.CommitLog, "commit", lambda *args: False)
        assert not metadata.compact_log(spark, path, schema)
    assert metadata.read_log(spark, path, schema).count() == 4 and not [n for n in os.listdir(tmp_path / "log/_snapshots") if not n.startswith(".")]
    metadata.compact_log(spark, path, schema)
    assert not metadata.compact_if_many(spark, path, schema, "p1", 1) and metadata.read_log(spark, path, schema).count() == 4
    for _ in range(3):
        metadata.append_row(spark, path, schema, {"pipeline_id": "p1", "source_type": "y", "updated_at": datetime.datetime(2024, 1, 2)})
    assert metadata.compact_if_many(spark, path, schema, "p1", 2) and len(metadata.read_log(spark, path, schema).inputFiles()) == 1
    assert metadata.current_lineage(metadata.read_log(spark, path, schema)).filter("source_type = 'y'").count() == 1


def test_a_script_that_fails_leaves_all_as_it_was(spark):
    spark.sql("create or replace temp view kept as select 1 as n")
    spark.sql("create database if not exists layer")
    spark.sql("create or replace view layer.stays as select 'old' as t")
    script = """create or replace temp view kept as select 2 as n;
        create or replace view layer.stays as select 'new' as t;
        create view layer.made as select 3 as m; create table layer.rows using parquet as select 4 as r; insert into layer.rows select 5;
        create temp view another as select raise_error('third') as e; select e from another; select * from nowhere_at_all"""
    with pytest.raises(Exception):
        run_script(spark, script)
    assert spark.table("kept").first()["n"] == 1 and spark.table("layer.stays").first()["t"] == "old"
    assert not any(spark.catalog.tableExists(x) for x in ("layer.made", "layer.rows", "another"))
    good = run_script(spark, script.split("create temp view another")[0].strip().rstrip(";"))
    assert good.views == ["kept", "layer.stays", "layer.made"] and spark.table("kept").first()["n"] == 2
    assert sorted(r[0] for r in spark.table("layer.rows").collect()) == [4, 5]
    for change in ("insert into layer.rows select 6", "drop view layer.made", "select 1; DROP TABLE layer.rows", "insert overwrite layer.rows select 7", "truncate table layer.rows"):
        with pytest.raises(ValueError, match="atomic=False"):
            run_script(spark, change)
    run_script(spark, "select 'drop table x; insert into y'; -- drop table z\nselect 1")
    run_script(spark, "insert into layer.rows select 6", atomic=False)
    assert spark.table("layer.rows").count() == 3
    for statement in ("drop view layer.made", "drop view layer.stays", "drop table layer.rows", "drop database layer", "drop view kept"):
        spark.sql(statement)


def test_an_exporting_job_reads_each_raw_table_once(spark, tmp_path):
    """Rows of a raw table pass an accumulator of their own as they are read."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw = spark.range(50).selectExpr("cast(id as string) k", "cast(id % 3 as string) g").mapInArrow(counted, "k string, g string")
    spec = TableSpec("t", [ColumnSpec("k", "INTEGER"), ColumnSpec("g")], group_by=["g"], metrics=[MetricSpec("k", "SUM")])
    out = run_job(spark, JobSpec([spec]), {"t": raw}, export_to=str(tmp_path))
    assert seen.value == 50 and set(out) == {"clean_t", "analytics_t"}
    assert spark.read.csv(out["clean_t"], header=True).count() == 50 and spark.read.csv(out["analytics_t"], header=True).count() == 3
    assert spark.table("clean_t").count() == 50  # the views outlive the stage
