"""Run a whole cleaning job: every table's clean view and, with metrics, its analytics view."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.names import safe_name
from millrace.operators.aggregate import aggregate, aggregate_sql
from millrace.operators.clean import clean, clean_sql
from millrace.operators.joins import Tables
from millrace.plans.script import run_script
from millrace.reports.recorder import RunLog
from millrace.session import remove_folder, shared_folder
from millrace.sinks.export import export_csv
from millrace.sinks.versions import Versions
from millrace.sinks.views import catalog_view, create_view
from millrace.spec import JobSpec, TableSpec


@dataclass(frozen=True)
class TableResult:
    clean: DataFrame
    analytics: DataFrame | None


def build_table(spec: TableSpec, tables: Tables) -> TableResult:
    cleaned = clean(spec, tables)
    return TableResult(cleaned, aggregate(cleaned, spec.group_by, spec.metrics) if spec.metrics else None)


def build_tables(specs: Iterable[TableSpec], tables: Tables) -> dict[str, TableResult]:
    """All tables of a job, lazily; nothing runs until a result is read or written."""
    return {spec.name: build_table(spec, tables) for spec in specs}


def run_job(spark: SparkSession, job: JobSpec, tables: Tables, *, store_at: str | None = None,
            export_to: str | None = None, at: datetime | None = None,
            partition_by: Mapping[str, Sequence[str]] | None = None, log: RunLog | None = None) -> dict[str, str | None]:
    """Create the views of a job and, with ``export_to``, a CSV snapshot of each.

    Returns view name to snapshot folder. Views are lazy, so each reader computes them again;
    ``store_at`` writes each clean table there once, as Parquet, and puts the views on top of that. An export without ``store_at``
    computes each clean table once too, into an intermediate folder that goes with the job, and both its snapshots come from there.
    ``partition_by`` names, for a table, the columns that its stored form is partitioned by.
    With ``custom_sql`` the script runs in place of the generated views; it sees the raw tables as
    ``raw_<table>``. With ``log`` the run, its tasks and its lineage are logged, also when it fails.
    """
    def script() -> dict[str, DataFrame]:
        given = {name: tables(name) for name in _table_names(job)} if callable(tables) else tables
        for name, df in given.items():
            create_view(df, "raw", name)
        return _by_view(spark, run_script(spark, job.custom_sql).views)

    def build(spec: TableSpec) -> dict[str, DataFrame]:
        cleaned = clean(spec, tables)
        if store_at is not None:
            stored = Versions(spark, f"{store_at.rstrip('/')}/{spec.name}")
            stored.replace(cleaned, partition_by=(partition_by or {}).get(spec.name, ()))
            cleaned = stored.read()
        views = [create_view(cleaned, "clean", spec.name)]
        if spec.metrics:
            views.append(create_view(aggregate(cleaned, spec.group_by, spec.metrics), "analytics", spec.name))
        return _outputs(views, cleaned, spec, staged if store_at is None else None)

    with _staging(spark, export_to is not None and store_at is None) as staged:
        return _run(spark, job, script, build, export_to, at, log)


def run_catalog_job(spark: SparkSession, job: JobSpec, *, export_to: str | None = None, at: datetime | None = None,
                    log: RunLog | None = None) -> dict[str, str | None]:
    """The same over ``raw.<table>`` of the catalog, as views ``clean.<table>`` and ``analytics.<table>`` that stay there.

    A view is kept as SQL text, so other sessions on the same catalog read it too. ``custom_sql`` runs as
    it is and names tables as the catalog does.
    """
    def tables(name: str) -> DataFrame:
        return spark.table(f"raw.`{name}`")

    def script() -> dict[str, DataFrame]:
        return _by_view(spark, run_script(spark, job.custom_sql).views)

    def build(spec: TableSpec) -> dict[str, DataFrame]:
        views = [catalog_view(spark, clean_sql(spec, tables), "clean", spec.name)]
        if spec.metrics:
            text = aggregate_sql(spark.table(views[0]).schema, views[0], spec.group_by, spec.metrics)
            views.append(catalog_view(spark, text, "analytics", spec.name))
        return _outputs(views, spark.table(views[0]), spec, staged)

    with _staging(spark, export_to is not None) as staged:
        return _run(spark, job, script, build, export_to, at, log)


def _by_view(spark: SparkSession, views: list[str]) -> dict[str, DataFrame]:
    return {view: spark.table(view) for view in views}


def _outputs(views: list[str], cleaned: DataFrame, spec: TableSpec, staged: str | None) -> dict[str, DataFrame]:
    """The rows of a table's views; with a folder to stage them in, the clean rows are computed once for both."""
    if staged is not None:
        stage = Versions(cleaned.sparkSession, f"{staged}/{spec.name}")
        stage.replace(cleaned)
        cleaned = stage.read()
    rows = [cleaned] + ([aggregate(cleaned, spec.group_by, spec.metrics)] if spec.metrics else [])
    return dict(zip(views, rows))


@contextmanager
def _staging(spark: SparkSession, wanted: bool) -> Iterator[str | None]:
    """A folder for what several outputs share, as long as the job runs."""
    folder = shared_folder(spark, "job") if wanted else None
    try:
        yield folder
    finally:
        if folder:
            remove_folder(spark, folder)


def _run(spark, job, script, build, export_to, at, log) -> dict[str, str | None]:
    def task(name: str):
        return log.task(name) if log else nullcontext()

    with log.run() if log else nullcontext():
        if log:
            log.lineage(source_type="raw", source_location=", ".join(_table_names(job)),
                        transform_type="sql" if job.custom_sql else "spec", transform_target=", ".join(t.name for t in job.tables),
                        delivery_type="csv" if export_to else None, delivery_location=export_to)
        views: dict[str, DataFrame] = {}
        if job.custom_sql:
            with task("transformation.custom_sql"):
                views |= script()
        else:
            for spec in job.tables:
                with task(f"transformation.{spec.name}"):
                    views |= build(spec)
        if export_to is None:
            return dict.fromkeys(views)
        at = at or datetime.now(timezone.utc).replace(tzinfo=None)
        done = {}
        for view, rows in views.items():
            with task(f"delivery.{view}"):
                done[view] = export_csv(rows, export_to, view, at)
        return done


def _table_names(job: JobSpec) -> list[str]:
    return list(dict.fromkeys(safe_name(name) for spec in job.tables for name in (spec.table, *(join.table for join in spec.joins))))
