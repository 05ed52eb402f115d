"""Table cleaning, incremental extraction and pipeline reports on Spark."""

from millrace.operators.aggregate import aggregate
from millrace.operators.clean import clean
from millrace.operators.infer import infer_types
from millrace.operators.profile import FolderProfile
from millrace.plans.incremental import IncrementalExtract
from millrace.plans.script import run_script
from millrace.plans.upload import load_csv
from millrace.plans.job import build_table, build_tables, run_catalog_job, run_job
from millrace.reports.recorder import RunLog
from millrace.sinks.versions import Versions, read_table
from millrace.sources.csv import read_raw, scan_csv, store_csv
from millrace.sources.files import FileManifest, land_files, landed
from millrace.spec import (
    ColumnSpec, ComputedSpec, FilterSpec, JobSpec, JoinSpec, MetricSpec, SpecError, TableSpec,
)
from millrace.streaming.landing import land_new_files

__all__ = [
    "ColumnSpec", "ComputedSpec", "FileManifest", "FilterSpec", "FolderProfile", "IncrementalExtract",
    "JobSpec", "JoinSpec", "MetricSpec", "RunLog", "SpecError", "TableSpec", "Versions", "aggregate",
    "build_table", "build_tables", "clean", "infer_types", "land_files", "land_new_files", "landed",
    "load_csv", "read_raw", "read_table", "run_catalog_job", "run_job", "run_script", "scan_csv", "store_csv",
]
