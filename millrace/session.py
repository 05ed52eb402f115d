"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Settings that only apply where the cluster has not chosen its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where a later join on the same key then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "millrace", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings this library is tested under."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unique folder below ``spark.checkpoint.dir``. ``remove_folder`` removes it; what is left goes when this process ends.

    Every executor must be able to read what another one wrote there, so a machine-local folder is
    only accepted for a local master, where all executors are on this machine anyway.
    """
    name = f"millrace-{purpose}-{uuid.uuid4().hex[:12]}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = f"{base.rstrip('/')}/{name}"
        if not _FOLDERS:
            atexit.register(_remove_all)
        _FOLDERS[folder] = spark.sparkContext._jsc.hadoopConfiguration()
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base}/{name}"


#: Folders of this process that are still there, with the settings under which they were made.
_FOLDERS: dict = {}


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder and all that is in it, on any file system that Spark reads."""
    settings = _FOLDERS.pop(folder, None) or spark.sparkContext._jsc.hadoopConfiguration()
    path = SparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(settings).delete(path, True)


def _remove_all() -> None:
    for folder in list(_FOLDERS):
        try:
            remove_folder(None, folder)
        except Exception:
            pass  # the gateway or the file system may be gone; nothing reads these folders any more


def is_ansi(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.ansi.enabled", "true").lower() == "true"
