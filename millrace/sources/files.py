"""File listings, and landing files under a dated folder."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.latest import latest_by
from millrace.sinks.versions import Versions

log = logging.getLogger(__name__)


def list_files(spark: SparkSession, path: str | Sequence[str], *, glob: str | None = None,
               recursive: bool = True) -> DataFrame:
    """``(path, modified_at, length)`` of every file; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified_at"), "length")


def latest_file(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The file modified last, per ``keys`` if given; of two with one time the greater path."""
    return latest_by(files, keys, ["modified_at", "path"])


def as_pattern(path: str) -> str:
    """A file's path for a reader, which takes paths as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


class FileManifest:
    """What lay in a folder when it was last looked at: a stored listing, and what has changed since."""

    def __init__(self, spark: SparkSession, path: str):
        self._kept = Versions(spark, path)

    def listing(self) -> DataFrame:
        """``(path, modified_at, length)`` as it was kept last."""
        return self._kept.read()

    def refresh(self, files: DataFrame) -> DataFrame:
        """Keep ``files`` as ``list_files`` gives them, and return how they differ from what was kept before.

        Gives path, modified_at, length and change: ``new``, ``changed`` (another time or length) or ``deleted``, with the old time and
        length. Both listings are stored, so the answer does not change when files come and go; nothing of them passes the driver.
        """
        before = self._kept.read() if self._kept.exists() else files.limit(0)
        self._kept.replace(files.select("path", "modified_at", "length"))
        now = self._kept.read().select("path", F.struct("modified_at", "length").alias("now"))
        both = now.join(before.select("path", F.struct("modified_at", "length").alias("old")), "path", "full")
        change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("old"), "changed")
        return both.withColumn("change", change).filter("change is not null").select("path", F.coalesce("now", "old").alias("file"), "change").select(
            "path", "file.*", "change")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def decoded_path(path: Column) -> Column:
    """File paths in ``_metadata`` are percent-encoded; a plus sign stands for itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


@dataclass(frozen=True)
class Landing:
    files: int
    path: str | None


def land_files(spark: SparkSession, path: str, dest: str, ds: str, *, glob: str = "*.csv",
               multi_line: bool | None = None) -> Landing:
    """Land every matching file below ``path`` as raw rows of the day ``ds`` in ``dest``.

    Each row keeps the full path of its file, so equal names in different folders stay apart. Each source (path and
    glob) is a part of its own of the day; landing it again on the same day replaces that part alone, and ``landed`` reads the old rows
    until all new ones are there. No matching file is a warning, not an error; a row with more cells than the header is an error.
    """
    from millrace.sources.csv import read_raw

    source = hashlib.sha1(f"{path.rstrip('/')}\n{glob}".encode()).hexdigest()[:12]
    count = list_files(spark, path, glob=glob).count()
    if count == 0:
        log.warning("no files match %s below %s", glob, path)
        return Landing(0, None)
    rows = read_raw(spark, path, glob=glob, recursive=True, multi_line=multi_line, provenance=True)
    return Landing(count, Versions(spark, dest).replace(rows, {"ds": ds, "source": source}))


def landed(spark: SparkSession, dest: str) -> DataFrame:
    """All landed rows, with their ``ds`` and ``source``."""
    return Versions(spark, dest).read()
