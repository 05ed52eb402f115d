"""Tables that are replaced as a whole, or part by part, without a moment in which the old rows are gone and the new ones not there.

Rows are written to a new folder below ``_data``; then one commit says that this folder is the part's content. Readers go by the
commits, so they see the old version or the new one, and a job that dies while it writes changes nothing. Folders that no commit names any more
stay for readers that began before, and are removed when they are older than ``keep_hours``.

The names begin with an underscore, so Spark does not take the folder of such a table for a plain one with all versions in it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

from millrace.sinks.commits import CommitLog, Files

#: How long folders stay that are no version any more.
KEEP_HOURS = 24.0


class Versions:
    """The table at ``path``: one part per key, whose folders also name the values of ``layout`` columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = CommitLog(spark, f"{self.path}/_commits")
        self.data = f"{self.path}/_data"

    def replace(self, df: DataFrame, layout: Mapping[str, str] | None = None, partition_by: Sequence[str] = (), fmt: str = "parquet",
                keep_hours: float = KEEP_HOURS, **facts) -> str:
        """Replace one part, named by its ``layout`` values, and return its folder. ``facts`` are kept with the commit."""
        layout = dict(layout or {})
        key = "/".join(f"{k}={v}" for k, v in layout.items())
        if any("/" in v or v.startswith((".", "_")) or not v for v in layout.values()):
            raise ValueError(f"{key!r} cannot name a folder")
        folder = "/".join(filter(None, (key, f"version={uuid.uuid4().hex}")))
        df.write.partitionBy(*partition_by).format(fmt).save(f"{self.data}/{folder}")
        self.commits.force(key, {"folder": folder, "format": fmt, "schema": json.loads(df.schema.json()), "layout": list(layout), **facts})
        self.commits.trim()
        self.clean(keep_hours)
        return f"{self.data}/{folder}"

    def parts(self) -> dict[str, dict]:
        """What was committed for each part."""
        return self.commits.state().entries

    def exists(self) -> bool:
        return bool(self.parts())

    def read(self) -> DataFrame:
        """The rows of all parts, with the columns of their layout; one version of each, as they are now."""
        parts = list(self.parts().values())
        if not parts:
            raise FileNotFoundError(f"no table at {self.path}")
        schemas = {json.dumps(p["schema"], sort_keys=True) for p in parts}
        reader = self.spark.read.format(parts[0]["format"]).option("basePath", self.data)
        if len(schemas) == 1:
            schema = StructType.fromJson(parts[0]["schema"])
            names = list(schema.names)
            for c in parts[0]["layout"]:
                schema, names = schema.add(c, StringType()), [*names, c]
            found = reader.schema(schema).load([f"{self.data}/{p['folder']}" for p in parts])
            return found.select(*[f"`{c}`" for c in names])
        return reader.option("mergeSchema", True).load([f"{self.data}/{p['folder']}" for p in parts]).drop("version")

    def clean(self, keep_hours: float = KEEP_HOURS) -> int:
        """Remove versions that no commit names, that nobody is writing and that are older than this; return how many."""
        named = {p["folder"] for p in self.parts().values()}
        before = time.time() * 1000 - keep_hours * 3_600_000
        removed = 0
        for parent, name, changed in _versions(self.spark, self.data):
            folder = f"{parent}{name}"
            if folder not in named and changed < before and "_temporary" not in Files(self.spark, f"{self.data}/{folder}").names():
                Files(self.spark, f"{self.data}/{parent}").remove(name)
                removed += 1
        return removed


def _versions(spark: SparkSession, data: str, parent: str = ""):
    for name, changed in Files(spark, f"{data}/{parent}").names().items():
        if name.startswith("version="):
            yield parent, name, changed
        elif "=" in name:
            yield from _versions(spark, data, f"{parent}{name}/")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of versions, or a plain folder of files."""
    table = Versions(spark, path)
    return table.read() if table.exists() else spark.read.format(fmt).load(path)
