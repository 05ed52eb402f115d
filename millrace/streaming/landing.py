"""Land files as they arrive.

The batch form reads every matching file again on each run. Here a stream of file names remembers which files are done, so a run costs
only what is new. Each batch of names is read as the batch form reads files, in splits, so that a file of any size is many tasks, and lands
in one step under the number of the batch; a batch that is repeated, as executors or the driver were lost on the way, adds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.sinks.versions import Versions
from millrace.sources.csv import read_raw
from millrace.sources.files import as_pattern

#: Names in a batch at most; what is more waits for the next one.
BATCH_FILES = 10_000


def stream_names(spark: SparkSession, path: str, *, glob: str = "*.csv", batch_files: int = BATCH_FILES) -> DataFrame:
    """The paths of new files below ``path`` as a stream; no content is read."""
    reader = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
    return reader.options(pathGlobFilter=glob, recursiveFileLookup=True, maxFilesPerTrigger=batch_files).load(path).select("path")


def land_batch(spark: SparkSession, paths: Sequence[str], dest: str, ds: str, stream: str, batch: int, header: Sequence[str] | None = None,
               multi_line: bool | None = None) -> None:
    """Land the rows of some files as one part of ``dest``, unless this batch of the stream has landed before, on whatever day."""
    table, source = Versions(spark, dest), f"{stream}-{batch}"
    if any(key.endswith(f"/source={source}") for key in table.parts()):
        return
    rows = read_raw(spark, [as_pattern(p) for p in paths], header=header, provenance=True, multi_line=multi_line)
    table.replace(rows, {"ds": ds, "source": source}, files=len(paths))


def land_new_files(spark: SparkSession, path: str, dest: str, checkpoint: str, ds: str, header: Sequence[str] | None = None, *,
                   glob: str = "*.csv", batch_files: int = BATCH_FILES, multi_line: bool | None = None) -> StreamingQuery:
    """Land what is new since the last call into ``dest``, under ``ds``, and stop; ``landed`` reads it.

    Each file must have the given header, or that of the first file of its batch. A row with more cells than the header fails the
    batch, which is tried again by the next call.
    """
    stream = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def land(names: DataFrame, batch: int) -> None:
        paths = sorted(r["path"] for r in names.collect())  # names only, at most ``batch_files``
        if paths:
            land_batch(names.sparkSession, paths, dest, ds, stream, batch, header, multi_line)

    query = stream_names(spark, path, glob=glob, batch_files=batch_files).writeStream.foreachBatch(land).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
