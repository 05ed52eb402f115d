"""Column profiles of files that merge: adding a file reads that file, and no other.

The profile of a file has a row per column: how many rows and filled cells there are, which types all cells fit, and the first values.
All of these combine by file (sums, common bits, the values of the first file), so the profile of a folder is that of its files
put together. What was profiled is kept; a file whose time or length has changed is profiled anew, and one that is gone no longer counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.cells import normalize_cells
from millrace.functions.names import safe_names
from millrace.operators.infer import fitting_types, type_of_bits
from millrace.operators.sample import SAMPLE_ROWS, SAMPLE_VALUES
from millrace.sinks.versions import Versions
from millrace.sources.csv import PLACE, first_header, scan_records
from millrace.sources.files import as_pattern, decoded_path, list_files


def profile_files(spark: SparkSession, paths: Sequence[str], header: Sequence[str | None]) -> DataFrame:
    """``(path, ordinal, column, rows, filled, bits, head)`` of CSV files with this header."""
    names = safe_names(header)
    rows = scan_records(spark, [as_pattern(p) for p in paths], header, names)
    # A file's first records lie at its start; the header is the first.
    at = {c: F.col(f"{PLACE}.{c}") for c in ("file", "block", "n")}
    near = (at["block"] == 0) & (at["n"] <= SAMPLE_ROWS + 1)
    cells = normalize_cells(rows, names).select(at["file"].alias("file"), at["n"].alias("n"), near.alias("near"), F.posexplode(F.array(*[f"`{c}`" for c in names])).alias("ordinal", "cell"))
    fits = cells.withColumn("bits", F.expr(fitting_types("cell")))
    first = F.sort_array(F.collect_list(F.when(F.col("near") & F.col("cell").isNotNull(), F.struct("n", "cell"))))  # at most SAMPLE_ROWS
    found = fits.groupBy("file", "ordinal").agg(F.count("*").alias("rows"), F.count("cell").alias("filled"), F.bit_and("bits").alias("bits"), first.alias("head"))
    values = F.slice(F.transform("head", lambda x: x["cell"]), 1, SAMPLE_VALUES)
    column = F.element_at(F.array(*map(F.lit, names)), F.col("ordinal") + 1)
    # As a listing names the file: metadata has an empty host and escapes.
    path = F.regexp_replace(decoded_path(F.col("file")), "^([a-z0-9+.-]+):///", "$1:/")
    return found.select(path.alias("path"), "ordinal", column.alias("column"), "rows", "filled", "bits", values.alias("head"))


def merged(profiles: DataFrame) -> DataFrame:
    """``(ordinal, column, type, rows, filled, samples)``: the profiles of files put together. The samples are those of the first file that has any."""
    first = F.min_by("head", F.when(F.size("head") > 0, F.col("path")))
    found = profiles.groupBy("ordinal", "column").agg(F.bit_and("bits").alias("bits"), F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), first.alias("samples"))
    return found.select("ordinal", "column", F.expr(type_of_bits("bits")).alias("type"), "rows", "filled", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


class FolderProfile:
    """The kept profiles, at ``path``, of the CSV files below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, path: str, *, glob: str = "*.csv"):
        self.spark, self.folder, self.glob = spark, folder, glob
        self._kept = Versions(spark, path)

    def refresh(self) -> int:
        """Profile what is new or has changed, forget what is gone, and return how many files were read."""
        listing = list_files(self.spark, self.folder, glob=self.glob)
        parts = self._kept.parts()
        if not parts:
            header, fresh, old = first_header(self.spark, self.folder, self.glob), listing, None
        else:
            header, old = next(iter(parts.values()))["header"], self._kept.read()
            same = ["path", "modified_at", "length"]
            fresh, old = listing.join(old.select(*same).distinct(), same, "left_anti"), old.join(listing.select(*same), same, "left_semi")
        fresh = fresh.select("path", "modified_at", "length").collect()  # names of new files only
        rows = None if old is None else old.select(*_COLUMNS)
        if fresh:
            known = self.spark.createDataFrame(fresh, "path string, modified_at timestamp, length long")
            made = profile_files(self.spark, [r["path"] for r in fresh], header).join(F.broadcast(known), "path").select(*_COLUMNS)
            rows = made if rows is None else rows.unionByName(made)
        if rows is not None:
            self._kept.replace(rows.coalesce(1), header=list(header))  # a row per file and column
        return len(fresh)

    def columns(self) -> DataFrame:
        """``merged`` over all files, from what is kept."""
        return merged(self._kept.read())


_COLUMNS = ["path", "modified_at", "length", "ordinal", "column", "rows", "filled", "bits", "head"]
