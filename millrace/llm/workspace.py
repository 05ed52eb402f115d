"""Tables written to the shared folder, so that later steps do not depend on executors that may be lost."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import remove_folder, shared_folder


#: Rows of a few numbers each that may be broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 300_000


def small(kept: DataFrame, most: int = BROADCAST_ROWS, lists: str | None = None) -> DataFrame:
    """A kept table for the small side of a join: broadcast if its rows, or the elements of its column ``lists``, are few."""
    n = kept.count() if lists is None else kept.agg(F.sum(F.size(lists))).first()[0] or 0
    return F.broadcast(kept) if n <= most else kept


_open_scopes: list[list["Workspace"]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Remove all workspaces made inside when it ends; what was computed from them must be written by then."""
    made: list[Workspace] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for space in made:
            space.remove()


class Workspace:
    """A new folder below ``spark.checkpoint.dir`` for the tables of one run of an operator.

    Results read these tables, so they stay until ``remove``, the end of a ``temporary`` scope or of this process.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.folder = spark, shared_folder(spark, purpose)
        self.count = 0
        for scope in _open_scopes:
            scope.append(self)

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a table written here."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

