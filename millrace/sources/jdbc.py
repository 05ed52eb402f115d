"""Database tables through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, *, partition_column: str | None = None, lower: object = None,
                 upper: object = None, partitions: int | None = None, fetch_size: int = 10_000,
                 **properties: str) -> dict[str, str]:
    """Reader options. Without a partition column one task reads the table, over one connection;
    with it, ``partitions`` tasks each read a range (the bounds only place the cuts, no row is lost)."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true", **properties}
    if partition_column is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs lower, upper and partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """The table, lazily; filters on it run in the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
