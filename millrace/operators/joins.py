"""Left-deep chains of equi-joins between raw tables.

Join strategy and skew handling are left to adaptive execution, which splits a hot partition of the
row-keeping side. ``JoinSpec.salt`` does the same by hand where adaptive execution is off or where
the joined rows are grouped by the join key right after. A salted join keeps later filters from
moving below it, since the salt depends on the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from millrace.functions.names import safe_name
from millrace.spec import JoinSpec, SpecError

Tables = Mapping[str, DataFrame] | Callable[[str], DataFrame]

_SALT = "_millrace_salt"


def table_of(tables: Tables, name: str) -> DataFrame:
    """Look a raw table up by its normalised name."""
    if callable(tables):
        return tables(safe_name(name))
    for known, df in tables.items():
        if safe_name(known) == safe_name(name):
            return df
    raise SpecError(f"unknown table {name!r}")


def join_chain(base: DataFrame, base_name: str, joins: list[JoinSpec], tables: Tables) -> DataFrame:
    """``base`` joined with every table in turn; the left key is always a column of the base table."""
    result = base.alias(base_name)
    for join in joins:
        result = _join(result, base_name, table_of(tables, join.table), join)
    return result


def _join(left: DataFrame, base_name: str, right: DataFrame, join: JoinSpec) -> DataFrame:
    left_key = F.col(f"{base_name}.{safe_name(join.left_col)}").cast("string")
    right_key = F.col(f"{join.name}.{safe_name(join.right_col)}").cast("string")
    how = join.how.lower()
    if join.salt < 2:
        return left.join(right.alias(join.name), left_key == right_key, how)

    # Each row of the keeping side gets one salt and meets exactly one copy of its partners. The salt
    # depends on the scan partition too, so that a mass of equal rows is spread, and only on things
    # that a recomputed task sees again.
    copies = F.explode(F.sequence(F.lit(0), F.lit(join.salt - 1)))
    keep_right = how == "right"
    spread, copied = (right, left) if keep_right else (left, right)
    salt = F.pmod(F.xxhash64("*", F.spark_partition_id()), F.lit(join.salt)).cast("int")
    side, other = f"{_SALT}_{join.name}_l", f"{_SALT}_{join.name}_r"
    if keep_right:
        left, right = copied.withColumn(side, copies), spread.withColumn(other, salt)
    else:
        left, right = spread.withColumn(side, salt), copied.withColumn(other, copies)
    joined = left.join(
        right.alias(join.name),
        (left_key == right_key) & (F.col(side) == F.col(f"{join.name}.{other}")),
        how,
    )
    return joined.drop(side, other)

