import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from millrace.operators.clean import clean
from millrace.spec import ColumnSpec as Col
from millrace.spec import ComputedSpec, JoinSpec, TableSpec


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def joined(how, tables, salt=0):
    return clean(TableSpec(
        "a", [Col("id")], joins=[JoinSpec("b", "k", "k", how, salt=salt)], computed=[ComputedSpec("v", "b.v")],
    ), tables)


@pytest.fixture
def tables(raw):
    return {"a": raw("id k", ("1", "x"), ("2", "01"), ("3", None), ("4", "q")),
            "b": raw("k v", ("x", "p"), ("x", "r"), ("1", "s"), (None, "t"), ("q", "u"))}


EXPECTED = {
    "INNER": [("1", "p"), ("1", "r"), ("4", "u")],
    "LEFT": [("1", "p"), ("1", "r"), ("2", None), ("3", None), ("4", "u")],
    "RIGHT": [("1", "p"), ("1", "r"), ("4", "u"), (None, "s"), (None, "t")],
}


@pytest.mark.parametrize("salt", [0, 1, 5])
@pytest.mark.parametrize("how", EXPECTED)
def test_keys_compare_as_text_and_null_never_matches(how, salt, tables):
    assert rows(joined(how, tables, salt)) == EXPECTED[how]


def test_chain_uses_the_base_key_each_time_and_may_repeat_a_table(raw):
    tables = {"a": raw("id p q", ("1", "x", "y"), ("2", "y", "z")), "b": raw("k v", ("x", "X"), ("y", "Y"))}
    spec = TableSpec("a", [Col("id")], joins=[
        JoinSpec("b", "p", "k"), JoinSpec("b", "q", "k", alias="other", salt=3),
        JoinSpec("a", "p", "q", "LEFT", alias="self"),
    ], computed=[ComputedSpec("l", "b.v"), ComputedSpec("r", "other.v"), ComputedSpec("s", "self.id")])
    assert rows(clean(spec, tables)) == [("1", "X", "Y", None), ("2", "Y", None, "1")]


@pytest.mark.parametrize("how", ["INNER", "LEFT", "RIGHT"])
def test_salt_spreads_a_hot_key_without_changing_the_result(spark, how):
    # A third of all rows holds one key, and most of those are copies of one row.
    base = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("id"))
    other = spark.range(0, 3000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    other = other.union(spark.sql("select 'hot', 'h1' union all select 'hot', 'h2'"))
    tables = {"a": base, "b": other} if how != "RIGHT" else {"a": other.toDF("k", "id"), "b": base.toDF("k", "v")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, salted = joined(how, tables), joined(how, tables, salt=8)
        assert "SortMergeJoin" in plan_of(salted)
        counted = [df.groupBy("id", "v").count() for df in (plain, salted)]
        assert counted[0].exceptAll(counted[1]).isEmpty() and counted[1].exceptAll(counted[0]).isEmpty()
        assert "_millrace" not in " ".join(salted.columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_is_split_in_each_of_two_joins_on_it(spark):
    hot = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
    base = spark.range(0, 200_000, 1, 8).select(hot.alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("id"))
    other = spark.range(0, 2000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    other = other.union(spark.sql("select 'hot', 'h'"))
    spec = TableSpec("a", [Col("id")], joins=[JoinSpec("b", "k", "k", "LEFT"), JoinSpec("c", "k", "k", "LEFT")],
                     computed=[ComputedSpec("v", "b.v"), ComputedSpec("w", "c.v")])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200000",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = clean(spec, {"a": base, "b": other, "c": other})
        assert df.groupBy("v", "w").count().filter("v = 'h' and w = 'h'").first()["count"] == 100_000
        df.collect()
        assert plan_of(df).count("SortMergeJoin(skew=true) LeftOuter") == 2
    finally:
        for key in settings:
            spark.conf.unset(key)
