"""Aggregates, models and scripts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators.aggregate import aggregate
from millrace.operators.clean import clean
from millrace.plans.script import run_script
from millrace.queries.inputs import raw_tables, read, with_raw
from millrace.queries.registry import query
from millrace.session import shared_folder
from millrace.sinks.export import export_csv
from millrace.sources.csv import read_raw
from millrace.spec import ColumnSpec as Col
from millrace.spec import FilterSpec, MetricSpec, TableSpec

LINES = TableSpec("lineitem", [
    Col("l_orderkey", "INTEGER"), Col("l_linenumber", "INTEGER"), Col("l_quantity", "NUMERIC"),
    Col("l_extendedprice", "NUMERIC"), Col("l_returnflag"), Col("l_linestatus"), Col("l_shipdate", "DATE"),
])
ORDERS = TableSpec("orders", [
    Col("o_orderkey", "INTEGER"), Col("o_custkey", "INTEGER"), Col("o_orderstatus"), Col("o_totalprice", "NUMERIC"),
    Col("o_orderdate", "DATE"), Col("o_orderpriority"),
])
LINES_SQL = """, cleaned as (
    select cast(l_orderkey as integer) as l_orderkey, cast(l_linenumber as integer) as l_linenumber,
           cast(l_quantity as decimal(18,2)) as l_quantity, cast(l_extendedprice as decimal(18,2)) as l_extendedprice,
           l_returnflag, l_linestatus, cast(cast(l_shipdate as timestamp) as date) as l_shipdate
    from raw_lineitem) """
ORDERS_SQL = """, cleaned as (
    select cast(o_orderkey as integer) as o_orderkey, cast(o_custkey as integer) as o_custkey, o_orderstatus,
           cast(o_totalprice as decimal(18,2)) as o_totalprice,
           cast(cast(o_orderdate as timestamp) as date) as o_orderdate, o_orderpriority
    from raw_orders) """


def _lines(body):
    return with_raw("lineitem", LINES_SQL + body)


def _orders(body):
    return with_raw("orders", ORDERS_SQL + body)


def _agg(spark, sf_dir, spec, group_by, *metrics):
    return aggregate(clean(spec, raw_tables(spark, sf_dir)), group_by, metrics)


@query("agg_sum", _lines("""
    select l_returnflag, cast(sum(l_quantity) as double) as l_quantity_sum,
           cast(sum(l_linenumber) as bigint) as lines
    from cleaned group by l_returnflag"""))
def agg_sum(spark, sf_dir):
    return _agg(spark, sf_dir, LINES, ["l_returnflag"], MetricSpec("l_quantity", "SUM"),
                MetricSpec("l_linenumber", "sum", "lines"))


@query("agg_count", _orders("""
    select o_orderstatus, count(o_custkey) as o_custkey_count, count(o_orderpriority) as with_priority
    from cleaned group by o_orderstatus"""))
def agg_count(spark, sf_dir):
    return _agg(spark, sf_dir, ORDERS, ["o_orderstatus"], MetricSpec("o_custkey", "COUNT"),
                MetricSpec("o_orderpriority", "COUNT", "with priority"))


@query("agg_avg", _lines("""
    select l_linestatus, round(avg(l_extendedprice), 4) as l_extendedprice_avg,
           avg(l_linenumber) as l_linenumber_avg
    from cleaned group by l_linestatus"""))
def agg_avg(spark, sf_dir):
    result = _agg(spark, sf_dir, LINES, ["l_linestatus"], MetricSpec("l_extendedprice", "AVG"),
                  MetricSpec("l_linenumber", "AVG"))
    return result.withColumn("l_extendedprice_avg", F.round("l_extendedprice_avg", 4))


@query("agg_min_max", _orders("""
    select o_orderstatus, min(o_orderpriority) as o_orderpriority_min, max(o_orderpriority) as o_orderpriority_max,
           cast(min(o_totalprice) as double) as o_totalprice_min, cast(max(o_totalprice) as double) as o_totalprice_max,
           cast(min(o_orderdate) as varchar) as o_orderdate_min, cast(max(o_orderdate) as varchar) as o_orderdate_max
    from cleaned group by o_orderstatus"""))
def agg_min_max(spark, sf_dir):
    return _agg(spark, sf_dir, ORDERS, ["o_orderstatus"], *[
        MetricSpec(column, fn) for column in ("o_orderpriority", "o_totalprice", "o_orderdate") for fn in ("MIN", "MAX")
    ])


@query("agg_row_count", _orders("select o_orderpriority, count(*) as row_count from cleaned group by o_orderpriority"))
def agg_row_count(spark, sf_dir):
    return _agg(spark, sf_dir, ORDERS, ["o_orderpriority"], MetricSpec("*", "COUNT"))


@query("agg_group_multi", _orders("""
    select o_orderdate_text as o_orderdate, o_orderstatus, o_orderpriority,
           cast(sum(o_totalprice) as double) as revenue, count(*) as orders
    from (select *, cast(o_orderdate as varchar) as o_orderdate_text from cleaned)
    group by o_orderdate_text, o_orderstatus, o_orderpriority"""))
def agg_group_multi(spark, sf_dir):
    return _agg(spark, sf_dir, ORDERS, ["o_orderdate", "o_orderstatus", "o_orderpriority"],
                MetricSpec("o_totalprice", "SUM", "revenue"), MetricSpec("", "COUNT", "orders"))


@query("agg_global", _lines("""
    select count(*) as row_count, cast(sum(l_extendedprice) as double) as l_extendedprice_sum,
           cast(max(l_shipdate) as varchar) as l_shipdate_max, count(l_quantity) as l_quantity_count
    from cleaned"""))
def agg_global(spark, sf_dir):
    return _agg(spark, sf_dir, LINES, [], MetricSpec("*", "COUNT"), MetricSpec("l_extendedprice", "SUM"),
                MetricSpec("l_shipdate", "MAX"), MetricSpec("l_quantity", "COUNT"))


@query("status_totals", _lines("""
    select l_returnflag, count(*) as charges, cast(round(sum(l_extendedprice), 2) as double) as total
    from cleaned where l_linestatus = 'F' group by l_returnflag"""))
def status_totals(spark, sf_dir):
    spec = TableSpec("lineitem", LINES.columns, filters=[FilterSpec("l_linestatus", "=", "F")])
    totals = _agg(spark, sf_dir, spec, ["l_returnflag"], MetricSpec("*", "COUNT", "charges"),
                  MetricSpec("l_extendedprice", "SUM", "total"))
    return totals.orderBy(F.col("total").desc(), "l_returnflag")


@query("staging_model", """
    select extract(year from o_orderdate) * 12 + extract(month from o_orderdate) - 1 as month_no, o_orderpriority as priority,
           count(o_orderkey) as orders, cast(max(cast(o_totalprice as decimal(18,2))) as double) as dearest
    from orders where o_orderstatus <> 'P' group by 1, 2""")
def staging_model(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("raw_orders")
    return run_script(spark, """
        create or replace temp view settled_orders as
        select year(o_orderdate) * 12 + month(o_orderdate) - 1 as month_no, o_orderpriority, cast(o_totalprice as decimal(18,2)) as price
        from raw_orders where o_orderstatus <> 'P';
        select cast(month_no as bigint) as month_no, o_orderpriority as priority, count(price) as orders, max(price) as dearest
        from settled_orders group by all;
    """).result


@query("sql_script", """
    select concat(l_returnflag, ';', l_linestatus) as flags, count(*) as items,
           cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity
    from lineitem group by 1""")
def sql_script(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("script_lineitem")
    views = run_script(spark, """
        CREATE OR REPLACE TEMPORARY VIEW script_flags AS
        SELECT concat(l_returnflag, ';', l_linestatus) AS flags, CAST(l_quantity AS DECIMAL(18,2)) AS quantity
        FROM script_lineitem; -- a comment; not a statement
        CREATE OR REPLACE TEMPORARY VIEW script_totals AS
        SELECT flags, COUNT(*) AS items, SUM(quantity) AS quantity FROM script_flags GROUP BY flags;
    """).views
    return spark.table(views[-1])


@query("sql_params", """
    select o_orderstatus as status, count(*) as orders
    from orders where o_orderdate >= timestamp '1997-01-01' and o_totalprice >= 1000.5 group by 1""")
def sql_params(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("script_orders")
    return run_script(spark, """
        SELECT o_orderstatus AS status, COUNT(*) AS orders FROM script_orders
        WHERE o_orderdate >= :since AND o_totalprice >= :floor GROUP BY o_orderstatus
    """, {"since": datetime(1997, 1, 1), "floor": 1000.5}).result


@query("export_roundtrip", _orders("""
    select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice,
           cast(o_orderdate as varchar) as o_orderdate, o_orderpriority from cleaned"""))
def export_roundtrip(spark, sf_dir):
    cleaned = clean(ORDERS, raw_tables(spark, sf_dir))
    path = export_csv(cleaned, shared_folder(spark, "export"), "orders", datetime(2024, 1, 31, 12))
    return clean(ORDERS, {"orders": read_raw(spark, path)})
