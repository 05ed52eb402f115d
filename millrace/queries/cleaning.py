"""Projections, casts, conditions and joins."""

from __future__ import annotations

from millrace.functions.cells import strip_cell
from millrace.operators.clean import clean
from millrace.plans.job import build_table, run_catalog_job, run_job
from millrace.queries.inputs import CELLS, cells, raw, raw_tables, with_raw
from millrace.queries.registry import query
from millrace.sinks.views import catalog_view
from millrace.spec import ColumnSpec as Col
from millrace.spec import ComputedSpec, FilterSpec, JobSpec, JoinSpec, MetricSpec, TableSpec

KEY = Col("o_orderkey", "INTEGER")
KEY_SQL = "cast(o_orderkey as integer) as o_orderkey"
DATE_SQL = "cast(cast(cast(o_orderdate as timestamp) as date) as varchar)"


def _clean(spark, sf_dir, *columns, table="orders", **parts):
    return clean(TableSpec(table, columns, **parts), raw_tables(spark, sf_dir))


@query("normalize_cells", with_raw("orders", "select * from raw_orders"))
def normalize_cells(spark, sf_dir):
    return raw(spark, sf_dir, "orders")


@query("project_rename", with_raw("orders", """
    select o_orderkey as order_id, o_orderstatus as order_status, o_totalprice from raw_orders"""))
def project_rename(spark, sf_dir):
    return _clean(spark, sf_dir, Col("o_orderkey", output_name="Order ID"), Col("o_custkey", include=False),
                  Col("O_OrderStatus", output_name=" Order-Status "), Col("o_totalprice"))


@query("cast_text", """
    select trim(case when o_orderkey % 5 = 0 then '   ' else concat('  ', o_orderpriority, ' ') end)
               as o_orderpriority,
           cast(o_orderkey as varchar) as o_orderkey
    from orders""")
def cast_text(spark, sf_dir):
    spec = TableSpec("orders", [Col("o_orderkey"), Col("o_orderpriority", "TEXT")])
    return clean(spec, {"orders": cells(spark, sf_dir, "orders")})


@query("cast_integer", with_raw("orders", f"""
    select {KEY_SQL}, cast(o_custkey as integer) as o_custkey from raw_orders"""))
def cast_integer(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, Col("o_custkey", "INTEGER"))


@query("cast_numeric", with_raw("orders", f"""
    select {KEY_SQL}, cast(round(cast(o_rate as decimal(20,5)), 2) as double) as o_rate from raw_orders"""))
def cast_numeric(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, Col("o_rate", "NUMERIC"))


@query("cast_date", with_raw("orders", f"""
    select {KEY_SQL}, {DATE_SQL} as o_orderdate from raw_orders"""))
def cast_date(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, Col("o_orderdate", "DATE"))


@query("cast_timestamp", with_raw("events", """
    select cast(event_id as integer) as event_id, cast(ts as timestamp) as ts from raw_events"""))
def cast_timestamp(spark, sf_dir):
    return _clean(spark, sf_dir, Col("event_id", "INTEGER"), Col("ts", "TIMESTAMP"), table="events")


@query("cast_boolean", with_raw("orders", f"""
    select {KEY_SQL}, case when lower(o_flag) in ('yes', 'on', 'true') then true
                           when lower(o_flag) in ('off', '0', 'n') then false end as o_flag
    from raw_orders"""))
def cast_boolean(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, Col("o_flag", "BOOLEAN"))


@query("computed_arith", with_raw("lineitem", """
    select l_orderkey, cast(l_linenumber as integer) as l_linenumber,
           cast(cast(l_extendedprice as decimal(18,2)) * cast(l_quantity as decimal(18,2)) as double) as total,
           cast(l_quantity as decimal(18,2)) > 25 as is_large
    from raw_lineitem"""))
def computed_arith(spark, sf_dir):
    return _clean(
        spark, sf_dir, Col("l_orderkey"), Col("l_linenumber", "INTEGER"), Col("l_quantity", "NUMERIC", include=False),
        Col("l_extendedprice", "NUMERIC", include=False), table="lineitem",
        computed=[ComputedSpec("total", "l_extendedprice * l_quantity", over="typed"),
                  ComputedSpec("is_large", "l_quantity > 25", over="typed")],
    )


@query("computed_case", with_raw("orders", f"""
    select {KEY_SQL}, case when cast(o_totalprice as decimal(18,2)) > 200000 then 'big'
                           when o_orderpriority is null then 'unknown' else 'small' end as size
    from raw_orders"""))
def computed_case(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, computed=[ComputedSpec(
        "Size", "CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) > 200000 THEN 'big' "
                "WHEN o_orderpriority IS NULL THEN 'unknown' ELSE 'small' END")])


@query("computed_upper", with_raw("orders", f"""
    select {KEY_SQL}, lower(o_orderpriority) as priority,
           upper(o_orderstatus || '/' || o_orderpriority) as label from raw_orders"""))
def computed_upper(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, computed=[
        ComputedSpec("priority", "lower(orders.o_orderpriority)"),
        ComputedSpec("label", "upper(concat(o_orderstatus, '/', o_orderpriority))")])


FILTER_COLUMNS = (
    KEY, Col("o_orderstatus", output_name="status"), Col("o_totalprice", "NUMERIC", "price"),
    Col("o_orderdate", "DATE", "day"), Col("o_orderpriority", output_name="priority"), Col("o_custkey", "INTEGER"),
    Col("o_flag", "BOOLEAN", include=False),
)
FILTERS = {
    "filter_eq": ([FilterSpec("status", "=", "F")], "status = 'F'"),
    "filter_ne": ([FilterSpec("priority", "!=", "5-LOW")], "priority <> '5-LOW'"),
    "filter_gt": ([FilterSpec("price", ">", "250000.005")], "price > 250000.005"),
    "filter_ge": ([FilterSpec("o_orderdate", ">=", "1996-01-01")], "day >= '1996-01-01'"),
    "filter_lt": ([FilterSpec("day", "<", "1997-06-15")], "day < '1997-06-15'"),
    "filter_le": ([FilterSpec("o_totalprice", "<=", "99999.999")], "price <= 99999.999"),
    "filter_like": ([FilterSpec("priority", "LIKE", "-%I")], "priority like '%-%I%'"),
    "filter_is_null": ([FilterSpec("priority", "IS NULL")], "priority is null"),
    "filter_not_null": ([FilterSpec("o_custkey", "IS NOT NULL")], "o_custkey is not null"),
    "filter_conjunction": (
        [FilterSpec("status", "!=", "P"), FilterSpec("price", ">=", "100000"), FilterSpec("o_flag", "=", "on"),
         FilterSpec("priority", "IS NOT NULL")],
        "status <> 'P' and price >= 100000 and flag and priority is not null",
    ),
}
FILTER_SQL = f"""
    , cleaned as (
        select {KEY_SQL}, o_orderstatus as status, cast(o_totalprice as decimal(18,2)) as price,
               {DATE_SQL} as day, o_orderpriority as priority, cast(o_custkey as integer) as o_custkey,
               case when lower(o_flag) in ('yes', 'on', 'true') then true
                    when lower(o_flag) in ('off', '0', 'n') then false end as flag
        from raw_orders)
    select o_orderkey, status, cast(price as double) as price, day, priority, o_custkey from cleaned where """


def _register_filter(name, filters, condition):
    @query(name, with_raw("orders", FILTER_SQL + condition))
    def run(spark, sf_dir):
        return _clean(spark, sf_dir, *FILTER_COLUMNS, filters=filters)


for _name, (_filters, _condition) in FILTERS.items():
    _register_filter(_name, _filters, _condition)


def _joined(spark, sf_dir, how, salt=0):
    return _clean(
        spark, sf_dir, Col("o_orderkey"), Col("o_totalprice", "NUMERIC"),
        joins=[JoinSpec("customer", "o_custkey", "c_custkey", how, salt=salt)],
        computed=[ComputedSpec("segment", "customer.c_mktsegment"), ComputedSpec("c_name", "customer.c_name")],
    )


JOIN_SQL = """
    select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as double) as o_totalprice,
           c_mktsegment as segment, c_name
    from raw_orders {how} join raw_customer on o_custkey = c_custkey"""


@query("join_inner", with_raw("orders customer", JOIN_SQL.format(how="inner")))
def join_inner(spark, sf_dir):
    return _joined(spark, sf_dir, "INNER")


@query("join_left", with_raw("orders customer", JOIN_SQL.format(how="left")))
def join_left(spark, sf_dir):
    return _joined(spark, sf_dir, "LEFT")


@query("join_right", with_raw("orders customer", JOIN_SQL.format(how="right")))
def join_right(spark, sf_dir):
    return _joined(spark, sf_dir, "RIGHT")


@query("join_salted", with_raw("orders customer", JOIN_SQL.format(how="left")))
def join_salted(spark, sf_dir):
    return _joined(spark, sf_dir, "LEFT", salt=4)


@query("join_chain", with_raw("orders customer nation", """
    select c_custkey, c_name, n_name as nation, o_orderkey as order_key,
           cast(cast(o_totalprice as decimal(18,2)) as double) as price
    from raw_customer left join raw_nation on c_nationkey = n_nationkey
    inner join raw_orders on c_custkey = o_custkey"""))
def join_chain(spark, sf_dir):
    return _clean(
        spark, sf_dir, Col("c_custkey"), Col("c_name"), table="customer",
        joins=[JoinSpec("nation", "c_nationkey", "n_nationkey"),
               JoinSpec("orders", "c_custkey", "o_custkey", "INNER", alias="o")],
        computed=[ComputedSpec("nation", "nation.n_name"), ComputedSpec("order_key", "o.o_orderkey"),
                  ComputedSpec("price", "CAST(o.o_totalprice AS DECIMAL(18,2))")],
    )


@query("join_computed_right", with_raw("orders customer", """
    select cast(o_orderkey as integer) as o_orderkey,
           coalesce(upper(c_mktsegment), 'NONE') as segment,
           cast(cast(o_totalprice as decimal(18,2)) - cast(c_acctbal as decimal(18,2)) as double) as gap
    from raw_orders left join raw_customer on o_custkey = c_custkey"""))
def join_computed_right(spark, sf_dir):
    return _clean(
        spark, sf_dir, KEY, Col("o_totalprice", "NUMERIC", include=False),
        joins=[JoinSpec("customer", "o_custkey", "c_custkey")],
        computed=[ComputedSpec("segment", "coalesce(upper(customer.c_mktsegment), 'NONE')"),
                  ComputedSpec("gap", "o_totalprice - CAST(customer.c_acctbal AS DECIMAL(18,2))", over="typed")],
    )


FLAGSHIP = TableSpec(
    "orders",
    columns=[Col("o_orderkey", "INTEGER"), Col("o_orderstatus", output_name="status"),
             Col("o_totalprice", "NUMERIC", "price"), Col("o_orderdate", "DATE", "day")],
    filters=[FilterSpec("day", ">=", "1996-01-01")],
    joins=[JoinSpec("customer", "o_custkey", "c_custkey")],
    computed=[ComputedSpec("segment", "customer.c_mktsegment")],
    group_by=["segment", "status"],
    metrics=[MetricSpec("price", "SUM", "revenue"), MetricSpec("price", "AVG", "average"),
             MetricSpec("*", "COUNT")],
)
FLAGSHIP_SQL = with_raw("orders customer", f"""
    , cleaned as (
        select o_orderstatus as status, cast(o_totalprice as decimal(18,2)) as price, {DATE_SQL} as day,
               c_mktsegment as segment
        from raw_orders left join raw_customer on o_custkey = c_custkey)
    select segment, status, cast(sum(price) as double) as revenue, round(avg(price), 4) as average,
           count(*) as row_count
    from cleaned where day >= '1996-01-01' group by segment, status""")


@query("clean_then_aggregate", FLAGSHIP_SQL)
def clean_then_aggregate(spark, sf_dir):
    return _rounded(build_table(FLAGSHIP, raw_tables(spark, sf_dir)).analytics)


@query("agg_view", FLAGSHIP_SQL)
def agg_view(spark, sf_dir):
    views = run_job(spark, JobSpec([FLAGSHIP]), raw_tables(spark, sf_dir))
    return _rounded(spark.table(next(v for v in views if v.startswith("analytics"))))


@query("clean_view", with_raw("orders customer", f"""
    select {KEY_SQL}, o_orderstatus as status, cast(cast(o_totalprice as decimal(18,2)) as double) as price,
           {DATE_SQL} as day, c_mktsegment as segment
    from raw_orders left join raw_customer on o_custkey = c_custkey
    where {DATE_SQL} >= '1996-01-01'"""))
def clean_view(spark, sf_dir):
    views = run_job(spark, JobSpec([FLAGSHIP]), raw_tables(spark, sf_dir))
    return spark.table(next(v for v in views if v.startswith("clean")))


def _catalog_raw(spark, sf_dir, *tables):
    """``raw.<table>`` in the catalog: the raw layer as views over the given files."""
    for table in tables:
        cells_sql = ", ".join(f"{strip_cell(f'({e})')} as `{c}`" for c, e in CELLS[table].items())
        catalog_view(spark, f"select {cells_sql} from parquet.`{sf_dir}/{table}.parquet`", "raw", table)


@query("catalog_views", FLAGSHIP_SQL)
def catalog_views(spark, sf_dir):
    _catalog_raw(spark, sf_dir, "orders", "customer")
    return _rounded(spark.table(list(run_catalog_job(spark, JobSpec([FLAGSHIP])))[-1]))


@query("custom_sql", with_raw("orders customer", """
    select c_mktsegment as segment, count(*) as orders, count(distinct o_custkey) as customers
    from raw_orders join raw_customer on o_custkey = c_custkey where o_orderstatus <> 'P' group by c_mktsegment"""))
def custom_sql(spark, sf_dir):
    _catalog_raw(spark, sf_dir, "orders", "customer")
    job = JobSpec([FLAGSHIP], custom_sql="""
        -- not a statement: create view clean.nothing
        create database if not exists clean;
        create or replace view clean.open_orders as
        select c_mktsegment as segment, o_custkey from raw.orders join raw.customer on o_custkey = c_custkey where o_orderstatus != 'P';
        create or replace view clean.segments as
        select segment, count(*) as orders, count(distinct o_custkey) as customers from clean.open_orders group by segment""")
    return spark.table(list(run_catalog_job(spark, job))[-1])


@query("unknown_type", with_raw("orders", f"select {KEY_SQL}, trim(o_totalprice) as o_totalprice from raw_orders"))
def unknown_type(spark, sf_dir):
    return _clean(spark, sf_dir, KEY, Col("o_totalprice", "MONEY"))


@query("nothing_selected", with_raw("nation", "select * from raw_nation where n_regionkey <> '2'"))
def nothing_selected(spark, sf_dir):
    return _clean(spark, sf_dir, table="nation", filters=[FilterSpec("n_regionkey", "!=", "2")])


def _rounded(df):
    return df.selectExpr("segment", "status", "revenue", "round(average, 4) as average", "row_count")
