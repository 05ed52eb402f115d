"""Quality checks."""

from __future__ import annotations

from datetime import datetime, timedelta

from millrace.operators.quality import ExpectedColumn, dedupe, freshness, row_count, schema
from millrace.queries.inputs import read
from millrace.queries.registry import query


@query("dq_row_count", """
    select 'row_count' as "check", count(*) as observed, cast(100 as bigint) as expected, count(*) >= 100 as passed
    from documents""")
def dq_row_count(spark, sf_dir):
    return row_count(read(spark, sf_dir, "documents"), min_rows=100)


@query("dq_schema", """
    select 'o_orderkey' as "column", 'bigint' as expected_type, 'bigint' as actual_type,
           count(*) filter (where o_orderkey is null) as null_rows, count(*) = count(o_orderkey) as passed from orders
    union all select 'o_orderstatus', 'string', 'string', count(*) filter (where o_orderstatus is null),
           count(*) = count(o_orderstatus) from orders
    union all select 'o_totalprice', 'decimal(18,2)', 'double', 0, false
    union all select 'o_comment', 'string', null, 0, false
    union all select c, null, t, 0, false from (values ('o_custkey', 'bigint'), ('o_orderdate', 'timestamp_ntz'),
           ('o_orderpriority', 'string')) v(c, t)""")
def dq_schema(spark, sf_dir):
    return schema(read(spark, sf_dir, "orders"), {
        "o_orderkey": ExpectedColumn("bigint", nullable=False),
        "o_orderstatus": ExpectedColumn("string", nullable=False),
        "o_totalprice": ExpectedColumn("decimal(18,2)"),
        "o_comment": ExpectedColumn("string"),
    })


@query("dq_freshness", """
    select 'freshness' as "check",
           cast(epoch(timestamp '2024-01-31 00:00:00') as bigint) - cast(epoch(date_trunc('second', max(ts))) as bigint)
               as observed,
           cast(172800 as bigint) as expected, max(ts) >= timestamp '2024-01-29 00:00:00' as passed
    from events""")
def dq_freshness(spark, sf_dir):
    return freshness(read(spark, sf_dir, "events"), "ts", timedelta(days=2), datetime(2024, 1, 31))


@query("dq_dedupe", """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n
          from orders) where n = 1""")
def dq_dedupe(spark, sf_dir):
    return dedupe(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
