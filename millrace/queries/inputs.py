"""Raw text tables with gaps, and run logs, derived from the given tables.

Every expression here is plain SQL that both engines read, so the compared results differ only in
what the operators do.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.cells import normalize_cells

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "timestamp '2024-01-31 00:00:00'"

#: Cells as a CSV file might hold them: blanks, padding, missing keys, words for truth values.
CELLS = {
    "orders": {
        "o_orderkey": "cast(o_orderkey as string)",
        "o_custkey": "case when o_orderkey % 7 = 0 then '' else cast(o_custkey as string) end",
        "o_orderstatus": "o_orderstatus",
        "o_totalprice": "cast(o_totalprice as string)",
        "o_rate": "cast(cast((o_orderkey % 3 - 1) * cast(o_totalprice as decimal(12,2)) * 0.125 "
                  "as decimal(20,5)) as string)",
        "o_orderdate": "cast(o_orderdate as string)",
        "o_orderpriority": "case when o_orderkey % 5 = 0 then '   ' else concat('  ', o_orderpriority, ' ') end",
        "o_flag": "case o_orderkey % 7 when 0 then 'yes' when 1 then 'off' when 2 then 'TRUE' when 3 then '0' "
                  "when 4 then 'On' when 5 then 'n' else '' end",
    },
    "customer": {
        "c_custkey": "case when c_custkey % 11 = 0 then '' else cast(c_custkey as string) end",
        "c_name": "c_name",
        "c_nationkey": "case when c_custkey % 13 = 0 then '' else cast(c_nationkey as string) end",
        "c_acctbal": "cast(c_acctbal as string)",
        "c_mktsegment": "c_mktsegment",
    },
    "nation": {
        "n_nationkey": "cast(n_nationkey as string)",
        "n_name": "n_name",
        "n_regionkey": "cast(n_regionkey as string)",
    },
    "lineitem": {
        "l_orderkey": "cast(l_orderkey as string)",
        "l_linenumber": "cast(l_linenumber as string)",
        "l_quantity": "cast(l_quantity as string)",
        "l_extendedprice": "cast(l_extendedprice as string)",
        "l_discount": "cast(l_discount as string)",
        "l_returnflag": "l_returnflag",
        "l_linestatus": "l_linestatus",
        "l_shipdate": "cast(l_shipdate as string)",
    },
    "events": {
        "event_id": "cast(event_id as string)",
        "ts": "cast(ts as string)",
        "user_id": "cast(user_id as string)",
        "event_type": "event_type",
        "value": "cast(value as string)",
        "props": "props",
    },
}

# Run, task and ingestion logs: 20 pipelines, four pipelines more that never ran.
DERIVED = {
    "pipelines": """
        select distinct concat('p', cast(user_id % 24 as string)) as pipeline_id,
               user_id % 24 % 7 = 3 as is_paused,
               concat('Nightly load of Source ', cast(user_id % 24 % 5 as string)) as description
        from events""",
    "runs": """
        select concat('p', cast(user_id % 20 as string)) as pipeline_id,
               concat('r', cast(event_id as string)) as dag_run_id,
               case event_type when 'error' then 'failed' when 'view' then 'running'
                               when 'click' then 'queued' else 'success' end as state,
               case when event_id % 50 = 0 then null else ts end as started_at,
               case when event_id % 50 = 0 or event_type in ('view', 'click') then null
                    else ts + interval '90 seconds' end as finished_at,
               case when event_type in ('view', 'click') then null else cast(value as decimal(10,3)) end
                   as duration_seconds,
               case when event_type = 'error' then concat('boom ', props) end as error_message
        from events""",
    "run_log": """
        select concat('p', cast(floor(event_id / 4) % 20 as int)) as pipeline_id,
               concat('r', cast(cast(floor(event_id / 4) as bigint) as string)) as dag_run_id,
               case event_type when 'error' then 'failed' when 'view' then 'running' else 'success' end as state,
               ts as started_at,
               ts + interval '30 seconds' as finished_at,
               cast(value as decimal(10,3)) as duration_seconds,
               case when event_type = 'error' then concat('boom ', props) end as error_message,
               ts as logical_date,
               ts as created_at
        from events""",
    "tasks": """
        select concat('p', cast(user_id % 20 as string)) as pipeline_id,
               concat('r', cast(event_id as string)) as dag_run_id,
               case event_id % 3 when 0 then 'ingestion' when 1 then 'transformation_skipped'
                                 else 'validation.row_count' end as task_id,
               case event_type when 'error' then 'failed' else 'success' end as state,
               ts as started_at,
               cast(1 + event_id % 4 as int) as try_number,
               case when event_type = 'error' then concat(repeat('boom ', 20), props) end as error_message
        from events""",
    "ilog": """
        select event_id as id, concat('p', cast(user_id % 20 as string)) as pipeline_id,
               'public.t' as table_name, ts as extracted_at,
               cast(floor(value) as int) as rows_extracted,
               case when event_type = 'error' then null else ts end as watermark_to,
               case when event_type = 'click' then cast(0 as decimal(10,3)) else cast(value as decimal(10,3)) end
                   as duration_seconds,
               case when event_type = 'error' then 'failed' else 'success' end as status
        from events""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cells(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as text cells, as written."""
    return read(spark, sf_dir, table).selectExpr(*[f"{e} as {c}" for c, e in CELLS[table].items()])


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as the raw layer holds it: stripped text, empty cells as NULL."""
    return normalize_cells(cells(spark, sf_dir, table))


def raw_tables(spark: SparkSession, sf_dir: str):
    return lambda table: raw(spark, sf_dir, table)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(DERIVED[name].replace("from events", "from {events}"), events=read(spark, sf_dir, "events"))


def with_raw(tables: str, body: str) -> str:
    """SQL: ``body`` over ``raw_<table>`` for each of the space-separated tables."""
    parts = []
    for table in tables.split():
        columns = ", ".join(f"nullif(trim({e}), '') as {c}" for c, e in CELLS[table].items())
        parts.append(f"raw_{table} as (select {columns} from {table})")
    return f"with {', '.join(parts)} {body}"


def with_derived(names: str, body: str) -> str:
    return f"with {', '.join(f'{n} as ({DERIVED[n]})' for n in names.split())} {body}"
