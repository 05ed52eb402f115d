"""Loading, looking at samples, inferring types, landing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.infer import BITS, BOOLEAN_WORDS, DATE, INTEGER, NUMERIC, TIMESTAMP, infer_types
from millrace.operators.profile import FolderProfile
from millrace.operators.sample import column_samples, preview
from millrace.plans.upload import load_csv
from millrace.queries.inputs import AS_OF, CELLS, cells, raw, read, with_raw
from millrace.queries.registry import query
from millrace.session import remove_folder, shared_folder
from millrace.sinks.commits import Files
from millrace.sinks.tables import publish_curated, replace_raw
from millrace.sources.csv import read_raw, scan_csv, store_csv
from millrace.sources.files import FileManifest, land_files, landed, latest_file, list_files
from millrace.sources.payload import expand_payload
from millrace.streaming.landing import land_new_files

COLUMNS = list(CELLS["orders"])


def _infer_sql() -> str:
    def every(column, kind):
        fits = {"INTEGER": INTEGER, "NUMERIC": NUMERIC, "DATE": DATE, "TIMESTAMP": TIMESTAMP}
        test = f"regexp_matches({column}, '{fits[kind]}')" if kind in fits else f"lower({column}) in {BOOLEAN_WORDS}"
        return f"coalesce(bool_and({test}), false)"

    rows = [
        f"select {i} as ordinal, '{c}' as \"column\", case when count({c}) = 0 then 'TEXT' "
        + " ".join(f"when {every(c, kind)} then '{kind}'" for kind in BITS) + " else 'TEXT' end as type from raw_orders"
        for i, c in enumerate(COLUMNS)
    ]
    return with_raw("orders", " union all ".join(rows))


def _samples_sql() -> str:
    rows = [
        f"select {i} as ordinal, '{c}' as \"column\", (select string_agg(v, '|' order by k) from (select "
        f"cast(o_orderkey as bigint) as k, {c} as v from head where {c} is not null order by 1 limit 3)) as samples"
        for i, c in enumerate(COLUMNS)
    ]
    head = ", head as (select * from raw_orders order by cast(o_orderkey as bigint) limit 50) "
    return with_raw("orders", head + " union all ".join(rows))


@query("infer_types", _infer_sql())
def infer(spark, sf_dir):
    return infer_types(raw(spark, sf_dir, "orders"))


@query("column_samples", _samples_sql())
def samples(spark, sf_dir):
    found = column_samples(raw(spark, sf_dir, "orders"), [F.col("o_orderkey").cast("bigint")])
    return found.withColumn("samples", F.array_join("samples", "|"))


@query("sample_head", with_raw("orders", """
    select *, (select count(*) from raw_orders) as total_rows, (select count(*) from raw_orders) > 1000 as sampled
    from raw_orders order by cast(o_orderkey as bigint) limit 1000"""))
def sample_head(spark, sf_dir):
    return preview(raw(spark, sf_dir, "orders"), [F.col("o_orderkey").cast("bigint")])


NOTE = """concat(' it''s ', chr(10), '"', o_orderstatus, '", second; line')"""


@query("scan_csv_raw", f"""
    select cast(o_orderkey as string) as order_key, o_orderstatus as status,
           nullif({CELLS['orders']['o_custkey']}, '') as customer__id,
           {CELLS['orders']['o_orderpriority']} as col, {NOTE} as order_note
    from orders""")
def scan_csv_raw(spark, sf_dir):
    path = shared_folder(spark, "csv")
    orders = read(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string)", "o_orderstatus", f"{CELLS['orders']['o_custkey']} as custkey",
        f"{CELLS['orders']['o_orderpriority']} as priority", f"{NOTE} as note",
    ).toDF("Order Key ", "STATUS", "Customer (ID)", "()", "_order-note")
    orders.write.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False)
    return scan_csv(spark, path)


@query("load_csv", f"""
    select t.ordinal, t."column", t.type, s.samples from ({_infer_sql()}) t
    join ({_samples_sql()}) s on t.ordinal = s.ordinal""")
def load(spark, sf_dir):
    base = shared_folder(spark, "load")
    # In key order, so that the head of the first file is the head of the table.
    cells(spark, sf_dir, "orders").orderBy(F.col("o_orderkey").cast("bigint")).write.csv(
        f"{base}/in", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    columns = load_csv(spark, f"{base}/in", "orders", f"{base}/raw", as_of=AS_OF).columns
    return columns.withColumn("samples", F.array_join("samples", "|"))


_FILLED_SQL = with_raw("orders", " union all ".join(
    f"select {i} as ordinal, count(*) as rows, count({c}) as filled from raw_orders" for i, c in enumerate(COLUMNS)))


@query("folder_profile", f"""
    select t.ordinal, t."column", t.type, f.rows, f.filled from ({_infer_sql()}) t join ({_FILLED_SQL}) f on t.ordinal = f.ordinal""")
def folder_profile(spark, sf_dir):
    """Half of the rows are profiled first, and then only the files with the others."""
    base = shared_folder(spark, "profile")
    orders = cells(spark, sf_dir, "orders")
    profile = FolderProfile(spark, f"{base}/in", f"{base}/kept")
    for half in (0, 1):
        orders.filter(F.col("o_orderkey").cast("bigint") % 2 == half).write.csv(
            f"{base}/in/{half}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        profile.refresh()
    return profile.columns().drop("samples")


@query("upload_snapshot", with_raw("orders", "select * from raw_orders"))
def upload_snapshot(spark, sf_dir):
    base = shared_folder(spark, "snapshot")
    cells(spark, sf_dir, "orders").write.csv(f"{base}/in", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_raw(spark, load_csv(spark, f"{base}/in", "orders", f"{base}/raw", as_of=AS_OF, snapshot_to=f"{base}/kept").snapshot)


@query("load_raw_stamped", with_raw("orders", """
    select *, '2024-01-31 00:00:00' as uploaded_at from raw_orders"""))
def load_raw_stamped(spark, sf_dir):
    return replace_raw(raw(spark, sf_dir, "orders"), shared_folder(spark, "raw"), AS_OF)


def _event_files(spark, sf_dir, path, event_types=None):
    """Events as CSV files, one folder per type."""
    events = cells(spark, sf_dir, "events")
    if event_types:
        events = events.filter(F.col("event_type").isin(*event_types))
    events.write.mode("append").partitionBy("event_type").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


LANDED_SQL = with_raw("events", """
    select event_id, ts, user_id, value, props, concat('event_type=', event_type) as folder, '2024-01-31' as ds
    from raw_events""")


def _with_folder(landed):
    folder = F.element_at(F.split("source_path", "/"), -2).alias("folder")
    return landed.select("event_id", "ts", "user_id", "value", "props", folder, F.col("ds").cast("string"))


@query("land_files", LANDED_SQL)
def land(spark, sf_dir):
    base = shared_folder(spark, "land")
    _event_files(spark, sf_dir, f"{base}/in")
    land_files(spark, f"{base}/in", f"{base}/out", "2024-01-31")
    return _with_folder(landed(spark, f"{base}/out"))


@query("land_new_files", LANDED_SQL)
def land_new(spark, sf_dir):
    base = shared_folder(spark, "stream")
    header = [c for c in CELLS["events"] if c != "event_type"]
    for event_types in (["click", "error"], ["purchase", "signup", "view"]):
        _event_files(spark, sf_dir, f"{base}/in", event_types)
        land_new_files(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "2024-01-31", header)
    return _with_folder(landed(spark, f"{base}/out"))


#: A file for each kind of event and day; then the newest day of each kind is deleted, the oldest of ``click`` changed, and one comes.
DAYS_SQL = """
    days as (select event_type, cast(ts as date) as day, count(*) as n,
                    row_number() over (partition by event_type order by cast(ts as date)) as oldest,
                    row_number() over (partition by event_type order by cast(ts as date) desc) as newest
             from events group by event_type, cast(ts as date)),
    files as (select event_type as table_name, cast(day as timestamp) as modified_at,
                     case when newest = 1 then 'deleted' when event_type = 'click' and oldest = 1 then 'changed' else 'unchanged' end as change from days
              union all select 'view', timestamp '2024-03-02 00:00:00', 'new')"""


@query("latest_file", f"""
    with {DAYS_SQL}
    select table_name, modified_at, change from (
      select *, row_number() over (partition by table_name order by modified_at desc) as n from files where change <> 'deleted') where n = 1
    union all
    select table_name, modified_at, change from files where change in ('deleted', 'changed')""")
def latest(spark, sf_dir):
    base = shared_folder(spark, "listing")
    events = cells(spark, sf_dir, "events").withColumn("day", F.substring("ts", 1, 10))
    rows = events.select("event_type", "day", "event_id").repartition("event_type", "day")
    rows.write.partitionBy("event_type", "day").csv(f"{base}/in")
    manifest, time = FileManifest(spark, f"{base}/manifest"), F.to_timestamp(F.regexp_extract("path", "day=([0-9-]+)", 1))

    def listed():
        found = list_files(spark, f"{base}/in", glob="*.csv")
        return found.withColumn("modified_at", time)  # when the files were made; that of this run says nothing

    manifest.refresh(listed())
    days = [(r["event_type"], r["day"]) for r in events.select("event_type", "day").distinct().collect()]
    for kind in {k for k, _ in days}:
        mine = sorted(d for k, d in days if k == kind)
        remove_folder(spark, f"{base}/in/event_type={kind}/day={mine[-1]}")
        if kind == "click":
            folder = Files(spark, f"{base}/in/event_type={kind}/day={mine[0]}")
            name = next(n for n in folder.names() if n.endswith(".csv"))
            content = folder.read(name)
            folder.remove(name)
            folder.create(name, content * 2)
    events.filter("event_type = 'view'").select("event_id").coalesce(1).write.csv(f"{base}/in/event_type=view/day=2024-03-02")
    changes = manifest.refresh(listed())
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1).alias("table_name")
    newest = latest_file(manifest.listing().select("*", kind), ["table_name"])
    known = newest.join(changes.select("path", "change"), "path", "left").select("table_name", "modified_at", F.coalesce("change", F.lit("unchanged")).alias("change"))
    gone = changes.filter("change in ('deleted', 'changed')").select(kind, "modified_at", "change")
    return known.unionByName(gone).withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))


@query("read_json_payload", """
    select event_id, event_type, cast(case when event_id % 10 <> 0 then json_extract(props, '$.k') end as integer) as k,
           case when event_id % 10 = 0 then concat('broken ', props) end as unread
    from events""")
def read_json_payload(spark, sf_dir):
    given = read(spark, sf_dir, "events").selectExpr("event_id", "event_type", "if(event_id % 10 = 0, concat('broken ', props), props) as props")
    return expand_payload(given, "props", "k INT", unreadable="unread")


REJECTS_SQL = "o_orderkey % 50 = 7"


@query("csv_rejects", f"""
    select cast(o_orderkey as string) as o_orderkey, o_orderstatus, case when {REJECTS_SQL} then concat('surplus ', o_orderkey, ',"x,') || chr(10) || 'y"' end as surplus_cells,
           (select count(*) from orders where not {REJECTS_SQL}) as n_rows, (select count(*) from orders where {REJECTS_SQL}) as n_rejected
    from orders""")
def csv_rejects(spark, sf_dir):
    """Rows that fit and rows that do not, each in its table, with the numbers counted as they were written."""
    base = shared_folder(spark, "rejects")
    surplus = f"""if({REJECTS_SQL}, concat(',surplus ', o_orderkey, ',"x,', chr(10), 'y"'), '')"""
    lines = read(spark, sf_dir, "orders").selectExpr(f"concat(o_orderkey, ',', o_orderstatus, {surplus}) as line")
    header = spark.range(1).selectExpr("'o_orderkey,o_orderstatus' as line")
    header.unionByName(lines).coalesce(1).write.text(f"{base}/in")
    stored = store_csv(spark, f"{base}/in", f"{base}/out")
    rejects = stored.rejects.filter("line > 1").select("o_orderkey", "o_orderstatus", "surplus_cells")
    both = stored.raw.withColumn("surplus_cells", F.lit(None).cast("string")).unionByName(rejects)
    return both.withColumns({"n_rows": F.lit(stored.rows).cast("long"), "n_rejected": F.lit(stored.rejected).cast("long")})


@query("publish_curated", "select doc_id, text, lang, source, n_chars from documents")
def publish(spark, sf_dir):
    base = shared_folder(spark, "publish")
    read(spark, sf_dir, "documents").write.parquet(f"{base}/validated")
    return publish_curated(spark, f"{base}/validated", f"{base}/curated")
