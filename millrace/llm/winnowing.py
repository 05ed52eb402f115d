"""Passages that documents share with benchmark items, by winnowing. Built-in Spark functions only.

Words are hashed, and each run of K words gives a k-gram hash. Of every window of WINDOW words the smallest k-gram hash
is kept as its fingerprint, in documents and in items, so a shared window always has a shared fingerprint. Fingerprints are
joined, and each hit is extended to its whole window: windows whose words all agree are matches. Items with fewer words
than a window are matched whole, by the hashes of all runs of their length.

Fingerprints and windows are made of the same words, with only A-Z lower-cased: other letters may have a small form that
depends on what follows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .queries import Query, documents
from .workspace import Workspace, small

WINDOW, K = 10, 5

#: What separates words in lower-cased texts, the same before A-Z are lower-cased, and these letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cased_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), CASED_SEPARATORS), "")


def word_hashes(text: Column) -> Column:
    return F.transform(cased_words(F.translate(text, UPPER, LOWER)), lambda w: F.xxhash64(w))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def runs(values: Column, n: int, of) -> Column:
    """``of`` each run of n elements. Elements are read one by one: a slice for each run is many times slower."""
    starts = F.slice(values, F.lit(1), F.greatest(F.size(values) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: of(x, *(F.get(values, i + j) for j in range(1, n))))


def fingerprints(text: Column, window: int = WINDOW, k: int = K) -> Column:
    """The smallest k-gram hash of each window of words, in the order of the windows."""
    return let(word_hashes(text), lambda h: let(runs(h, k, F.xxhash64), lambda g: runs(g, window - k + 1, F.least)))


def _whole_hash(column: str, most: int) -> Column:
    """The hash of all elements of an array of fewer than ``most``; a null is skipped, as in a shorter run."""
    return F.xxhash64(*(F.get(column, F.lit(j)) for j in range(most)))


def short_matches(docs: DataFrame, few: DataFrame, n: int) -> DataFrame:
    found = let(word_hashes(F.col("text")), lambda h: runs(h, n, F.xxhash64))
    at = docs.select("k1", "k2", F.posexplode(found).alias("start", "run"))
    return at.join(small(few.where(F.col("n") == n).select("item_id", "run")), "run").select("k1", "k2", "item_id", "start", F.lit(n).alias("length"))


def shared_windows(docs: DataFrame, items: DataFrame, space: Workspace, window: int = WINDOW, k: int = K) -> DataFrame:
    """(k1, k2, item_id, start, length): the windows of words of ``docs`` (k1, k2, text) that some item (item_id, text) has."""
    items = items.withColumn("n", F.size(cased_words(F.col("text")))).where("n > 0")
    long_items = items.where(F.col("n") >= window)
    kept = space.keep(long_items.select(F.explode(fingerprints(F.col("text"), window, k)).alias("fp")).distinct())
    hashed = space.keep(long_items.select("item_id", F.explode(let(word_hashes(F.col("text")), lambda h: runs(h, window, F.xxhash64))).alias("run")).distinct())
    hits = docs.select("k1", "k2", F.posexplode(fingerprints(F.col("text"), window, k)).alias("start", "fp")).join(small(kept), "fp", "left_semi")
    hits = space.keep(hits.groupBy("k1", "k2").agg(F.collect_list("start").alias("starts")))
    # Texts without a hit go first, so that a join with many starts moves few texts.
    near = docs.join(small(hits.select("k1", "k2")), ["k1", "k2"], "left_semi")
    whole = near.join(small(hits, lists="starts"), ["k1", "k2"]).select("k1", "k2", F.explode(let(word_hashes(F.col("text")), lambda h: F.transform(
        "starts", lambda s: F.struct(s.alias("start"), F.xxhash64(*(F.get(h, s + j) for j in range(window))).alias("run"))))).alias("one"))
    found = whole.select("k1", "k2", "one.*").join(small(hashed), "run").select("k1", "k2", "item_id", "start", F.lit(window).alias("length"))

    few = space.keep(items.where(F.col("n") < window).select("item_id", "n", word_hashes(F.col("text")).alias("h")).select(
        "item_id", "n", _whole_hash("h", window).alias("run")).distinct())
    for n in sorted(row.n for row in few.select("n").distinct().collect()):  # fewer lengths than a window has words
        found = found.union(short_matches(docs, few, n))
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Texts are compared by words: runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. A
    window is ``window`` consecutive words of an item, or all words of an item that has fewer. A null or empty text has no
    words, and an item without words no window. Rows with the same id and text get the same result; rows that only
    share an id are told apart by their text, so ids may be null or repeated. Item ids may repeat and count once; all items without an
    id count as one, which has no name in the list that ``items_sha256`` is made of.
    Other columns are not read. An empty table on either side gives no hits.
    """
    space = Workspace(docs.sparkSession, "winnowing")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})
    bench = items.select(items[item_col].cast("string").alias("item_id"), items[item_text_col].cast("string").alias("text"))
    hits = space.keep(shared_windows(rows.select("k1", "k2", "text"), bench, space, window, k).distinct())
    words_hit = hits.select("k1", "k2", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word")).distinct()
    n_hit = words_hit.groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    named = hits.select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"))
    found = n_hit.join(named, ["k1", "k2"])
    out = rows.select("doc_id", "k1", "k2", F.size(cased_words(F.col("text"))).cast("long").alias("n_words")).join(found, ["k1", "k2"], "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = rf"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') ws from documents),
i as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') ws from benchmark),
iw as (
  select distinct item_id, n, array_to_string(ws[s:s + n - 1], ' ') g
  from (select item_id, ws, least(10, len(ws)) n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) s from i where len(ws) > 0)),
dw as (
  select doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) s from d, (select distinct n from iw) where len(ws) >= n)),
hits as (select distinct doc_id, s, dw.n, item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hits) group by 1),
names as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
          from (select distinct doc_id, cast(item_id as varchar) item from hits) group by 1)
select d.doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
       n_hit is not null contaminated
from d left join pos using (doc_id) left join names using (doc_id)
"""

QUERIES = {"op5_winnowing": Query(op5_winnowing, OP5_SQL)}
