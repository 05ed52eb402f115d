"""What each of several filters removes in every order of the filters, from decision diagrams of their failures.

Spark counts the documents of each part by their failure mask, the set of filters that they fail. A part is then a small table of
at most 2^k masks, and a diagram of it: each level asks one filter, edges lead to those that fail and those that pass, equal
sub-diagrams are shared, and every node carries the counts below it. The path that passes everywhere gives the steps of the order
of the levels: what leaves it on a fail edge is removed there. Two neighbouring levels are swapped in place, so one
diagram visits all orders, each one swap after the one before.

What does not depend on the order is read off the same paths: a filter at the top removes all that fail it, one at the bottom what
fails it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .queries import Query, documents
from .workspace import Workspace

#: More filters have too many orders for a row each.
MOST_FILTERS = 7

#: Fixed values of the five filters: words, percent of different words, percent of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
NAMES = "ABCDE"

Weights = tuple[int, ...]


class Diagram:
    """A diagram over all filters of the counts by mask; bit i of a mask is set where filter i fails."""

    def __init__(self, counts: dict[int, Weights], k: int):
        self.order = list(range(k))
        self._edges: dict[int, tuple[int, int]] = {}  # node -> (fail, pass)
        self._known: list[dict[tuple[int, int], int]] = [{} for _ in range(k)]  # by level
        self._weight: list[Weights] = []
        size = len(next(iter(counts.values()), (0,)))
        leaves: dict[Weights, int] = {}
        row = []
        for mask in range(1 << k):
            weight = counts.get(mask, (0,) * size)
            if weight not in leaves:
                leaves[weight] = len(self._weight)
                self._weight.append(weight)
            row.append(leaves[weight])
        for level in range(k - 1, -1, -1):  # the last filter is the highest bit
            half = len(row) // 2
            row = [self._node(level, fail, passed) for passed, fail in zip(row[:half], row[half:])]
        self.root = row[0]

    def _node(self, level: int, fail: int, passed: int) -> int:
        known = self._known[level]
        node = known.get((fail, passed))
        if node is None:
            node = known[fail, passed] = len(self._weight)
            self._edges[node] = (fail, passed)
            self._weight.append(tuple(a + b for a, b in zip(self._weight[fail], self._weight[passed])))
        return node

    def swap(self, level: int) -> None:
        """Exchange a level with the next one. Nodes of the upper level stay the same functions, so nothing above changes."""
        upper, lower = self._known[level], self._known[level + 1]
        self._known[level], self._known[level + 1] = {}, {}
        for node in upper.values():
            (ff, fp), (pf, pp) = (self._edges[x] for x in self._edges[node])
            edges = self._node(level + 1, ff, pf), self._node(level + 1, fp, pp)
            self._edges[node] = edges
            self._known[level][edges] = node
        for node in lower.values():
            del self._edges[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weights, Weights]]:
        """(filter, removed, kept) along the path that passes everywhere."""
        node = self.root
        for which in self.order:
            fail, node = self._edges[node]
            yield which, self._weight[fail], self._weight[node]


def level_swaps(k: int) -> Iterator[int]:
    """Levels whose swaps lead through all orders of k filters (Steinhaus, Johnson, Trotter)."""
    if k < 2:
        return
    down = True
    inner = level_swaps(k - 1)
    while True:
        # The last one walks through the others, which then take one step themselves.
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def all_orders(counts: dict[int, Weights], k: int) -> list[list[tuple[int, Weights, Weights]]]:
    """The steps of every order; the counts of a mask are (documents, others ...)."""
    diagram = Diagram(counts, k)
    found = [list(diagram.steps())]
    for level in level_swaps(k):
        diagram.swap(level)
        found.append(list(diagram.steps()))
    return found


def effects(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic).

    Gives part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. ``names`` has a letter for
    each filter. Masks may be missing. A null part is a part of its own. An empty table has no parts.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS or len(set(names)) < k:
        raise ValueError(f"need 1 to {MOST_FILTERS} filters with different letters")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2^k masks
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 50):  # 50 parts are some ten thousand rows
                rows = []
                for part, masks in zip(*(batch.slice(i, 50).column(c).to_pylist() for c in ("part", "masks"))):
                    orders = all_orders({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, k)
                    fails, alone, total = [0] * k, [0] * k, [0] * k
                    for steps in orders:
                        fails[steps[0][0]], alone[steps[-1][0]] = steps[0][1][0], steps[-1][1][0]
                        for f, removed, _ in steps:
                            total[f] += removed[0]
                    for steps in orders:
                        order = "".join(names[f] for f, _, _ in steps)
                        rows += [(part, order, step, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], total[f])
                                 for step, (f, removed, kept) in enumerate(steps, 1)]
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(longs)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "filter_order", "step", *longs])

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def text_failures(text: Column) -> list[Column]:
    """The filters that look at a text alone: few words, few different words, many capitals, symbols."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
            capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS, text.rlike(SYMBOLS)]


def mask_counts(docs: DataFrame, labels: DataFrame, failures=text_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail.

    ``failures`` gives the columns of the filters on the text; one more follows: the text is that of a smaller id anywhere in the table.
    A null text is empty, a null part the empty string. A row without id is no copy and makes none. Rows that repeat count each; of
    rows with the smallest id of a text none is a copy. A document is good, or toxic, if any row of ``labels`` (doc_id, quality, toxic)
    says so. Texts are only shuffled as digests; rows are summed before they meet, so many copies are a few rows.
    """
    space = Workspace(docs.sparkSession, "filter-audit")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    marks = failures(F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(marks)), F.lit(0))
    facts = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))
    facts = space.keep(facts.groupBy("digest", "part", "mask", "id").agg(F.count("*").alias("n")))

    flags = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    none = F.lit(False)
    named = facts.where("id is not null").join(flags, "id", "left")
    flagged = named.withColumns({c: F.coalesce(c, none) for c in ("good", "toxic")}).unionByName(
        facts.where("id is null").withColumns({"good": none, "toxic": none}))
    groups = space.keep(flagged.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min("id").alias("first"),
        F.min_by("n", "id").alias("at_first")))
    first = groups.groupBy("digest").agg(F.min("first").alias("low"))
    copies = F.col("named") - F.when(F.col("first") == F.col("low"), F.col("at_first")).otherwise(0)
    split = groups.join(first, "digest").select("part", "mask", "good", "toxic", "n", copies.alias("copies"))
    both = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << len(marks))).alias("mask"), F.col("copies").alias("n")))
    each = split.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(mask_counts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")), NAMES)


_LETTERS = ", ".join(f"('{x}')" for x in NAMES)

OP12_SQL = rf"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
l as (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by 1),
w as (select *, list_filter(string_split_regex(t, '{BLANKS}'), lambda x: x <> '') ws, min(doc_id) over (partition by t) low from d),
m as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
             concat(case when len(ws) < {LEAST_WORDS} then 'A' end, case when 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) then 'B' end,
                    case when 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * len(t) then 'C' end,
                    case when regexp_matches(t, '{SYMBOLS}') then 'D' end, case when doc_id > low then 'E' end) fails
      from w left join l using (doc_id)),
c as (select part, fails, count(*) n, count(*) filter (where good) good, count(*) filter (where toxic) toxic from m group by all),
x(f) as (values {_LETTERS}),
o as (select a.f || b.f || c.f || d.f || e.f filter_order from x a, x b, x c, x d, x e
      where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, cast(step as integer) step, filter_order[step] f, filter_order[1:step - 1] before from o, range(1, 6) r(step)),
r as (select part, filter_order, step, f,
             sum(case when translate(fails, before || f, '') = fails then n else 0 end) kept,
             sum(case when contains(fails, f) and translate(fails, before, '') = fails then n else 0 end) removed,
             sum(case when contains(fails, f) and translate(fails, before, '') <> fails then n else 0 end) redundant,
             sum(case when fails = f then n else 0 end) unique_fails,
             sum(case when contains(fails, f) and translate(fails, before, '') = fails then good else 0 end) good_lost,
             sum(case when contains(fails, f) and translate(fails, before, '') = fails then toxic else 0 end) toxic_lost
      from c, s group by all)
select part, filter_order, step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
       cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) shapley
from r
"""

QUERIES = {"op12_filter_audit": Query(op12_filter_audit, OP12_SQL)}
