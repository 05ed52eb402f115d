"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for every row.

Leaves are ranked within their group, and the rank is cut into digits. Rows of a block, 2 ** (BITS * DIGITS) leaves, are grouped by
all digits but the lowest: each group holds its children as nested structs and the levels of nodes above them. The digits are
grouped away one after the other until a row is a whole block with the digest of its top, and these tops are the leaves of the
next tier, as long as a group has more than one. So no row holds more than a block, however many leaves a group has.

Proofs come out of the nested structs: a block's row gets the path above its top (one join of a row per block), and one
transform and explode gives each leaf the siblings of all levels. Leaves are never joined.

Ranks need no sort in one task: rows are sorted over ranges, and the rows of a group in earlier ranges are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .queries import Query, documents
from .workspace import Workspace, small

#: A digit of a rank has so many bits, and a block so many digits: 1,024 leaves.
BITS, DIGITS = 5, 2
#: More rows per task than this are ranked with more tasks than the session's number of shuffle partitions.
RANK_ROWS = 1_000_000

PATH = "array<struct<sibling: string, left: boolean>>"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its bytes in UTF-8, a colon, itself; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return sha(F.concat(*map(field, values)))


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, s: sha(F.when(s.left, F.concat(s.sibling, node)).otherwise(F.concat(node, s.sibling))))


def proof_text(path: Column) -> Column:
    """All siblings, from the bottom up."""
    return F.array_join(F.transform(path, lambda s: s.sibling), "")


def ranked(nodes: DataFrame, order: list[str], space: Workspace) -> DataFrame:
    """``nodes`` (key, ...) with their rank in the order of ``order`` within the key, and n, the number of nodes of the key.

    Equal nodes may come in any order; the last sort column spreads them over tasks.
    """
    spark, sort = nodes.sparkSession, ["key", *order, "spread"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = nodes.count() // RANK_ROWS + 1
    spread = nodes.withColumn("spread", F.monotonically_increasing_id())
    by_range = spread.repartitionByRange(*([wanted] if wanted > tasks else []), *sort).sortWithinPartitions(*sort).drop("spread")
    placed = space.keep(by_range.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")))
    spans = placed.groupBy("key", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("key")  # one row per task
    before = F.sum("n").over(whole.orderBy("task")) - F.col("n") - F.col("first")
    spans = space.keep(spans.select("key", "task", before.alias("shift"), F.sum("n").over(whole).alias("n")))
    return placed.join(small(spans), ["key", "task"]).withColumn("rank", F.col("place") + F.col("shift")).drop("task", "place", "shift")


def _levels(digests: Column, n: Column, base: int, bits: int) -> Column:
    """The digests and the ``bits`` levels of nodes above them; a key with one node at a level goes no higher."""

    def above(row: Column, j: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.ceil(F.size(row) / F.lit(2)).cast("int") - 1)
        up = F.transform(pairs, lambda i: sha(F.concat(F.get(row, i * 2), F.coalesce(F.get(row, i * 2 + 1), F.lit("")))))
        return F.when(n > F.call_function("shiftleft", F.lit(1).cast("long"), j + base), up).otherwise(row)

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.array(digests), lambda rows, j: F.concat(rows, F.array(above(F.element_at(rows, -1), j))))


def _path(levels: Column, at: Column, n: Column, base: int, bits: int) -> Column:
    """Siblings of child ``at`` on each level that is hashed; the sibling of a node that is alone is empty."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda j: n > F.call_function("shiftleft", F.lit(1).cast("long"), j + base))

    def step(j: Column) -> Column:
        place = F.call_function("shiftright", at, j)
        return F.struct(F.coalesce(F.get(F.get(levels, j), place.bitwiseXOR(F.lit(1))), F.lit("")).alias("sibling"), (place.bitwiseAND(F.lit(1)) == 1).alias("left"))

    return F.transform(steps, step)


def _blocks(nodes: DataFrame, tier: int, bits: int, digits: int) -> DataFrame:
    """(key, n, block, node) from (key, n, rank, digest, held): one row per block, its children nested in ``node``."""
    names = [f"digit{i}" for i in range(digits)]
    cut = {c: F.call_function("shiftright", F.col("rank"), F.lit(bits * i)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i, c in enumerate(names)}
    rows = nodes.select("key", "n", F.call_function("shiftright", F.col("rank"), F.lit(bits * digits)).alias("block"),
                        *(c.alias(k) for k, c in cut.items()), "digest", "held")
    rows = rows.repartition("key", "block")  # all groups below lie inside a block, so this is the only shuffle
    for i, name in enumerate(names):
        base = bits * (digits * tier + i)
        grouped = rows.groupBy("key", "n", "block", *names[i + 1:]).agg(F.array_sort(F.collect_list(F.struct(name, "digest", "held"))).alias("kids"))
        levels = _levels(F.transform("kids", lambda k: k.digest), F.col("n"), base, bits)
        held = F.struct("levels", F.transform("kids", lambda k: k.held).alias("kids")).alias("held")
        rows = grouped.withColumn("levels", levels).select("key", "n", "block", *names[i + 1:], F.element_at(F.element_at("levels", -1), 1).alias("digest"), held)
    return rows


def _opened(blocks: DataFrame, tier: int, bits: int, digits: int) -> Column:
    """All children of a block with their rank and the path up to the end of its own path ``above``."""
    n = F.col("n")

    def inside(held: Column, i: int, number: Column, above: Column) -> Column:
        base = bits * (digits * tier + i)

        def child(kid: Column, at: Column) -> Column:
            path = F.concat(_path(held.levels, at, n, base, bits), above)
            rank = number * (1 << bits) + at
            if i:
                return inside(kid, i - 1, rank, path)
            return F.array(F.struct(rank.alias("rank"), F.get(held.levels[0], at).alias("leaf"), path.alias("path"), kid.alias("held")))

        return F.flatten(F.transform(held.kids, child))

    return inside(F.col("held"), digits - 1, F.col("block"), F.col("above"))


class Tree:
    """One tree per key over ``nodes`` (key, digest, held, and the columns of ``order``), where ``held`` is a struct that proofs carry along."""

    def __init__(self, nodes: DataFrame, order: list[str], space: Workspace, bits: int = BITS, digits: int = DIGITS):
        self.space, self.bits, self.digits = space, bits, digits
        level = ranked(nodes, order, space).select("key", "n", "rank", "digest", "held")
        self.tiers: list[DataFrame] = []
        largest = None
        while largest is None or largest > 1 << bits * digits * len(self.tiers):
            made = space.keep(_blocks(level, len(self.tiers), bits, digits))
            self.tiers.append(made)
            if largest is None:
                largest = made.agg(F.max("n")).first()[0] or 0
            level = made.select("key", "n", F.col("block").alias("rank"), "digest", F.struct(F.lit(None).cast("string").alias("nothing")).alias("held"))
        self.tops = self.tiers[-1].select("key", "digest")

    def proofs(self, above: DataFrame) -> DataFrame:
        """(key, leaf, path, held, ...) of every leaf; ``above`` (key, above, ...) has the path above the top of each key."""
        more = [c for c in above.columns if c not in ("key", "above")]
        above = above.withColumn("block", F.lit(0).cast("long"))
        for tier in range(len(self.tiers) - 1, -1, -1):
            blocks = self.tiers[tier].drop("digest").join(small(self.space.keep(above), lists="above"), ["key", "block"])
            rows = blocks.select("key", *more, F.inline(_opened(blocks, tier, self.bits, self.digits)))
            above = rows.select("key", F.col("rank").alias("block"), F.col("path").alias("above"), *more)
        return rows.select("key", "leaf", "path", "held", *more)


def manifest(docs: DataFrame, leaf: Column, group_col: str, order_col: str, held: Callable[[DataFrame], list[Column]] | None = None,
             bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """(id, leaf, subroot, root, path, held): the proof of every row of ``docs``.

    ``leaf`` is the digest of a row, ``group_col`` its group and ``order_col`` its place in it, which ``id`` returns; ``held`` gives further
    columns to carry along. Every two consecutive nodes become the digest of both, a last one alone the digest of itself, until one node is
    left, the group's subroot; a group of one row has its leaf. The subroots, ordered by group, null first, give the root.
    ``path`` has a (sibling, left) for each digest on the way: left siblings come first, an empty one stands for none.

    Null groups form a group. Null places come first, equal places are ordered by their leaves, and equal rows have the same leaf
    and proofs of neighbouring places. Other columns are not read. An empty table has no tree and gives no rows.
    """
    space = Workspace(docs.sparkSession, "merkle")
    columns = [F.col(order_col).alias("id"), *(held(docs) if held else [])]
    leaves = space.keep(docs.select(group_key(F.col(group_col)).alias("key"), leaf.alias("digest"), F.struct(*columns).alias("held")))
    placed = leaves.withColumn("id", F.col("held.id"))
    tree = Tree(placed, ["id", "digest"], space, bits, digits)
    groups = tree.tops.select(F.lit("").alias("key"), F.col("key").alias("of"), "digest", F.struct(F.col("key").alias("key"), F.col("digest").alias("subroot")).alias("held"))
    over = Tree(groups, ["of"], space, bits, digits)
    top = over.tops.select("key", F.array().cast(PATH).alias("above"), F.col("digest").alias("root"))
    above = over.proofs(top).select("held.key", F.col("path").alias("above"), "held.subroot", "root")
    return tree.proofs(above).select("held.id", "leaf", "subroot", "root", "path", "held")


#: Fixed value: rows whose crc32 is divisible by this are tampered with, to see that it shows.
TAMPERED = 7


def audit(docs: DataFrame, bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text) by lang, and what comes of rows that are tampered with.

    Gives doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Nulls in any column are part of the leaf; a row
    without doc_id or without n_chars is not changed by tampering.
    """
    kept = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf = leaf_digest(*kept, F.col("n_chars"), F.col("text"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    forged = F.when(chosen & F.col("n_chars").isNotNull(), leaf_digest(*kept, F.col("n_chars").cast("long") + 1, F.col("text")))
    found = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), leaf, "lang", "doc_id", lambda _: [forged.alias("forged")], bits, digits)
    folded = found.withColumn("folded_root", fold(F.coalesce("held.forged", "leaf"), F.col("path")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", sha(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


def _field_sql(c: str) -> str:
    return f"coalesce(concat(strlen(cast({c} as varchar)), ':', cast({c} as varchar)), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + "))"


_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1),
    lambda p: ascii(cast(doc_id as varchar)[p])::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0 end))), 4294967295::bigint)"""

OP13_SQL = f"""
with recursive d as materialized (
  select doc_id, lang, {_leaf_sql('n_chars')} leaf, case when {_CRC_SQL} % 7 = 0 then {_leaf_sql('n_chars + 1')} else {_leaf_sql('n_chars')} end given,
         coalesce('1' || lang, '0') k from documents),
r as materialized (select *, row_number() over (partition by k order by doc_id, leaf) - 1 i, count(*) over (partition by k) n from d),
t as (
  select k, 0 lvl, i, n, leaf h from r
  union all
  select k, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from t where n > 1 group by k, lvl, i // 2, n),
top as materialized (select k, h subroot, row_number() over (order by k) - 1 i, count(*) over () n from t where n = 1),
u as (
  select 0 lvl, i, n, subroot h from top
  union all
  select lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from u where n > 1 group by lvl, i // 2, n),
depth as (select k, max(lvl) deep from t group by 1),
walk as (
  select doc_id, r.i, r.k, 0 step, leaf, given node, '' proof, r.n, r.i spot from r
  union all
  select doc_id, w.i, w.k, step + 1, leaf,
         sha256(case when spot % 2 = 1 then concat(s.h, node) else concat(node, s.h) end), concat(proof, s.h), (w.n + 1) // 2, spot // 2
  from walk w left join t s on s.k = w.k and s.lvl = step and s.i = xor(spot, 1) where w.n > 1),
lower as (select w.* from walk w join depth on w.k = depth.k and step = deep),
climb as (
  select l.doc_id, l.k, l.i, l.leaf, l.node, l.proof, 0 step, top.i spot, top.n n, top.subroot from lower l join top on l.k = top.k
  union all
  select doc_id, k, c.i, leaf, sha256(case when spot % 2 = 1 then concat(s.h, node) else concat(node, s.h) end), concat(proof, s.h), step + 1, spot // 2,
         (c.n + 1) // 2, subroot
  from climb c left join u s on s.lvl = step and s.i = xor(spot, 1) where c.n > 1)
select doc_id, leaf, subroot, (select h from u where n = 1) root, sha256(proof) proof_sha256, node folded_root,
       node = (select h from u where n = 1) verified
from climb where n = 1
"""

QUERIES = {"op13_merkle": Query(op13_merkle, OP13_SQL)}
