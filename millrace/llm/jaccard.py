"""Exact self-join of documents by the Jaccard similarity of their word n-grams, by vertical partitioning.

Each document is the set of the hashes of its n-grams, in one global order, and that order is cut into fragments.

1. Documents with equal sets form a class; only one set per class goes on.
2. The order by hash is cut into m fragments. Two classes of similar size that link differ in at most H n-grams, and
   each of these touches one fragment, so they agree in at least m - H whole fragments. Classes are joined by (cut,
   fragment, sum of the hashes inside); those that share too few fragments with all others together are done. Sizes fall
   into bands, each with its own m, and a class also takes part in the next band if a partner may lie there. A fragment
   that is empty on both sides says nothing, so m leaves room for some; a class with more empty ones than that is also
   cut by a second hash, and so on. If two classes share too many empty fragments, both have too many, so no link is lost.
   Keys travel packed, some thousand to a row, and are sorted bucket by bucket; the number of buckets grows with the data.
   A task sends the keys of a class once, so a bucket has at most a few entries a task for a text that many rows hold.
   The shared keys of close classes lie in as many buckets as there are, up to one each, and every bucket would report them.
   So each class also has two probes, of two n-grams each that are smallest by some hash. Classes with an equal probe go on
   at once, and a bucket does not report a class for a key that it shares with such a class; it has the probes of both.
3. Classes left over are put in the global order by frequency, rare n-grams first, and joined by the first n-grams of
   that order, with the position as a bound on the overlap. In each group of classes with the same n-gram the most
   central one is compared with all others; the components of these links leave few pairs, and all pairs of different
   components in a group are compared too.
4. The overlap of a pair is counted in each fragment separately, and summed per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import in_batches
from .components import components
from .queries import Query, documents
from .words import Hashes, chunks, lower_ascii, mix, ngrams, texts_of, words_of
from .workspace import Workspace, small

#: Fragments in which overlaps are counted.
FRAGMENTS = 16
#: Hashes by which a class with too many empty fragments is cut; after the last, empty fragments are keys as well.
SEEDS = 10
#: Fragments beyond those needed, as a share of H: so many more must be shared, which chance seldom gives.
MORE_SHARED = 0.12
#: Classes that a task remembers, so as not to send their keys again.
SENT_CLASSES = 1_000_000
#: N-grams per bucket of keys, about.
BUCKET_GRAMS = 1_000_000
#: Buckets that a task sorts at least, one after the other, before there are more tasks.
BUCKETS_A_TASK = 4


class Bands:
    """The bands of set sizes and the number of fragments in each, for links at ``percent`` or more."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100")
        self.percent, self.ratio = percent, 100 / percent
        top, tops, cuts, spare, need = 0, [], [], [], []
        while top < 1 << 32:
            low, top = top + 1, max(top + 1, math.floor(top * max(1.25, self.ratio)) + 1)
            differ = 2 * top * (100 - percent) // (100 + percent)
            tops.append(top)
            beyond = int(MORE_SHARED * differ)
            more = self._room(differ + beyond, low / self.ratio) if differ else 0
            cuts.append(differ + 1 + beyond + more if differ else 0)
            spare.append(more)
            need.append(1 + beyond)
        self.tops, self.cuts, self.spare, self.need = np.array(tops), np.array(cuts), np.array(spare), np.array(need)

    @staticmethod
    def _room(differ: int, size: float) -> int:
        """Empty fragments to allow for, so that few sets of this size have more: the mean and two deviations."""
        more = 0
        for _ in range(20):
            m = differ + 1 + more
            mean = m * math.exp(-size / m)
            more = min(max(more, math.floor(mean + 2 * math.sqrt(mean))), 2 * (differ + 1))
        return more

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each size, and whether a partner may lie in the next one."""
        band = np.searchsorted(self.tops, size)
        return band, size * 100 // self.percent > self.tops[band]


def fragment_keys(doc: np.ndarray, gram: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, tag, key) for each fragment by which a document may meet another; ``gram`` is distinct per document."""
    own, wider = bands.of(size)
    out_doc, out_tag, out_key = [], [], []
    for step in (0, 1):
        band = np.minimum(own + step, len(bands.tops) - 1)
        rows = np.flatnonzero((size > 0) & (bands.cuts[band] > 0) & ((step == 0) | wider))
        for seed in range(SEEDS):
            if not len(rows):
                break
            m = bands.cuts[band[rows]]
            at = np.concatenate(([0], np.cumsum(m)))
            place = np.full(len(size), -1, dtype=np.int64)
            place[rows] = np.arange(len(rows))
            mine = place[doc]
            took = mine >= 0
            mine, x = mine[took], mix(gram[took] + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)))
            slot = at[mine] + ((x >> np.uint64(32)) * m[mine].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(at[-1], dtype=np.uint64)
            np.add.at(total, slot, mix(x))
            full = np.bincount(slot, minlength=at[-1])
            owner = np.repeat(np.arange(len(rows)), m)
            number = np.arange(at[-1]) - at[owner]
            name = (band[rows][owner].astype(np.uint64) * np.uint64(SEEDS) + np.uint64(seed)) * np.uint64(1 << 42) + number.astype(np.uint64)
            use = full > 0 if seed < SEEDS - 1 else np.ones(len(full), dtype=bool)
            out_doc.append(rows[owner[use]])
            out_tag.append(band[rows][owner[use]] * SEEDS + seed)
            out_key.append(mix(mix(total[use] + full[use].astype(np.uint64)) + name[use]))
            empty = np.bincount(owner[full == 0], minlength=len(rows))
            rows = rows[empty > bands.spare[band[rows]]]
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_tag), np.concatenate(out_key)


#: Odd factors that put n-grams into four orders; the first n-grams of two orders make a probe.
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def probes(doc: np.ndarray, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two probes of 32 bits for each set, in one number; ``doc`` ascends, and an empty set has 0."""
    out = np.zeros(len(size), dtype=np.uint64)
    if len(doc):
        at = (np.cumsum(size) - size)[size > 0]
        one, two, three, four = (mix(np.minimum.reduceat(gram * factor, at) + factor) for factor in _ORDERS)
        out[size > 0] = (mix(one + two) >> np.uint64(32) << np.uint64(32)) | (mix(three + four) >> np.uint64(32))
    return out


#: A key as it travels: its upper 48 bits. Two that only differ below make a class look shared, which later steps undo.
_PACKED = np.dtype([("high", "<u4"), ("low", "<u2"), ("who", "<u2")])
_WHO = np.dtype([("node", "<i8"), ("probe", "<u8"), ("tag", "<i2")])


def packed_keys(node: np.ndarray, probe: np.ndarray, doc: np.ndarray, tag: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, keys, who): the keys of a bucket with an index into who, the classes, probes and tags of these rows."""
    pair = np.stack([node.view(np.int64)[doc], tag], axis=1)
    found, first, index = np.unique(pair, axis=0, return_index=True, return_inverse=True) if len(pair) else (pair, doc, doc)
    index = index.ravel()
    who = np.empty(len(found), dtype=_WHO)
    who["node"], who["probe"], who["tag"] = found[:, 0], probe[doc[first]], found[:, 1]
    rows = []
    for begin in range(0, len(who), 1 << 16):  # an index has 16 bits
        mine = (index >= begin) & (index < begin + (1 << 16))
        k, i = key[mine], index[mine] - begin
        bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((i, k, bucket))
        k, i, bucket = k[order], i[order], bucket[order]
        once = np.ones(len(k), dtype=bool)
        once[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
        k, i, bucket = k[once], i[once], bucket[once]
        for at, end in zip(*_runs(bucket)):
            used, short = np.unique(i[at:end], return_inverse=True)
            out = np.empty(end - at, dtype=_PACKED)
            out["high"], out["low"], out["who"] = k[at:end] >> np.uint64(32), (k[at:end] >> np.uint64(16)) & np.uint64(0xFFFF), short
            rows.append((int(bucket[at]), out.tobytes(), who[begin + used].tobytes()))
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "keys", "who"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(values)) if len(at) else at


def _close(key: np.ndarray, probe: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whether another class has this key and this probe too."""
    order = np.lexsort((node, probe, key))
    key, probe, node = key[order], probe[order], node[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (probe[1:] != probe[:-1])
    at, end = _runs(np.cumsum(new))
    out = np.empty(len(key), dtype=bool)
    out[order] = np.repeat(node[at] != node[end - 1], end - at)
    return out


def shared_keys(bucket: pa.Table) -> pa.Table:
    """(node, tag, shared): for each class and tag, how many keys of the bucket another class has as well and none with an equal probe."""
    keys, whos = [], []
    for packed, who in zip(bucket.column("keys").to_pylist(), bucket.column("who").to_pylist()):
        one = np.frombuffer(packed, _PACKED)
        keys.append((one["high"].astype(np.uint64) << np.uint64(16)) | one["low"])
        whos.append(np.frombuffer(who, _WHO)[one["who"]])
    key, who = np.concatenate(keys), np.concatenate(whos)
    node, tag, probe = who["node"], who["tag"], who["probe"]
    order = np.lexsort((tag, node, key))
    key, node, tag, probe = key[order], node[order], tag[order], probe[order]
    once = np.ones(len(key), dtype=bool)
    once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (tag[1:] != tag[:-1])
    key, node, tag, probe = key[once], node[once], tag[once], probe[once]
    met = np.zeros(len(key), dtype=bool)
    met[1:] = key[1:] == key[:-1]
    met[:-1] |= met[1:]
    key, node, tag, probe = key[met], node[met], tag[met], probe[met]
    told = ~(_close(key, probe >> np.uint64(32), node) | _close(key, probe & np.uint64(0xFFFFFFFF), node))
    found, n = np.unique(np.stack([node[told], tag[told].astype(np.int64)], axis=1), axis=0, return_counts=True)
    return pa.table({"node": pa.array(found[:, 0], pa.int64()), "tag": pa.array(found[:, 1], pa.int64()), "shared": pa.array(n, pa.int64())})


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document and n-gram hash of all sets, each once; sizes; a hash of each set."""
    texts = lower_ascii(texts_of(batch.column("text")))
    doc, gram = ngrams(words_of(texts, hashes=Hashes(texts)), n, len(texts))
    once = ~pd.Series(mix(gram + doc.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))).duplicated().to_numpy() if len(doc) else np.zeros(0, bool)
    doc, gram = doc[once], gram[once]
    size = np.bincount(doc, minlength=len(texts))
    total = np.zeros(len(texts), dtype=np.uint64)
    np.add.at(total, doc, mix(gram))
    return doc, gram, size, mix(total + size.astype(np.uint64))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, size, component): one row per row of ``docs``, with the size of its set of word n-grams and the smallest id
    reachable over links.

    Two documents link when 100 * intersection >= percent * union. A text of fewer than n words is one n-gram. A null
    or empty text links with nothing and is its own component. Rows that repeat an id or a text link like any other
    equal texts; a null id is never a component's name while another id is there. Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    bands = Bands(percent)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def classes(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, gram, size, node = _sets(part, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), pa.array(size), pa.array(node.view(np.int64)),
                                                  pa.array(probes(doc, gram, size).view(np.int64))], ["id", "text_key", "size", "node", "probe"])

    all_docs = space.keep(in_batches(
        rows.withColumn("text_key", F.xxhash64("text")), classes, f"id {kind}, text_key long, size long, node long, probe long"))
    named = all_docs.where("size > 0")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    nodes = named.groupBy("node").agg(F.min("id").alias("label"), F.min(who).alias("who"))

    # Classes that share a probe with others.
    either = F.array(F.shiftrightunsigned("probe", 32) * 2, F.col("probe").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 + 1)
    probed = named.select("node", F.explode(either).alias("probe")).distinct()
    common = space.keep(probed.groupBy("probe").agg(F.count("*").alias("n")).where("n > 1").select("probe"))
    close = probed.join(small(common), "probe", "left_semi").select("node")

    # Classes that share enough fragments with others.
    buckets = (named.agg(F.sum("size")).first()[0] or 0) // BUCKET_GRAMS + 1

    def keys(batches):
        sent: set[int] = set()  # classes of this task, so that many copies of a text send their keys once a task
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, gram, size, node = _sets(part, n)
                probe = probes(doc, gram, size)
                if len(sent) > SENT_CLASSES:
                    sent.clear()
                fresh = np.array([x not in sent and not sent.add(x) for x in node.tolist()], dtype=bool)
                doc, gram = doc[fresh[doc]], gram[fresh[doc]]
                yield packed_keys(node, probe, *fragment_keys(doc, gram, np.where(fresh, size, 0), bands), buckets)

    keyed, tasks = in_batches(rows.select("text"), keys, "bucket long, keys binary, who binary"), buckets // BUCKETS_A_TASK + 1
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.repartition(tasks, "bucket")  # else the session's number is enough, and Spark draws small ones together
    met = keyed.groupBy("bucket").applyInArrow(shared_keys, "node long, tag long, shared long")
    need = F.element_at(F.array(*(F.lit(int(x)) for x in bands.need)), (F.floor(F.col("tag") / SEEDS) + 1).cast("int"))
    enough = met.groupBy("node", "tag").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= need).select("node")
    left = space.keep(enough.union(close).distinct())

    # Their n-grams, each class once, from the text of the document that gives the class its name.
    chosen = space.keep(nodes.join(left, "node"))
    wanted = chosen.select("node", F.col("who.id").alias("who_id"), F.col("who.text_key").alias("text_key"))
    spoken = rows.withColumn("text_key", F.xxhash64("text")).join(small(wanted), "text_key").where(F.col("id").eqNullSafe(F.col("who_id"))).select("text", "node")

    def grams(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, gram, size, node = _sets(part, n)
                use = (node.view(np.int64) == part.column("node").to_numpy(zero_copy_only=False))[doc]
                doc, gram = doc[use], gram[use]
                piece = ((gram >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((gram, piece, doc))
                doc, gram, piece = doc[order], gram[order], piece[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)[doc[at]]), pa.array(size[doc[at]]), pa.array(piece[at]), lists],
                                                 ["node", "size", "piece", "grams"])

    pieces = in_batches(spoken, grams, "node long, size long, piece long, grams array<long>")
    if all_docs.groupBy("id", "text_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        pieces = pieces.dropDuplicates(["node", "piece"])  # a row that is there more than once would come more than once
    pieces = space.keep(pieces)

    # The first n-grams of each class in the order by frequency, those of one class alone before all others.
    grams_of = pieces.select("node", "size", F.explode("grams").alias("gram"))
    often = grams_of.groupBy("gram").agg(F.count("*").alias("freq")).where("freq > 1")
    listed = grams_of.join(often, "gram").groupBy("node").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("list"))
    reach = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / F.lit(100)) + 1
    listed = listed.withColumn("alone", F.col("size") - F.size("list")).withColumn("head", F.slice("list", F.lit(1), F.greatest(F.lit(0), reach - F.col("alone")).cast("int")))
    slots = space.keep(listed.select("node", "size", "alone", F.posexplode("head").alias("pos", "one")).select(
        "node", "size", (F.col("alone") + F.col("pos")).alias("pos"), F.col("one.gram").alias("gram")))

    def fits(x: str, y: str):
        """Whether the overlap of the two can still be large enough when this is their first common n-gram."""
        needed = f"ceil({percent} * ({x}.size + {y}.size) / {100 + percent})"
        return F.expr(f"least({x}.size - {x}.pos, {y}.size - {y}.pos) >= {needed}")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that link: overlaps are counted per fragment and summed."""
        one = pieces.select(F.col("node").alias("a"), "piece", F.col("grams").alias("a_grams"))
        two = pieces.select(F.col("node").alias("b"), "piece", F.col("grams").alias("b_grams"))
        partial = pairs.join(one, "a").join(two, ["b", "piece"]).select("a", "b", "na", "nb", F.size(F.array_intersect("a_grams", "b_grams")).alias("overlap"))
        return partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap")).where(
            f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b")

    lead = slots.groupBy("gram").agg(F.min(F.struct("pos", "node", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1").select(
        "gram", F.col("lead.pos").alias("pos"), F.col("lead.node").alias("node"), F.col("lead.size").alias("size"))
    star = slots.alias("x").join(lead.alias("y"), F.col("x.gram") == F.col("y.gram")).where("x.node <> y.node").where(fits("x", "y"))
    pairs = star.selectExpr("y.node as a", "x.node as b", "y.size as na", "x.size as nb").distinct()
    links = space.keep(linked(pairs))
    names = chosen.select("node", "label")
    groups = components(names, links, space)

    # Pairs of different components that share a first n-gram.
    placed = space.keep(slots.join(groups.withColumnRenamed("label", "part"), "node", "left"))
    mixed = placed.groupBy("gram").agg(F.count("*").alias("n"), F.count("part").alias("with"), F.min("part").alias("low"), F.max("part").alias("high")).where(
        "n > 1 and (with < n or low < high)").select("gram")
    apart = placed.join(mixed, "gram", "left_semi")
    rest = apart.alias("x").join(apart.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node")) & fits("x", "y")
                                 & (F.col("x.part").isNull() | F.col("y.part").isNull() | (F.col("x.part") != F.col("y.part"))))
    pairs = rest.selectExpr("x.node as a", "y.node as b", "x.size as na", "y.size as nb").distinct()
    more = space.keep(linked(pairs))
    if more.limit(1).count():
        groups = components(names, links.union(more), space)

    final = nodes.join(groups.withColumnRenamed("label", "part"), "node", "left").select("node", F.coalesce("part", "label").alias("component"))
    out = all_docs.join(final, (all_docs["node"] == final["node"]) & (all_docs["size"] > 0), "left")
    return out.select("id", "size", F.coalesce("component", "id").alias("component"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_classes(documents(spark, sf_dir), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {"op9_jaccard": Query(op9_jaccard)}
