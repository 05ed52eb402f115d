"""Packing of documents into sequences of at most SEQUENCE tokens, improved by swap-based local search.

All that matters of a piece is its length, so the search works on the histogram of lengths, whose size does not depend
on the data: best-fit gives bins with the same content as one group with a count, and the local search exchanges
lengths between groups of underfull bins: moves, one-for-one and two-for-one swaps that increase the sum of squared fills, by
which emptier bins empty out. It ends when no exchange of any two bins is a gain. Every piece then finds its place by its rank among
the pieces of its length.

Ranks need no sort. Each task counts the pieces of a length that it has seen; a table of (task, length) counts
gives how many came before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .batches import in_batches
from .queries import Query, documents
from .tokens import load
from .words import chunks, texts_of
from .workspace import Workspace

SEQUENCE = 2048

Bins = Counter  # content (lengths, longest first) -> number of bins


def best_fit(histogram: dict[int, int], size: int = SEQUENCE) -> Bins:
    """Best-fit, longest first, of so many pieces of each length."""
    gaps: list[int] = []
    by_gap: dict[int, list[list]] = defaultdict(list)  # gap -> [content, number]
    done: Bins = Counter()

    def put(content: tuple[int, ...], gap: int, n: int) -> None:
        if n:
            if gap and gap not in by_gap:
                insort(gaps, gap)
            if gap:
                by_gap[gap].append([content, n])
            else:
                done[content] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                most = size // length
                put((length,) * most, size - most * length, left // most)
                rest = left % most
                if rest:
                    put((length,) * rest, size - rest * length, 1)
                break
            gap = gaps[at]
            content, n = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            most = gap // length
            whole = min(n, left // most)
            put(content + (length,) * most, gap - most * length, whole)
            left -= whole * most
            if whole < n and left:
                put(content + (length,) * left, gap - left * length, 1)
                whole += 1
                left = 0
            put(content, gap, n - whole)
    for groups in by_gap.values():
        for content, n in groups:
            done[content] += n
    return done


def _swap(content: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    items = list(content)
    for x in out:
        items.remove(x)
    return tuple(sorted((*items, *into), reverse=True))


@lru_cache(maxsize=100_000)
def _totals(content: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of a bin, the sums of two of its pieces, and all of these with 0, each once.

    A bin has few different lengths, as these add up to its size at most.
    """
    many = Counter(content)
    once = sorted(many)
    sums = {x + y for i, x in enumerate(once) for y in once[i + 1:]} | {2 * x for x, n in many.items() if n > 1}
    return tuple(np.array(sorted(x), dtype=np.int64) for x in (once, sums, sums | {0, *once}))


def _items(content: tuple[int, ...], total: int, most: int) -> tuple[int, ...] | None:
    """At most ``most`` pieces of a bin that add up to the total."""
    if total == 0:
        return ()
    if total in content:
        return (total,)
    if most > 1:
        for x in content:
            if total - x in content and (2 * x != total or content.count(x) > 1):
                return (x, total - x)
    return None


class _Takers:
    """What the open bins of each fill can give back: for every fill the totals of none, one (or also two) of the pieces of a bin.

    ``next`` has for each fill and total the smallest total from there on that some bin can give back.
    """

    NONE = 1 << 30

    def __init__(self, size: int, pairs: bool):
        self.size, self.pairs = size, pairs
        self.rows: dict[int, int] = {}  # fill -> row
        self.count = np.zeros((16, size + 1), dtype=np.int32)
        self.next = np.full((16, size + 1), self.NONE, dtype=np.int32)
        self.every, self.stale = np.arange(size + 1), set()

    def change(self, content: tuple[int, ...], by: int) -> None:
        fill = sum(content)
        row = self.rows.setdefault(fill, len(self.rows))
        if row == len(self.count):
            self.count = np.concatenate((self.count, np.zeros_like(self.count)))
            self.next = np.concatenate((self.next, np.full_like(self.next, self.NONE)))
        count = self.count[row]
        if self.pairs:
            count[_totals(content)[2]] += by
        else:
            count[0] += by
            count[_totals(content)[0]] += by
        self.stale.add(row)

    def _refresh(self) -> None:
        for row in self.stale:
            there = np.flatnonzero(self.count[row])
            self.next[row] = np.append(there, self.NONE)[np.searchsorted(there, self.every)]
        self.stale.clear()

    def best(self, giver_fill: int, totals: np.ndarray, fills: np.ndarray) -> tuple[int, int, int, int]:
        """(gain, total given, fill of the taker, total given back) of the best exchange with takers of these fills."""
        if not len(totals) or not len(fills):
            return 0, 0, 0, 0
        self._refresh()
        rows = np.array([self.rows[f] for f in fills.tolist()])
        least = np.maximum(0, totals[:, None] - (self.size - fills)[None, :])  # what must come back for the rest to fit
        back = self.next[rows[None, :], np.minimum(least, self.size)]
        more = totals[:, None] - back
        gain = np.where(more > 0, 2 * more.astype(np.int64) * (fills[None, :] - giver_fill + more), 0)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        return int(gain[i, j]), int(totals[i]), int(fills[j]), int(back[i, j])


def local_search(bins: Bins, size: int = SEQUENCE) -> Bins:
    """Exchange lengths between underfull bins as long as the sum of squared fills grows.

    The emptiest group of bins gives, and of all moves, one-for-one and two-for-one exchanges (either way round) the one
    with the largest gain is made, on as many bins as both groups have. A group that can give nothing waits, and is looked at
    again for the bins that have come about since. The sum of squares only grows, so the search ends, at bins of which no two have an exchange
    that is a gain.
    """
    bins = Counter(bins)
    one, two = _Takers(size, False), _Takers(size, True)
    at_fill: dict[int, dict[tuple[int, ...], None]] = defaultdict(dict)
    made: dict[int, int] = {}  # fill -> when a group of that fill last came about
    seen: dict[tuple[int, ...], int] = {}  # group -> up to when it has looked at all others
    heap: list[tuple[int, tuple[int, ...]]] = []
    now = 0

    def add(content: tuple[int, ...]) -> None:
        nonlocal now
        now += 1
        fill = sum(content)
        at_fill[fill][content] = None
        made[fill] = now
        one.change(content, 1)
        two.change(content, 1)
        heappush(heap, (fill, content))

    def remove(content: tuple[int, ...]) -> None:
        fill = sum(content)
        del at_fill[fill][content]
        if not at_fill[fill]:
            del at_fill[fill], made[fill]
        seen.pop(content, None)
        one.change(content, -1)
        two.change(content, -1)

    for content in sorted(c for c in bins if sum(c) < size):
        add(content)
    while True:
        if not heap:
            late = max(made.values(), default=0)
            for fill, contents in at_fill.items():
                for content in contents:
                    if seen[content] < late:
                        heappush(heap, (fill, content))
            if not heap:
                return bins
        fill, giver = heappop(heap)
        if giver not in at_fill.get(fill, ()):
            continue
        since = seen.get(giver, 0)
        # A bin cannot take from itself: alone, its own options are left out while it looks.
        alone = bins[giver] == 1
        if alone:
            one.change(giver, -1)
            two.change(giver, -1)
        fills = np.array([f for f, when in made.items() if when > since], dtype=np.int64)
        found = max((*two.best(fill, _totals(giver)[0], fills), 1), (*one.best(fill, _totals(giver)[1], fills), 2))
        if alone:
            one.change(giver, 1)
            two.change(giver, 1)
        gain, given, other, back, most = found
        if not gain:
            seen[giver] = now
            continue
        give = _items(giver, given, most)
        for taker in at_fill[other]:
            take = _items(taker, back, 2 if most == 1 else 1)
            if take is not None and (taker != giver or not alone):
                break
        n = min(bins[giver], bins[taker]) if taker != giver else bins[giver] // 2
        for old in {giver, taker}:
            bins[old] -= n if taker != giver else 2 * n
            if not bins[old]:
                del bins[old]
                remove(old)
        for new in (_swap(giver, give, take), _swap(taker, take, give)):
            if new:
                fresh = new not in bins
                bins[new] += n
                if fresh and sum(new) < size:
                    add(new)
        if giver in bins:
            heappush(heap, (fill, giver))


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> Bins:
    return local_search(best_fit(histogram, size), size)


def places(bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of each length go, by their rank: key (length and first rank), copies per bin, first sequence,
    and the offset of each copy. The number of rows depends on the plan alone."""
    used: Counter = Counter()
    key, copies, first, offsets = [], [], [], []
    sequence = 0
    for content, n in sorted(bins.items(), reverse=True):
        at = 0
        for length, many in sorted(Counter(content).items(), reverse=True):
            key.append((length << 44) + used[length])
            copies.append(many)
            first.append(sequence)
            offsets.append([at + i * length for i in range(many)])
            used[length] += n * many
            at += many * length
        sequence += n
    order = sorted(range(len(key)), key=key.__getitem__)
    start = np.concatenate(([0], np.cumsum([copies[i] for i in order]))).astype(np.int64)
    return (np.array([key[i] for i in order], dtype=np.int64), np.array([first[i] for i in order], dtype=np.int64), start,
            np.array([x for i in order for x in offsets[i]], dtype=np.int64))


def token_pieces(docs: DataFrame, size: int = SEQUENCE, end: int = 0, folder_of=None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): the pieces of each document's ids, followed by the id ``end``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        encoder, task, seen = load(folder_of), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                coded = encoder.encode(texts_of(part.column("text")))
                rows = []
                for i in range(part.num_rows):
                    ids = np.append(coded.ids[coded.at[i]: coded.at[i + 1]], np.uint32(end)).astype("<u4")
                    n, at, piece = len(ids), 0, 0
                    while at < n:
                        length = (n - at) % size or size
                        rows.append((i, piece, at, length, zlib.crc32(ids[at: at + length].tobytes()), task, seen[length]))
                        seen[length] += 1
                        at, piece = at + length, piece + 1
                row, *rest = zip(*rows)
                ids = part.column("doc_id").take(pa.array(row, pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rest, kinds))],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return in_batches(docs, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, folder_of=None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its token ids followed by id 0. One longer than ``size`` is cut into pieces of ``size``, of which the first
    may be shorter. A null or empty text is the id 0 alone. Rows are independent: repeated rows and null ids are packed like any
    other; other columns are not read. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "packing")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = space.keep(token_pieces(rows, size, folder_of=folder_of))
    counts = space.keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    key, first, start, offsets = places(plan(histogram, size))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, "rank")

    def work(batches):
        for batch in batches:
            mine = (batch.column("length").to_numpy().astype(np.int64) << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(key, mine, side="right") - 1
            many = start[at + 1] - start[at]
            nth = mine - key[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(first[at] + nth // many), pa.array(offsets[start[at] + nth % many])],
                                             [*names, "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(ranked, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op6_packing": Query(op6_packing)}
