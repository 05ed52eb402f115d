"""Repetition inside a document, from the suffix array of its words.

Suffix arrays of many documents are built together by prefix doubling: suffixes are ranked by their first word, then
by 2, 4, 8, ... words, and only those that still share a rank are sorted again. The document is part of the first
rank, so suffixes of different documents never meet. The ranks after each step also tell whether two suffixes agree
in 2^k words, which gives the longest common prefix (LCP) of neighbours by descending powers of two.

Where the LCP array stays at or above ``min_words`` lie the LCP intervals of the repeats worth counting. The deepest
interval that holds a suffix names the longest repeat starting there; every maximal repeat with ``min_words`` words or
more is one of these, at each of its places, and their spans are united.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .queries import Query, documents
from .words import BLANKS, Hashes, Texts, Words, chunks, edges, mix, texts_of, words_of

SYMBOLS = b"#*$%&|<>"

#: A repeat counts from so many words on.
MIN_WORDS = 10
#: Most percent of the words that may lie in repeats, and that the longest repeat may have.
MAX_COVERED, MAX_LONGEST = 45, 30

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "kept boolean, covered_words long, longest_repeat long")


def suffix_ranks(doc: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last ranks are all different.

    Suffixes with equal ranks agree in so many words and have them all.
    """
    n = len(doc)
    count = np.bincount(doc) if n else np.zeros(0, int)
    left = (np.cumsum(count)[doc] if n else doc) - np.arange(n)  # words from here to the end of the document
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = key[order][1:] != key[order][:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(at, size)
    active = order[np.repeat(size, size) > 1]
    levels, k = [rank], 1
    while len(active):
        nxt = np.zeros(len(active), dtype=np.int64)
        more = left[active] > k
        nxt[more] = rank[active[more] + k] + 1
        old = rank[active]
        by = np.lexsort((nxt, old))
        active, old, nxt = active[by], old[by], nxt[by]
        new_old = np.ones(len(active), dtype=bool)
        new_old[1:] = old[1:] != old[:-1]
        new = new_old.copy()
        new[1:] |= nxt[1:] != nxt[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(active)))
        group = np.flatnonzero(new_old)[np.cumsum(new_old) - 1]
        rank = rank.copy()
        rank[active] = old + np.repeat(begin, size) - group
        levels.append(rank)
        active = active[np.repeat(size, size) > 1]
        k *= 2
    return levels


def repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each word, the words of the longest substring that starts there and occurs again in its document."""
    n = len(doc)
    levels = suffix_ranks(doc, word)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    same = doc[a] == doc[b]
    lcp = np.zeros(max(0, n - 1), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        fits = same & (a + lcp < n) & (b + lcp < n) & (doc[x] == doc[a]) & (doc[y] == doc[b])
        lcp += np.where(fits & (rank[x] == rank[y]), 1 << level, 0)
    best = np.zeros(n, dtype=np.int64)
    if n > 1:
        np.maximum.at(best, a, lcp)
        np.maximum.at(best, b, lcp)
    return best


def _union(length: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document inside the spans that start at each word with the given length."""
    n = len(length)
    if not n:
        return np.zeros(n_docs, dtype=np.int64)
    reach = np.maximum.accumulate(np.where(length > 0, np.arange(n) + length, 0))
    return np.bincount(doc[reach > np.arange(n)], minlength=n_docs)


def measure(texts: Texts, min_words: int, max_covered: int, max_longest: int) -> dict[str, np.ndarray]:
    n = len(texts)
    hashes = Hashes(texts)
    words: Words = words_of(texts, BLANKS, hashes)
    n_words = np.bincount(words.doc, minlength=n)
    inside = np.ones(256, dtype=bool)
    inside[list(BLANKS)] = False
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    in_word = inside[texts.data]
    starts_point = (texts.data & 0xC0) != 0x80

    start, end = edges(texts.data != 10, texts.at)
    total = np.concatenate(([0], np.cumsum(in_word)))
    lines = total[end] > total[start]
    start, end = start[lines], end[lines]
    line_doc = np.searchsorted(texts.at, start, side="right") - 1
    key = mix(hashes.of(start, end) + line_doc.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    dup_lines = np.bincount(line_doc[pd.Series(key).duplicated().to_numpy()], minlength=n)

    word = pd.factorize(words.hash)[0]
    m = max(0, len(word) - 2)
    whole = words.doc[:m] == words.doc[2:]
    window = mix(mix(mix(words.hash[:m]) + words.hash[1: m + 1]) + words.hash[2:])
    window = mix(window + words.doc[:m].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    found = np.zeros(len(word), dtype=np.int64)
    at = np.flatnonzero(whole)
    found[at] = np.where(pd.Series(window[at]).duplicated(keep=False), 3, 0)
    n_repeat = _union(found, words.doc, n)

    best = repeats(words.doc, word)
    covered = _union(np.where(best >= min_words, best, 0), words.doc, n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, words.doc, best)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (100 * covered <= max_covered * n_words) & ((longest < min_words) | (100 * longest <= max_longest * n_words))
    return {"n_words": n_words, "word_chars": texts.per_text(in_word & starts_point), "n_symbols": texts.per_text(symbol[texts.data]),
            "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept,
            "covered_words": covered, "longest_repeat": longest}


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``docs``: the id and MEASURES.

    ``kept`` is false if the base fails, if more than ``max_covered`` percent of the words lie in repeats of
    ``min_words`` words or more, or if the longest such repeat has more than ``max_longest`` percent of them. A null
    text counts as one without words, which fails the base. Rows are independent: repeated rows and null ids give a
    row each, other columns are not read, an empty table gives none. The words of one text must fit in a task's memory.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def work(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = measure(texts_of(part.column("text")), min_words, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c]) for c in names)], ["doc_id", *names])

    return rows.mapInArrow(work, f"doc_id {kind}, {MEASURES}")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(documents(spark, sf_dir))


QUERIES = {"op3_repetition": Query(op3_repetition)}
