"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

A word is a run of bytes that are no separators. Words get a 64-bit hash of their bytes. Nothing here makes a Python object
per word, but for words of more than _SHORT bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each 64-bit number (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """The bytes of some texts one after the other; text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


@dataclass
class Words:
    doc: np.ndarray    # index of the text
    start: np.ndarray  # first byte in Texts.data
    end: np.ndarray    # one past the last byte
    hash: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """Null is taken as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    at = at.astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0]: at[-1]] if body is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return Texts(data, at - at[0])


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    at = texts_of(batch.column(column)).at
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def lower_ascii(texts: Texts) -> Texts:
    data = texts.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return Texts(data, texts.at)


#: Spans of up to so many bytes are hashed together, eight bytes at a time; longer ones, which are few, one by one.
_SHORT = 64
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class Hashes:
    """Hashes of spans of the texts, which depend on the bytes of a span alone.

    Each round mixes eight more bytes into the hash, so equal hashes of different spans of the same length of up to eight bytes are impossible,
    and of others as seldom as chance has it.
    """

    def __init__(self, texts: Texts):
        n = len(texts.data)
        self._data = np.zeros(n + 8, dtype=np.uint8)
        self._data[:n] = texts.data
        self._eight = np.ndarray(n + 1, dtype="<u8", buffer=self._data.data, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(np.uint64) + np.uint64(0xD1342543DE82EF95))
        left, at, live = size, start, None
        if size.max(initial=0) > _SHORT:
            live = np.flatnonzero(size <= _SHORT)
            left, at = size[live], start[live]
        while len(at):
            block = self._eight[at] & _FIRST[np.minimum(left, 8)]
            if live is None:
                out = mix(out ^ block)
            else:
                out[live] = mix(out[live] ^ block)
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            left, at = left[more] - 8, at[more] + 8
        body = memoryview(self._data)
        for i in np.flatnonzero(size > _SHORT).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(body[start[i]: end[i]], digest_size=8).digest(), "little")
        return out

    def differ(self, start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Which pairs of spans do not have the same bytes."""
        out = end - start != other_end - other_start
        live = np.flatnonzero(~out & (start != other_start))
        left, a, b = (end - start)[live], start[live], other_start[live]
        while len(live):
            mask = _FIRST[np.minimum(left, 8)]
            unlike = (self._eight[a] & mask) != (self._eight[b] & mask)
            out[live[unlike]] = True
            more = np.flatnonzero(~unlike & (left > 8))
            live, left, a, b = live[more], left[more] - 8, a[more] + 8, b[more] + 8
        return out


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes, cut where texts begin."""
    n = len(inside)
    first = np.zeros(n + 1, dtype=bool)
    first[at] = True
    first[0] = first[n] = True
    before = np.empty(n + 1, dtype=bool)
    before[0], before[1:] = False, inside
    here = np.empty(n + 1, dtype=bool)
    here[n], here[:n] = False, inside
    return np.flatnonzero(here & (first | ~before)), np.flatnonzero(before & (first | ~here))


def words_of(texts: Texts, separators: bytes = BLANKS, hashes: Hashes | None = None) -> Words:
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    start, end = edges(inside[texts.data], texts.at)
    doc = np.searchsorted(texts.at, start, side="right") - 1
    hashes = hashes or Hashes(texts)
    return Words(doc, start, end, hashes.of(start, end))


def ngrams(words: Words, n: int, n_texts: int, short_as_one: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each window of n words; with fewer words (if wanted) of the whole sequence."""
    count = np.bincount(words.doc, minlength=n_texts)
    x = np.zeros(max(0, len(words.doc) - n + 1), dtype=np.uint64)
    for i in range(n):
        x = mix(x * np.uint64(3) + words.hash[i: i + len(x)] + np.uint64(i + 1))
    whole = words.doc[: len(x)] == words.doc[n - 1:][: len(x)]
    doc, hashed = words.doc[: len(x)][whole], x[whole]
    few = np.flatnonzero((count > 0) & (count < n))
    if short_as_one and len(few):
        first = np.concatenate(([0], np.cumsum(count)))[few]
        y = np.zeros(len(few), dtype=np.uint64)
        for i in range(n - 1):
            more = count[few] > i
            y[more] = mix(y[more] * np.uint64(3) + words.hash[first[more] + i] + np.uint64(i + 1))
        y = mix(y + count[few].astype(np.uint64))
        doc, hashed = np.concatenate((doc, few)), np.concatenate((hashed, y))
        order = np.argsort(doc, kind="stable")
        doc, hashed = doc[order], hashed[order]
    return doc, hashed
