"""Secrets in documents: fixed patterns, and strings that look random to character Markov models.

Two first-order models give the chance of each character after the one before: one of random strings, one of ordinary
identifiers. Both are counted over all documents, each different text once: what the fixed patterns find (without its
keyword) is random, the other words are ordinary. A string is added where the log-likelihood ratio of the models is high.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import in_batches
from .queries import Query, documents
from .words import chunks
from .workspace import Workspace, small

#: The patterns of the base and the least length of what they find.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")

#: What the models are asked about, and the alphabet that they know.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words of ordinary identifiers, which texts may lack; they are counted in the usual ways of writing them together.
ORDINARY = ("get set user account identifier name value index table column source target buffer size limit request response "
            "event handler manager service client server config option parameter default version create update delete "
            "internal public static final string number object array result error message connection session "
            "page title long slug some data file path time date start end count total").split()
#: Log-likelihood ratio in nats per character, and in all, from which a string is a secret.
PER_CHAR, IN_ALL = 0.6, 16.0

_CODE = np.full(128, -1, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_HEX_MARK = bytes(ord("h") if chr(c) in "0123456789abcdef" else 0 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, in code points."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"h" * 16 in text.encode("utf-8", "replace").translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]


def pair_counts(texts) -> np.ndarray:
    """How often each character follows another: [0] in ordinary words, [1] in what the fixed patterns find."""
    size = len(ALPHABET)
    words: list[list[str]] = [[], []]
    for text in texts:
        spans = base_spans(text)
        at = 0
        for start, kind, end in spans:
            words[0] += WORD.findall(text, at, max(at, start))
            piece = ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]
            words[1] += CANDIDATE.findall(piece)
            at = max(at, end)
        words[0] += WORD.findall(text, at)
    out = np.zeros((2, size * size), dtype=np.int64)
    for label, found in enumerate(words):
        if found:
            # Every word ends with a space, whose code is -1.
            x = _CODE[np.frombuffer((" ".join(found)).encode("ascii"), dtype=np.uint8)]
            both = (x[:-1] >= 0) & (x[1:] >= 0)
            out[label] = np.bincount(x[:-1][both] * size + x[1:][both], minlength=size * size)
    return out


def written_together(words: list[str] = ORDINARY) -> str:
    """Identifiers of three words each: joined by capitals, underscores (small and large) and hyphens."""
    out = []
    for i in range(len(words)):
        some = [words[(i * step + step) % len(words)] for step in (1, 7, 11)]
        out += [some[0] + some[1].title() + some[2].title(), "_".join(some), "_".join(some).upper(), "-".join(some), "".join(x.title() for x in some)]
    return " ".join(out)


def ratio_table(counts: np.ndarray) -> np.ndarray:
    """Log of the chance of each character after another if random, over that if ordinary.

    Half a count is added for each pair. Without samples of secrets the model of random strings is uniform.
    """
    size = len(ALPHABET)
    both = counts.reshape(2, size, size) + 0.5
    chance = both / both.sum(axis=2, keepdims=True)
    # A secret may use letters that the samples lack: a third of the random model is uniform.
    chance[1] = chance[1] * 2 / 3 + 1 / 3 / size
    return np.log(chance[1]) - np.log(chance[0])


def looks_random(s: str, table: np.ndarray, per_char: float = PER_CHAR, in_all: float = IN_ALL) -> bool:
    x = codes(s)
    total = float(table[x[:-1], x[1:]].sum())
    return total >= in_all and total >= per_char * (len(s) - 1)


def all_spans(text: str, table: np.ndarray) -> list[tuple[int, int, int]]:
    """The base spans and, beside them, the strings that look random."""
    base = base_spans(text)
    more, ahead, reach = [], iter(base), 0
    here = next(ahead, None)
    for m in CANDIDATE.finditer(text):
        # Both go by their start, so it is enough to know how far the base spans reach that begin before the string ends.
        while here is not None and here[0] < m.end():
            reach = max(reach, here[2])
            here = next(ahead, None)
        if reach <= m.start() and looks_random(m[0], table):
            more.append((m.start(), 3, m.end()))
    return sorted(base + more) if more else base


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of log ratios, from all documents, each different text once.

    The tasks send sums of fixed size. Equal texts are found by their hashes, and each of n copies counts as one nth, so that
    texts are not shuffled to tell them apart. Of an empty table the models know ORDINARY alone.
    """
    space = Workspace(docs.sparkSession, "secrets")
    texts = docs.select(docs[text_col].cast("string").alias("text")).where("text is not null")
    keyed = texts.select("text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    repeated = space.keep(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"))
    rows = keyed.join(small(repeated), ["k1", "k2"], "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    size = 2 * len(ALPHABET) ** 2

    def count(batches):
        total = np.zeros(size)
        for batch in batches:
            for part in chunks(batch, "text"):
                by_weight = defaultdict(list)
                for (text, copies), here in Counter(zip(part.column("text").to_pylist(), part.column("copies").to_pylist())).items():
                    by_weight[here / copies].append(text)
                for weight, some in by_weight.items():
                    total += pair_counts(some).ravel() * weight
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    counts = pair_counts([written_together()]).ravel() * 20
    for row in in_batches(rows, count, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row.pair] += round(row.n)  # the copies of a text sum up to a whole number
    return ratio_table(counts)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, table: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the number of base spans of each kind, their digest, and all spans.

    Spans are in code points, end exclusive. A null or empty text has none. Rows are independent, so repeated rows and null
    ids are kept; other columns are not read; an empty table gives none.
    """
    table = fit(docs, text_col) if table is None else table
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def work(batches):
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                spans = all_spans(text, table) if text else []
                base = [x for x in spans if x[1] < 3]
                for kind in range(3):
                    columns[kind].append(sum(x[1] == kind for x in base))
                columns[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns[4].append(joined(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, table: np.ndarray | None = None, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret in the text replaced by ``mark``; overlapping spans give one mark."""
    table = fit(docs, text_col) if table is None else table
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in (part for whole in batches for part in chunks(whole, text_col)):
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                spans = all_spans(text, table) if text else []
                if spans:
                    out, done = [], 0
                    for start, _, end in spans:
                        if start >= done:
                            out += [text[done:start], mark]
                        done = max(done, end)
                    texts[i] = "".join(out) + text[done:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1:]], batch.schema.names)

    return in_batches(docs, work, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


QUERIES = {"op7_secrets": Query(op7_secrets)}
