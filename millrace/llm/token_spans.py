"""Token counts of the sections of a document, from one encoding of the whole document.

A document is encoded once. The bytes of its tokens, added up, give the characters that each token covers, and these spans
are joined to the spans of the sections: both are in order, so the join is a search in sorted numbers. A token that
lies in several sections is allocated by a rule:

* ``most``: to the section that holds most of its bytes, the first of these on a tie;
* ``start``: to the section in which it starts.

The counts of the sections always add up to the tokens of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .queries import Query, documents
from .tokens import load
from .words import chunks, texts_of

RULES = ("most", "start")


def allocate(token_end: np.ndarray, section_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it lies in several. Both partition the same bytes, given by their ends."""
    start = np.concatenate(([0], token_end))[:-1]
    low = np.searchsorted(section_end, start, side="right")
    high = np.searchsorted(section_end, token_end, side="left")
    section = low.copy()
    if rule == "most":
        for i in np.flatnonzero(low < high):
            bounds = np.concatenate(([start[i]], section_end[low[i]: high[i]], [token_end[i]]))
            section[i] = low[i] + int(np.diff(bounds).argmax())
    return section, low < high


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "most", folder_of=None) -> DataFrame:
    """One row per section of each row of ``docs``: doc_id, section, start, end (in characters, the separator belongs to the section
    before it), n_tokens, n_crossing (tokens allocated to it that reach into another section).

    A section ends with each ``separator`` (one ASCII character). A null or empty text is one empty section without tokens.
    Rows are independent: repeated rows and null ids give their own rows; other columns are not read; an empty table gives none.
    """
    if rule not in RULES or len(separator) != 1 or not separator.isascii():
        raise ValueError(f"rule must be one of {RULES}, and the separator one ASCII character")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches):
        encoder = load(folder_of)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = texts_of(part.column("text"))
                coded = encoder.encode(texts)
                n = len(texts.data)
                # Section ends in bytes: after each separator, and where texts end; an empty text is a section too.
                own = np.flatnonzero(texts.data == ord(separator)) + 1
                ends = np.unique(np.concatenate((own, texts.at[1:][texts.at[1:] > texts.at[:-1]]))).astype(np.int64)
                token_end = np.cumsum(encoder.bytes_of[coded.ids])
                section, crossing = allocate(token_end, ends, rule)
                n_tokens = np.bincount(section, minlength=len(ends))
                n_crossing = np.bincount(section[crossing], minlength=len(ends))
                begin = np.concatenate(([0], ends))[:-1]
                doc = np.searchsorted(texts.at, begin, side="right") - 1
                chars = np.zeros(n + 1, dtype=np.int64)
                np.cumsum((texts.data & 0xC0) != 0x80, out=chars[1:])
                zero = chars[texts.at[doc]] if len(doc) else doc
                empty = np.flatnonzero(texts.at[1:] == texts.at[:-1])
                none = np.zeros(len(empty), dtype=np.int64)
                first = np.searchsorted(doc, doc, side="left")
                columns = [np.concatenate(x) for x in ((doc, empty), (np.arange(len(doc)) - first, none), (chars[begin] - zero, none),
                                                       (chars[ends] - zero, none), (n_tokens, none), (n_crossing, none))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])],
                                                 ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(work, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")


def op8_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir))


QUERIES = {"op8_token_spans": Query(op8_token_spans)}
