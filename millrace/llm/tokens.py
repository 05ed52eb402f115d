"""Token ids of many texts at once, by a public byte-level BPE vocabulary.

The vocabulary's pattern cuts a text into pieces that are encoded alone. The cuts are found for a whole batch with
numpy, and each different piece is encoded once per task: most pieces are common words. Pieces are found by a hash, and their bytes
are compared with those that were encoded. The special tokens of the vocabulary count as such where a text spells them, as the
tokenizer has it.
"""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .words import Hashes, Texts

#: Files of one vocabulary: the tokenizer's, and the same as ranks.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Different pieces that a task remembers.
MOST_PIECES = 200_000

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: White space as the pattern's \\s takes it, and the endings after an apostrophe.
_BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_BLANKS] = _SPACE
    return out


@dataclass
class Encoded:
    """Ids of some texts one after the other; those of text i are ids[at[i]:at[i + 1]]."""

    ids: np.ndarray
    at: np.ndarray


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[bytes, int]):
        import tiktoken

        self.special = special
        self._encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        tokens = {**ranks, **special}
        self.bytes_of = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
        for token, i in tokens.items():
            self.bytes_of[i] = len(token)
        self._class = _classes()
        self._forget()

    def _forget(self) -> None:
        self._row: dict[int, tuple[int, bytes]] = {}
        self._ids, self._ends = array("I"), array("q", [0])

    def cuts(self, texts: Texts) -> np.ndarray:
        """The byte at which each piece starts."""
        lead = np.flatnonzero((texts.data & 0xC0) != 0x80)
        chars = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        n = len(chars)
        if not n:
            return np.zeros(0, dtype=np.int64)
        kind = self._class[chars]
        begins = np.zeros(n + 1, dtype=bool)
        begins[np.searchsorted(lead, texts.at)] = True
        begins[n] = True
        special = self._special(texts)
        begins[np.searchsorted(lead, special.ravel())] = True
        blank, space = kind == _SPACE, chars == 0x20
        run = begins[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        after_space = np.zeros(n, dtype=bool)
        after_space[1:] = space[:-1]
        after_space &= ~begins[:n]
        starts = run & (blank | ~after_space)
        # The last of several blanks before a word stands alone, or with the word.
        last_blank = blank[:-1] & ~blank[1:] & ~begins[1:n]
        starts[:-1] |= last_blank
        # An apostrophe that starts a piece takes an ending along.
        mark = np.flatnonzero(starts & (chars == 0x27))
        for ending in _ENDINGS:
            k = len(ending)
            at = mark[mark + k < n]
            fits = np.ones(len(at), dtype=bool)
            for j, c in enumerate(ending, 1):
                fits &= (chars[at + j] == ord(c)) & ~begins[at + j]
            at = at[fits]
            starts[at + 1] = False
            starts[(at + k + 1)[at + k + 1 < n]] = True
            mark = np.setdiff1d(mark, at, assume_unique=True)
        for a, b in np.searchsorted(lead, special):
            starts[a: b] = False
            starts[a] = True
        return lead[starts]

    def _special(self, texts: Texts) -> np.ndarray:
        """First byte and end of each special token that a text spells."""
        body, found = texts.data.tobytes(), []
        for token in self.special:
            at = body.find(token)
            while at >= 0:
                if np.searchsorted(texts.at, at, side="right") == np.searchsorted(texts.at, at + len(token), side="left"):  # in one text
                    found.append((at, at + len(token)))
                    at += len(token) - 1
                at = body.find(token, at + 1)
        return np.array(sorted(found), dtype=np.int64).reshape(-1, 2)

    def _ids_of(self, piece: bytes) -> list[int]:
        return [self.special[piece]] if piece in self.special else self._encode(piece.decode("utf-8"))

    def encode(self, texts: Texts) -> Encoded:
        start = self.cuts(texts)
        end = np.append(start[1:], len(texts.data))
        hashes = Hashes(texts)
        code, first = pd.factorize(hashes.of(start, end))
        if len(self._row) > MOST_PIECES:
            self._forget()
        where = np.full(len(first), -1, dtype=np.int64)
        where[code[::-1]] = np.arange(len(code) - 1, -1, -1)  # where each different piece occurs first
        row, rows = self._row, np.empty(len(first), dtype=np.int64)
        body = texts.data.tobytes()

        def added(piece: bytes) -> int:
            self._ids.extend(self._ids_of(piece))
            self._ends.append(len(self._ids))
            return len(self._ends) - 2

        for i, (key, at) in enumerate(zip(first.tolist(), where.tolist())):
            piece = body[start[at]: end[at]]
            known = row.get(key)
            if known is None or known[1] != piece:
                known = row[key] = (added(piece), piece)
            rows[i] = known[0]
        mine = rows[code]
        for i in np.flatnonzero(hashes.differ(start, end, start[where][code], end[where][code])).tolist():  # other bytes with the same hash
            mine[i] = added(body[start[i]: end[i]])
        ends = np.frombuffer(self._ends, dtype=np.int64)
        ids = np.frombuffer(self._ids, dtype=np.uint32) if len(self._ids) else np.zeros(0, np.uint32)
        size = ends[mine + 1] - ends[mine]
        total = np.concatenate(([0], np.cumsum(size)))
        out = ids[np.repeat(ends[mine] - total[:-1], size) + np.arange(total[-1])]
        del ends, ids  # the arrays cannot grow while they are viewed
        return Encoded(out, total[np.searchsorted(start, texts.at)])


def load(folder_of=None) -> Encoder:
    """The encoder of the public vocabulary; ``folder_of`` gives a file's place by its name."""
    import public_tokenizers

    place = folder_of or public_tokenizers.path
    with open(place(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(place(TOKENIZER), encoding="utf-8") as file:
        special = {x["content"].encode(): x["id"] for x in json.load(file)["added_tokens"]}
    return Encoder(ranks, public_tokenizers.PATTERN, special)
