"""Toxicity of documents by a learned lexicon, Levenshtein automata and the context of each hit.

The lexicon is learned from labelled documents: whole words, and stems with any ending where no one word stands out.
Terms are chosen one by one, each covering most toxic documents not yet covered, among those that hardly occur in others; so
the rare words of a copied document are not taken for toxic. Every word of a text is put through the trie of terms by a
Levenshtein automaton, which finds misspelled terms as well; spellings that are no rarer in ordinary training documents than in toxic
ones are left out, and so are those of terms near to which ordinary words keep turning up. All of this goes by shares of documents, so that it is
the same for few and many. A hit counts less between quotation marks or next to a word that reports speech. A logistic curve fitted on
the training rows makes the weighted number of hits a score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .queries import Query, documents
from .words import chunks
from .workspace import Workspace, small

#: Labelled rows to learn from at most, chosen by a hash of their text.
TRAIN_ROWS = 60_000
#: A term must occur in so many different toxic training texts, and in this share of them at least.
LEAST_TEXTS, LEAST_SHARE = 3, 0.003
#: Of the texts with a term, weighted for class sizes, so many must be toxic.
LEAST_PRECISION = 0.97
#: Terms that may cover the same text.
COVERS = 3
#: A stem has so many letters, at least and at most; whole words may have any number.
LEAST_STEM, MOST_STEM = 4, 24
#: Weight of a misspelled term, and of any term that is quoted.
FUZZY_WEIGHT, QUOTED_WEIGHT = 0.6, 0.25
#: The share of ordinary texts that may have a word that is near to a term and was not seen in training, for all terms together.
MOST_UNSEEN = 0.002
#: Characters on both sides of a hit that show whether it is quoted.
CONTEXT = 60
THRESHOLD = 0.7

#: Marks around quotations, and words that report them.
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
REPORTING = frozenset("said says quote quoted quotes quoting called term word words wrote dijo dice palabra sagte wort nannte dit mot appelé".split())

WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!*'’-]+[^\W\d_]+)*")
#: Signs that stand for letters inside a word.
STANDS_FOR = str.maketrans("013457@$!", "oieastasi")
JOINTS = re.compile(r"[-'’*]")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


@dataclass
class Lexicon:
    """Terms in a trie; a stem may have any ending."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    ordinary: frozenset = frozenset()
    exact: frozenset = frozenset()
    curve: tuple[float, float] = (3.0, -2.0)

    def __post_init__(self):
        self.trie: dict = {}
        self.whole = frozenset(self.words)
        # Parts of terms, one of which is whole in every spelling: at the begin or the end of a word of these lengths, or at these places.
        self.first: dict[str, tuple[int, float]] = {}
        self.last: dict[str, tuple[int, float]] = {}
        self.inside: list[tuple[str, int, int]] = []
        self.most = 0
        for term, is_stem in [*((w, False) for w in self.words), *((s, True) for s in self.stems)]:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            k = 0 if term in self.exact else edits_allowed(term)
            node["#"] = max(node.get("#", (0, False)), (k, is_stem), key=lambda x: (x[1], x[0]))
            self.most = max(self.most, k)
            # One of k + 1 parts of a term is whole in every spelling with k edits; only as many edits before it move it.
            cut = [len(term) * i // (k + 1) for i in range(k + 2)]
            parts = [term[x:y] for x, y in zip(cut, cut[1:])]
            fits = (len(term) - k, float("inf") if is_stem else len(term) + k)
            _widen(self.first, parts[0], fits)
            if k and not is_stem:
                _widen(self.last, parts[-1], fits)
            self.inside += [(part, at - k, at + k) for part, at in zip(parts[1:] if is_stem else parts[1:-1], cut[1:])]
        self.first_sizes, self.last_sizes = sorted({*map(len, self.first)}), sorted({*map(len, self.last)})

    def may_fit(self, word: str) -> bool:
        """Whether some part of a term is where a spelling would have it."""
        n = len(word)
        for size in self.first_sizes:
            fits = self.first.get(word[:size])
            if fits and fits[0] <= n <= fits[1]:
                return True
        for size in self.last_sizes:
            fits = self.last.get(word[-size:])
            if fits and fits[0] <= n <= fits[1]:
                return True
        return any(word.find(part, max(0, low), high + len(part)) >= 0 for part, low, high in self.inside)

    def __reduce__(self):
        # A trie of long terms is too deep to be sent; it is built again.
        return Lexicon, (self.words, self.stems, self.ordinary, self.exact, self.curve)

    def distance(self, word: str) -> int | None:
        """The fewest edits between the word and a term, as far as the term allows."""
        if word in self.whole:
            return 0
        if not self.may_fit(word):
            return None
        end = 1 << len(word)
        where: dict[str, int] = defaultdict(int)
        for i, c in enumerate(word):
            where[c] |= 1 << i
        best: int | None = None
        # The automaton's states: bit i of row e is set if i letters of the word are read with e edits.
        start = [(1 << (e + 1)) - 1 for e in range(self.most + 1)]
        stack = [(self.trie, start)]
        while stack:
            node, rows = stack.pop()
            for c, child in node.items():
                if c == "#":
                    k, is_stem = child
                    for e in range(k + 1):
                        # Letters after a stem are free; an edit may not be spent on leaving its last letter out.
                        if rows[e] & end or is_stem and rows[e] and (e == 0 or rows[e] & ~((1 << (e + 1)) - 1)):
                            best = e if best is None else min(best, e)
                            break
                    continue
                step, mask = [], where.get(c, 0)
                for e, row in enumerate(rows):
                    new = (row & mask) << 1
                    if e:
                        new |= rows[e - 1] | rows[e - 1] << 1 | step[e - 1] << 1
                    step.append(new & (2 * end - 1))
                if any(step):
                    stack.append((child, step))
        return best


def _widen(table: dict[str, tuple[int, float]], part: str, fits: tuple[int, float]) -> None:
    low, high = table.get(part, fits)
    table[part] = (min(low, fits[0]), max(high, fits[1]))


def plain(word: str) -> str:
    """A word in small letters without the signs that hide it."""
    word = word.lower()
    return JOINTS.sub("", word.translate(STANDS_FOR)) if not word.isalpha() else word


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit lies between quotation marks, or next to a word that reports speech, inside the window."""
    before, after = text[max(0, start - CONTEXT): start], text[end: end + CONTEXT]
    for a, b in zip(OPENING, CLOSING):
        if a == b:
            if before.count(a) % 2 == 1 and b in after and (a != "'" or re.search(r"(^|\s)'\w*[^']*$", before)):
                return True
        elif before.rfind(a) > before.rfind(b) and b in after:
            return True
    near = re.findall(r"[^\W\d_]+", before.lower())[-2:] + re.findall(r"[^\W\d_]+", after.lower())[:1]
    return not REPORTING.isdisjoint(near)


class Scorer:
    def __init__(self, lexicon: Lexicon, most_known: int = 100_000):
        self.lexicon, self.clean, self.hit, self.most_known = lexicon, set(), {}, most_known

    def value(self, text: str | None) -> float:
        """The weighted number of hits."""
        if not text:
            return 0.0
        found = set(WORD.findall(text))
        new = found - self.clean
        hits = {}
        for word in new:
            edits = self.hit.get(word)
            if edits is None:
                bare = plain(word)
                edits = self.lexicon.distance(bare)
                if edits is None or edits and bare in self.lexicon.ordinary:
                    self.clean.add(word)
                    continue
                self.hit[word] = edits
            hits[word] = edits
        if len(self.clean) > self.most_known:
            self.clean.clear()
        if not hits:
            return 0.0
        total = 0.0
        for m in WORD.finditer(text):
            edits = hits.get(m[0])
            if edits is not None:
                total += (FUZZY_WEIGHT if edits else 1.0) * (QUOTED_WEIGHT if is_quoted(text, m.start(), m.end()) else 1.0)
        return total

    def score(self, text: str | None) -> float:
        a, b = self.lexicon.curve
        return float(1 / (1 + np.exp(-(a * np.log1p(self.value(text)) + b))))


def held_out(id_column) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def limits(n_toxic: int, n_other: int) -> tuple[float, float]:
    """The least toxic texts of a term, and the weight of another text."""
    return max(LEAST_TEXTS, LEAST_SHARE * n_toxic), n_toxic / max(1, n_other)


def possible_stems(table: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """``(stem, word, bad, good, hopeful)``: the words under each stem that could be a term.

    The texts of a stem are at most the sum of its words' texts, so no stem that ``choose_terms`` would take is missing. Every word is
    also a stem of itself, however short or long it is.
    """
    least, weight = limits(n_toxic, n_other)
    # Sizes of the stems, and 0 for the whole word where it is none of them.
    size = F.length("word")
    sizes = F.when(size < LEAST_STEM, F.array(F.lit(0))).when(size > MOST_STEM, F.sequence(F.lit(LEAST_STEM), F.lit(MOST_STEM + 1))).otherwise(
        F.sequence(F.lit(LEAST_STEM), size))
    n = F.col("size")
    stem = F.when((n == 0) | (n > MOST_STEM), F.col("word")).otherwise(F.left("word", n))
    stems = table.select(F.explode(sizes).alias("size"), "*").select(stem.alias("stem"), *table.columns)
    bad, good = F.sum(F.when(F.col("hopeful"), F.col("bad")).otherwise(0)), F.sum("good")
    found = stems.groupBy("stem").agg(bad.alias("most"), good.alias("others")).where(
        (F.col("most") >= least) & (F.col("most") / (F.col("most") + F.col("others") * weight) >= LEAST_PRECISION))
    return stems.join(found.select("stem"), "stem", "left_semi")


def choose_terms(words: dict[str, tuple[list[int], int]], possible: dict[str, list[str]], n_toxic: int, n_other: int) -> tuple[list[str], list[str]]:
    """Whole words and stems. What is shorter or longer than a stem is a whole word.

    ``words``: the toxic texts (numbered) with each word, and the number of other texts with it; ``possible``: the words under
    each stem that may be taken.
    """
    under = possible
    least, weight = limits(n_toxic, n_other)
    fit: dict[str, set[int]] = {}
    for stem in sorted(under, key=len):
        if any(stem[:n] in fit for n in range(LEAST_STEM, min(len(stem), MOST_STEM + 1))):
            continue  # a shorter one is as good
        texts = set().union(*(words[w][0] for w in under[stem]))
        other = sum(words[w][1] for w in under[stem])
        if len(texts) >= least and len(texts) / (len(texts) + other * weight) >= LEAST_PRECISION:
            fit[stem] = texts
    covered: Counter = Counter()
    whole, stems = [], []
    while fit:
        gains = {s: sum(covered[t] < COVERS for t in texts) for s, texts in fit.items()}
        stem = max(gains, key=lambda s: (gains[s], s))
        if gains[stem] < least:
            break
        covered.update(fit.pop(stem))
        first = max(under[stem], key=lambda w: (len(words[w][0]), w))
        if not LEAST_STEM <= len(stem) <= MOST_STEM or 2 * len(words[first][0]) >= sum(len(words[w][0]) for w in under[stem]):
            whole.append(first)
        else:
            stems.append(stem)
    return sorted(whole), sorted(stems)


def fit_curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """A logistic curve over log(1 + value), by Newton's method with a weak prior that it rises."""
    x = np.stack([np.log1p(values), np.ones(len(values))], axis=1)
    prior, strength = np.array([4.0, -3.0]), np.array([0.05, 0.05])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - labels) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(strength), grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.1)), float(w[1])


def found_as_spelled(whole: list[str], stems: list[str], once: list[str], n_other: int) -> frozenset[str]:
    """Terms that get no automaton, as ordinary words near to them keep turning up.

    ``once``: words of a single ordinary text. Their share estimates the chance that the next text has a new one (Good and Turing). Terms take their
    misspellings, those with the smallest share first, until all together would reach MOST_UNSEEN.
    """
    alone = [(t, Lexicon([t] if t in whole else [], [] if t in whole else [t])) for t in (*whole, *stems)]
    unseen = sorted((sum(bool(one.distance(w)) for w in once) / max(1, n_other), t) for t, one in alone)
    total, out = 0.0, set()
    for share, term in unseen:
        total += share
        if total > MOST_UNSEEN:
            out.add(term)
    return frozenset(out)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Learn from the labelled rows that are not held out, each different text once, about ``train_rows`` of them at most.

    What the driver gets is bounded by that parameter: words of toxic training texts that pass the first count, and words near to
    terms. Words of any length can be terms; those of fewer than five letters are found as they are spelled. A document that is labelled more than
    once is toxic if any row says so; rows without id or label teach nothing. Without toxic rows the lexicon is empty and every score is
    low; without others every term of enough toxic texts counts.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    space = Workspace(docs.sparkSession, "toxicity")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).where("text is not null")
    # One document of each text, found by hashes, so that neither texts nor their words are shuffled.
    chosen = texts.select("doc_id", "text_key").join(marked, "doc_id").groupBy("text_key").agg(F.min(F.struct("doc_id", "toxic")).alias("one"))
    chosen = space.keep(chosen.select("text_key", "one.doc_id", "one.toxic"))
    rows = texts.join(small(chosen), ["doc_id", "text_key"]).select("text", "toxic")

    def count(batches):
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            text, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            out = [(w, i, t) for i, (s, t) in enumerate(zip(text, toxic)) for w in {plain(w) for w in WORD.findall(s)}]
            key = [hash_of(s) for s in text]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([key[x[1]] for x in out], pa.int64()),
                                              pa.array([bool(x[2]) for x in out], pa.bool_())], ["word", "doc", "toxic"])

    import xxhash

    def hash_of(s: str) -> int:
        return xxhash.xxh64_intdigest(s.encode("utf-8")) >> 1

    sizes = {bool(r.toxic): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic:
        return Lexicon()
    table = rows.mapInArrow(count, "word string, doc long, toxic boolean").groupBy("word").agg(
        F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    table = space.keep(table)
    # Words that occur mostly in toxic texts; the stems over them that could be terms, and all words under these.
    hopeful = (F.col("bad") > 0) & (F.col("good") * n_toxic < F.col("bad") * max(1, n_other) * 0.05)
    stems = space.keep(possible_stems(table.withColumn("hopeful", hopeful), n_toxic, n_other))
    spoken = rows.where("toxic > 0").mapInArrow(count, "word string, doc long, toxic boolean").select("word", "doc").distinct()
    wanted = space.keep(stems.where("hopeful").select("word").distinct())
    pairs = spoken.join(small(wanted), "word").groupBy("word").agg(F.collect_list("doc").alias("docs"))
    texts_with = {r.word: r.docs for r in pairs.collect()}
    words, under = {}, defaultdict(list)
    for r in stems.select("stem", "word", "good").collect():
        words[r.word] = (texts_with.get(r.word, []), r.good)
        under[r.stem].append(r.word)
    whole, stems_chosen = choose_terms(words, dict(under), n_toxic, n_other)
    lexicon = Lexicon(whole, stems_chosen)

    # Words near to a term in training texts; what is no rarer in ordinary ones is no misspelling.
    def near(batches):
        for batch in batches:
            found = pa.array([bool(lexicon.distance(w)) for w in batch.column("word").to_pylist()], pa.bool_())
            yield batch.filter(found)

    spelled = table.where("good > 0").select("word", "bad", "good").mapInArrow(near, "word string, bad long, good long").collect()
    ordinary = frozenset(r.word for r in spelled if r.good * n_toxic >= r.bad * n_other)
    once = [r.word for r in spelled if r.good == 1 and not r.bad]
    lexicon = Lexicon(whole, stems_chosen, ordinary, found_as_spelled(whole, stems_chosen, once, n_other))

    def values(batches):
        scorer = Scorer(lexicon)
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            found = [scorer.value(s) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), pa.array([bool(t) for t in batch.column("toxic").to_pylist()])], ["value", "toxic"])

    seen = rows.mapInArrow(values, "value double, toxic boolean").groupBy(F.least(F.round("value", 1), F.lit(50.0)).alias("value"), "toxic").agg(F.count("*").alias("n")).collect()
    x = np.repeat([r.value for r in seen], [r.n for r in seen])
    y = np.repeat([float(r.toxic) for r in seen], [r.n for r in seen])
    lexicon.curve = fit_curve(x, y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Only the text is used for the score. A null or empty text has the score of one without hits. Rows are independent: repeated rows
    and null ids give their own rows (a null id is not held out), other columns are not read, an empty table gives none.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches):
        scorer = Scorer(lexicon)
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            found = [scorer.score(s) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()),
                                              pa.array([int(x >= threshold) for x in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op4_toxicity": Query(op4_toxicity)}
