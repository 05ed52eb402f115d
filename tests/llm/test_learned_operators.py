"""Operators that learn or search: co-training, toxicity and packing against plain loops and bounds."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import cotraining, packing, toxicity
from millrace.llm.workspace import Workspace

EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "other text"), (5, "x" * 30000),
         (6, "w " * 3000), (7, "é ñ 漢字 🙂 naïve"), (8, "word and more, " * 70000), (None, None)]


# Co-training


def test_co_training(spark, sf_dir, docs):
    data = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    whole = spark.read.parquet(f"{data}/documents.parquet")
    made = cotraining.features(whole, Workspace(spark, "t"))
    model = cotraining.fit(made, labels)
    scored = cotraining.score(made, model).join(labels, "doc_id")
    assert scored.where("accepted = (quality = 1)").count() >= 0.97 * scored.count()
    assert cotraining.accepted(whole, model).count() == cotraining.score(made, model).where("accepted").count()
    edges = docs(*EDGES).withColumnsRenamed({"keys": "meta0", "word": "x", "size": "millrace_meta0"})
    assert cotraining.score(cotraining.features(edges, Workspace(spark, "t")), model).count() == len(EDGES)
    kept = cotraining.accepted(edges, model)
    assert kept.schema == edges.schema and kept.count() <= len(EDGES)
    none = cotraining.features(whole.where("false"), Workspace(spark, "t"))
    empty = cotraining.fit(none, labels.where("false"))
    assert empty.views is None and cotraining.score(none, empty).count() == 0


def plain_sums(views, scales, sure, text, meta, weight):
    """The exchange, document by document."""
    out = [[None, None], [None, None]]
    sets = (text, meta)
    for taker, label in itertools.product((0, 1), (0, 1)):
        giver, view = 1 - taker, views[taker]
        d = len(view.beta)
        n, gradient, hessian = 0.0, np.zeros(d), np.zeros((d, d))
        for i in range(len(weight)):
            odds = scales[giver][0] * float(views[giver](sets[giver][i:i + 1])[0]) + scales[giver][1]
            if (odds if label else -odds) >= sure[giver][label]:
                z = np.append(np.clip((sets[taker][i] - view.mean) / view.scale, -8, 8), 1)
                p = 1 / (1 + np.exp(-z @ view.beta))
                n, gradient, hessian = n + weight[i], gradient + weight[i] * (p - label) * z, hessian + weight[i] * p * (1 - p) * np.outer(z, z)
        out[taker][label] = (n, gradient, hessian)
    return out


def example(n, seed=3):
    """Two views that tell the label with some noise each."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    text = np.column_stack([y * 3 + rng.normal(size=n), rng.normal(size=(n, 2))])
    meta = np.column_stack([y * 2.5 + rng.normal(size=n), rng.normal(size=n)])
    return text, meta, y


def test_exchange_against_a_plain_loop():
    text, meta, y = example(400)
    views = [cotraining.Logistic(x[:200], y[:200]) for x in (text, meta)]
    scales, sure = [(1.2, 0.1), (0.9, -0.2)], [(1.0, 2.0), (2.5, 0.5)]
    weight = np.random.default_rng(1).random(400)
    found = cotraining.exchange(views, scales, sure, text, meta, weight)
    for sums, plain in zip(found, plain_sums(views, scales, sure, text, meta, weight)):
        for one, (n, gradient, hessian) in zip(sums, plain):
            assert n > 0 and np.isclose(one.n, n) and np.allclose(one.gradient, gradient) and np.allclose(one.hessian, hessian)
            again = cotraining._unflat(cotraining._flat(one), len(gradient))
            assert np.allclose(again.hessian, hessian) and np.allclose(again.gradient, gradient)


def test_pseudo_labels_help_a_view_with_few_labels():
    text, meta, y = example(6000)
    known = np.arange(6000) < 300
    fold = np.arange(300) % 3 == 0
    calls = []

    def unlabelled(views, scales, sure):
        calls.append(sure)
        return cotraining.exchange(views, scales, sure, text[~known], meta[~known], np.ones((~known).sum()))

    model = cotraining.co_train(text[known], meta[known], y[known], fold, unlabelled)
    right = ((model.chance(text[~known], meta[~known])[2] >= 0.5) == (y[~known] == 1)).mean()
    assert len(calls) == cotraining.ROUNDS and right > 0.95
    assert not np.allclose(model.views[0].beta, cotraining.Logistic(text[known][~fold], y[known][~fold]).beta)


def test_a_view_that_knows_nothing_is_not_believed():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    assert np.isinf(cotraining.sure_from(rng.normal(size=300) * 9, y, 0.0)).all()
    low, high = cotraining.sure_from((2.0 * y - 1) * 6, y, 0.0)
    assert 3 < low <= 6 and 3 < high <= 6


def test_fit_on_spark_is_the_plain_fit(spark, sf_dir):
    """The same documents, with the sums of the tasks added up, against one pass over all features in memory; also with copies and odd labels."""
    whole = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    copied = whole.where("doc_id < 300").selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars")
    odd = labels.union(labels.where("doc_id % 50 = 0").selectExpr("doc_id", "quality + 1", "toxic")).union(labels.limit(3).selectExpr("doc_id", "null", "toxic")).union(
        labels.limit(1).selectExpr("null", "1", "0")).union(labels.limit(1).selectExpr("-5", "0", "0"))
    made = cotraining.features(whole.union(copied), Workspace(spark, "t"))
    model = cotraining.fit(made, odd)
    rows = made.collect()
    label = {}
    for r in odd.collect():
        if r.doc_id is not None and r.quality is not None:
            label[r.doc_id] = min(label.get(r.doc_id, 9), r.quality)
    known = sorted((r for r in rows if r.id in label), key=lambda r: str(r.id))
    others = [r for r in rows if r.id not in label]
    weight = np.array([r.weight for r in others])
    assert np.isclose(sum(r.weight for r in rows), whole.select("text").distinct().count())
    text, meta = cotraining._arrays([r.x for r in others])
    plain = cotraining.co_train(*cotraining._arrays([r.x for r in known]), np.array([int(label[r.id] > 0) for r in known]), np.array([r.fold for r in known]),
                                lambda *state: cotraining.exchange(*state, text, meta, weight))
    for a, b in zip(model.views, plain.views):
        assert np.allclose(a.beta, b.beta, atol=1e-2)
    assert np.allclose(model.chance(text, meta)[2], plain.chance(text, meta)[2], atol=1e-2)


# Toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_value(text, words, stems, ordinary, exact):
    """The weighted hits by trying all terms on all words."""
    total = 0.0
    for m in toxicity.WORD.finditer(text or ""):
        word, edits = toxicity.plain(m[0]), []
        for term in words:
            k = 0 if term in exact else toxicity.edits_allowed(term)
            edits += [d for d in [edit_distance(word, term)] if d <= k]
        for term in stems:
            k = 0 if term in exact else toxicity.edits_allowed(term)
            near = [edit_distance(word[:n], term) for n in range(len(word) + 1)]
            edits += [d for d in [min(near)] if d <= k and (d == 0 or any(edit_distance(word[:n], term) <= k and n > d for n in range(len(word) + 1)))]
        if edits and not (min(edits) and word in ordinary):
            total += (toxicity.FUZZY_WEIGHT if min(edits) else 1.0) * (toxicity.QUOTED_WEIGHT if toxicity.is_quoted(text, m.start(), m.end()) else 1.0)
    return total


def test_scores_against_all_terms_and_words():
    rng = random.Random(11)
    words, ordinary, exact = ["idiot", "worthless", "scum", "abcdef", "disgusting"], frozenset(["idiom", "worth1ess"]), frozenset(["abcdef"])
    scorer = toxicity.Scorer(toxicity.Lexicon(words, [], ordinary, exact))
    pool = ["disgusting", "dizgustin", "disgstingg", "digusting", "disgustinggg", "idiot", "idi0t", "idiom", "ideot", "iddiot", "worthles", "w0rthless", "worthlezzz", "scum", "scam", "abcdef", "abcdeg", '"', "said", "the", "word", ".", "“", "”", "é", "Idiot"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        assert scorer.value(text) == pytest.approx(plain_value(text, words, [], ordinary, exact)), text


@pytest.mark.parametrize("stem", ["abcdef", "lowei", "abcabcabcabc"])
def test_no_spelling_is_passed_over(stem):
    """Every spelling of a stem or word within its edits has a part of it where it is looked for."""
    rng, k = random.Random(stem), toxicity.edits_allowed(stem)
    for is_stem in (True, False):
        lexicon = toxicity.Lexicon([] if is_stem else [stem], [stem] if is_stem else [])
        for _ in range(3000):
            word = list(stem)
            for _ in range(rng.randrange(k + 1)):
                i = rng.randrange(len(word) + 1)
                word[i:i + rng.randrange(2)] = rng.choice(["", "a", "x"])
            assert lexicon.may_fit("".join(word) + ("tail" if is_stem else ""))


def test_terms_of_any_length_and_rare_ordinary_use(spark):
    """Short and very long words are learned; one ordinary text with a misspelling does not clear it, ordinary words near a term do."""
    rng = random.Random(12)
    filler = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(600)]

    def text(*extra):
        some = rng.sample(filler, 25) + list(extra)
        rng.shuffle(some)
        return " ".join(some)

    long = "q" * 50_000
    rows = [(text("zux", rng.choice(["hatefull", "hatefulx", "hateful"])), 1) for _ in range(60)] + [(text("hateful", long), 1) for _ in range(20)]
    rows += [(text(), 0) for _ in range(300)] + [(text("hatefulx"), 0)] + [(text("grateful"), 0) for _ in range(40)]
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1][: len(rows)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows)] + [(None, 1), (ids[0], None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marked)
    assert "zux" in lexicon.words and long in lexicon.words
    scorer = toxicity.Scorer(lexicon)
    assert scorer.value("you zux") == 1 and scorer.value(long) == 1 and scorer.value("so grateful and zu") == 0
    assert scorer.value("so hatefulx") > 0
    once = toxicity.fit(docs, marked.where("toxic = 1"))
    assert "zux" in once.words
    none = toxicity.fit(docs, marked.where("toxic = 0"))
    assert not none.words and toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert not toxicity.fit(docs.where("false"), marked.where("false")).words


def test_unseen_ordinary_words_go_by_their_share():
    near = ["grateful", "hatefulz", "hateful1"]
    assert toxicity.found_as_spelled(["hatefuls"], [], [w + "s" for w in near], 100) == {"hatefuls"}
    assert toxicity.found_as_spelled(["hatefuls"], [], [w + "s" for w in near], 100_000) == frozenset()


def test_very_long_words_are_few_rows(spark):
    table = spark.createDataFrame([("x" * 40_000 + str(i), 5, 0, True) for i in range(6)] + [("abc", 9, 0, True), ("abcdef", 9, 0, True)], "word string, bad long, good long, hopeful boolean")
    found = toxicity.possible_stems(table, 30, 100).collect()
    assert len(found) <= 6 * (toxicity.MOST_STEM + 2) + 5 and {"abc", "abcdef", "abcd"} <= {r.stem for r in found}


# Packing


def contents(bins):
    return [c for c, n in bins.items() for _ in range(n)]


def gains(a, b, size):
    """Whether some move, one-for-one or two-for-one exchange of two bins increases the sum of squared fills."""
    def options(c):
        return [(), *((x,) for x in c), *itertools.combinations(c, 2)]

    fa, fb = sum(a), sum(b)
    for x, y in itertools.product(options(a), options(b)):
        if (len(x), len(y)) in ((1, 0), (0, 1), (1, 1), (2, 1), (1, 2), (2, 0), (0, 2)):
            more = sum(x) - sum(y)
            if fb + more <= size and fa - more <= size and (fa - more) ** 2 + (fb + more) ** 2 > fa ** 2 + fb ** 2:
                return True
    return False


@pytest.mark.parametrize("seed", range(12))
def test_the_search_ends_where_no_exchange_gains(seed):
    rng = random.Random(seed)
    low, high = rng.choice([(300, 1400), (600, 760), (1, 400), (100, 2048)])
    histogram = Counter(rng.randrange(low, high) for _ in range(rng.randrange(5, 60)))
    bins = packing.plan(histogram)
    assert Counter(x for c in contents(bins) for x in c) == histogram
    opened = [c for c in contents(bins) if sum(c) < packing.SEQUENCE]
    assert not any(gains(a, b, packing.SEQUENCE) for a, b in itertools.combinations(opened, 2))


def test_sequences_against_the_lower_bound():
    """Pieces of which three make a sequence only if they are well chosen."""
    rng = random.Random(1)
    histogram = Counter(rng.randrange(600, 761) for _ in range(3000))
    bound = -(-sum(x * n for x, n in histogram.items()) // packing.SEQUENCE)
    first, better = sum(packing.best_fit(histogram).values()), sum(packing.plan(histogram).values())
    assert bound <= better < first and better <= 1.03 * bound


def test_bins_of_many_lengths_take_part():
    """A bin of more lengths than any limit of old gives two of them for one."""
    many = tuple(range(58, 18, -1))  # 40 lengths
    assert sum(many) < 2048
    free = 2048 - sum(many)
    bins = packing.local_search(Counter({many: 1, (free + 57 + 58 - 1, 900): 1, (900, 100): 1}))
    assert max(sum(c) for c in bins) == 2048 or len(contents(bins)) < 3


def test_ties_and_long_texts_are_packed(docs):
    rows = [(i, "same words") for i in range(50)] + [(100, "word " * 200_000), (None, None), (100, "word " * 200_000)]
    got = packing.pack(docs(*rows)).collect()
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in ends.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert sum(r.length for r in got if r.doc_id == 100) == 2 * 200_002 and len({(r.piece, r.ids_crc32) for r in got if r.doc_id == 100}) == 98
    assert len(ends) == -(-sum(r.length for r in got) // packing.SEQUENCE)
