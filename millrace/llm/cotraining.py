"""Quality of documents by co-training of two views.

One classifier sees the text (its words by a hash, and the shape of its words, lines and bytes), the other the metadata of the page
(language, source, size). In each round each gives the other a label for every unlabelled document that it is sure of, by its
calibrated chance, and both are fitted anew to labelled and pseudo-labelled documents. In the end both are calibrated on labelled rows that
took no part, and a weight for each view, fitted on the same rows, combines them; a view that knows nothing gets no weight. All
documents are scored by the result.

The features of all documents are written once. A round is a pass over them: the tasks find the pseudo-labels and send the sums of
the gradient and the Hessian of the view that takes them, whose size does not depend on the data; the driver makes a Newton step
with these and the labelled rows. Only labelled rows are a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import in_batches
from .queries import Query, documents
from .words import BLANKS, Hashes, chunks, mix, texts_of, words_of
from .workspace import Workspace, small

#: Labelled documents to fit and calibrate on, at most, chosen by a hash of their id.
LABELLED_ROWS = 12_000
ROUNDS = 4
#: A pseudo-label needs this chance by calibration. Of the calibration rows that a view is as sure of, it must have so many right, and be
#: so much surer (in log odds) than a label drawn blindly; both as a lower bound of 95 percent, so that a view that knows nothing is not believed.
SURE, TRUST, LIFT = 0.97, 0.9, 1.5
#: Weight of all pseudo-labels together, as a share of the labelled rows; both classes share it evenly.
PSEUDO_SHARE = 0.5
#: The first this many per hundred labelled rows, by hash, only calibrate.
CALIBRATE = 30
#: Most rounds of Newton's method on the driver.
NEWTON = 25
#: Sums travel as whole numbers of this fraction, so that they do not depend on the order of the tasks.
FRACTION = 1 << 16

#: Columns into which words and pairs of words are hashed, and metadata.
WORDS = 64
META = 64


def text_features(batch: pa.RecordBatch) -> np.ndarray:
    """Each text as shares of kinds of characters, repetition, lengths, pairs of kinds of bytes, and hashed words and pairs of words."""
    texts = texts_of(batch.column("text"))
    n = len(texts)
    data = texts.data
    size = np.maximum(1, np.diff(texts.at)).astype(float)
    kinds = np.zeros(256, dtype=np.int64)  # 0 other, 1 small, 2 capital, 3 digit, 4 blank, 5 line, 6 stop, 7 symbol, 8 beyond ASCII
    for kind, which in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), b".,;:?", b"!#$%&*+<=>@^_|~\\/{}[]", range(128, 256)), 1):
        kinds[list(which)] = kind
    kind = kinds[data]
    columns = [texts.per_text(kind == k) / size for k in range(1, 9)]
    words = words_of(texts, BLANKS, Hashes(texts))
    count = np.bincount(words.doc, minlength=n)
    many = np.maximum(1, count).astype(float)
    length = (words.end - words.start).astype(float)
    columns += [np.log1p(size) / 10, np.log1p(count) / 10, np.bincount(words.doc, length, minlength=n) / many / 10,
                np.bincount(words.doc, length > 15, minlength=n) / many, np.bincount(words.doc, length < 4, minlength=n) / many]
    pair = np.zeros(len(words.doc), dtype=bool)
    pair[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    columns.append(np.bincount(words.doc, pair, minlength=n) / many)
    order = np.lexsort((words.hash, words.doc))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    columns.append(np.bincount(words.doc[order][first], minlength=n) / many)
    last = kind[np.maximum(words.end - 1, 0)] if len(words.end) else np.zeros(0, int)
    begin = kind[words.start] if len(words.start) else np.zeros(0, int)
    columns += [np.bincount(words.doc, last == k, minlength=n) / many for k in (1, 2, 3, 6, 7)]
    columns += [np.bincount(words.doc, begin == k, minlength=n) / many for k in (2, 3, 7)]
    two = np.zeros((n, 81))
    if len(data) > 1:
        doc = np.searchsorted(texts.at, np.arange(len(data) - 1), side="right") - 1
        inside = np.arange(1, len(data)) < texts.at[doc + 1]
        two = np.bincount(doc[inside] * 81 + (kind[:-1] * 9 + kind[1:])[inside], minlength=n * 81).reshape(n, 81)
    follows = words.doc[1:] == words.doc[:-1]
    said = np.concatenate((words.hash, mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])[follows]))
    doc = np.concatenate((words.doc, words.doc[1:][follows]))
    hashed = np.bincount(doc * WORDS + (mix(said) % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    found = np.column_stack([*columns, np.sqrt(two / size[:, None]), np.sqrt(hashed / (2 * many[:, None]))])
    return found.astype(np.float16).astype(np.float32)  # as they are kept


def meta_features(columns: list[list], numbers: list[bool]) -> np.ndarray:
    """Metadata hashed into META columns: each value, and numbers by their power of two."""
    import xxhash

    out = np.zeros((len(columns[0]) if columns else 0, META), dtype=np.float32)
    for i, (values, number) in enumerate(zip(columns, numbers)):
        for row, value in enumerate(values):
            name = "null" if value is None else f"2^{max(0, int(value)).bit_length()}" if number else str(value)
            out[row, xxhash.xxh32_intdigest(f"{i}={name}") % META] += 1
    return out


@dataclass
class Sums:
    """Gradient and Hessian of the log loss over some rows, and how many they are."""

    n: float
    gradient: np.ndarray
    hessian: np.ndarray

    @classmethod
    def none(cls, d: int) -> "Sums":
        return cls(0.0, np.zeros(d), np.zeros((d, d)))

    def add(self, z: np.ndarray, p: np.ndarray, label: int, weight: np.ndarray) -> None:
        self.n += weight.sum()
        self.gradient += z.T @ (weight * (p - label))
        self.hessian += (z * (weight * p * (1 - p))[:, None]).T @ z


class Logistic:
    """L2 logistic regression on standardised features, by Newton's method; classes weigh the same."""

    def __init__(self, x: np.ndarray, y: np.ndarray, strength: float = 1.0, balance: bool = True):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.strength, self.balance = strength, balance
        self.beta = np.zeros(x.shape[1] + 1)
        self.step(x, y, None)

    def step(self, x: np.ndarray, y: np.ndarray, given: list[Sums] | None) -> None:
        """Fit to labelled rows and, by their quadratic form around the present state, to the rows that ``given`` sums up by label."""
        z = self.standard(x)
        w = np.ones(len(y))
        if self.balance:
            for label in (0, 1):
                if (y == label).any():
                    w[y == label] = len(y) / 2 / (y == label).sum()
        ridge = np.full(z.shape[1], self.strength)
        ridge[-1] = 1e-3
        start, slope, curve = self.beta.copy(), np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2)
        for some in given or ():
            if some.n:
                share = PSEUDO_SHARE * len(y) / 2 / some.n
                slope, curve = slope + share * some.gradient, curve + share * some.hessian
        for _ in range(NEWTON):
            p = _chance(z @ self.beta)
            gradient = z.T @ (w * (p - y)) + ridge * self.beta + slope + curve @ (self.beta - start)
            step = np.linalg.solve((z * (w * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.diag(ridge) + curve, gradient)
            self.beta = self.beta - step
            if np.abs(step).max() < 1e-5:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self.standard(x) @ self.beta


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn log odds into a chance; a slope below zero becomes zero."""
    fitted = Logistic(odds[:, None], y, balance=False, strength=0.1)
    slope = float(fitted.beta[0] / fitted.scale[0])
    if slope <= 0:
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return 0.0, float(np.log(rate / (1 - rate)))
    return slope, float(fitted.beta[1] - slope * fitted.mean[0])


@dataclass
class Model:
    """Both views, their calibration, and the weight of each; without labels of both classes the base rate alone."""

    views: tuple | None
    scales: tuple = ()
    weights: tuple = ()
    base: float = 0.0

    def chance(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            flat = np.full(len(text), 1 / (1 + np.exp(-self.base)))
            return flat, flat, flat
        odds = [a * view(x) + b for view, (a, b), x in zip(self.views, self.scales, (text, meta))]
        both = self.base + sum(w * (o - self.base) for w, o in zip(self.weights, odds))
        return tuple(_chance(o) for o in (*odds, both))


def sure_from(odds: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """The calibrated log odds from which a view's labels 0 and 1 are believed; infinite if they never are."""
    out = []
    for label, side, blind in ((0, -odds, -base), (1, odds, base)):
        order = np.argsort(-side, kind="stable")
        n, right = np.arange(1, len(y) + 1), np.cumsum(y[order] == label)
        share, z2 = right / n, 1.645 ** 2
        least = (share + z2 / 2 / n - np.sqrt(z2 * share * (1 - share) / n + z2 * z2 / 4 / n / n)) / (1 + z2 / n)  # Wilson
        fits = np.flatnonzero(least >= max(TRUST, _chance(np.array(blind + LIFT))))
        out.append(max(np.log(SURE / (1 - SURE)), side[order[fits[-1]]]) if len(fits) else np.inf)
    return tuple(out)


def exchange(views, scales, sure, text: np.ndarray, meta: np.ndarray, weight: np.ndarray) -> list[list[Sums]]:
    """What each view learns from the labels that the other one is sure of, by label: [taker][label]."""
    sets = (text, meta)
    out = []
    for taker in (0, 1):
        giver = 1 - taker
        a, b = scales[giver]
        odds = a * views[giver](sets[giver]) + b
        sums = []
        for label, side in ((0, -odds), (1, odds)):
            some = Sums.none(len(views[taker].beta))
            rows = np.flatnonzero(side >= sure[giver][label])
            if len(rows):
                z = views[taker].standard(sets[taker][rows])
                some.add(z, _chance(z @ views[taker].beta), label, weight[rows])
            sums.append(some)
        out.append(sums)
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, unlabelled: Callable[..., list[list[Sums]]], rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows, y 0 or 1. ``fold`` marks those kept for calibration; ``unlabelled`` does ``exchange`` over all others."""
    known, held = np.flatnonzero(~fold), np.flatnonzero(fold)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if any(len(np.unique(y[rows])) < 2 for rows in (known, held)):
        return Model(None, base=base)
    sets = (text, meta)
    views = [Logistic(x[known], y[known]) for x in sets]
    for _ in range(rounds):
        scales = [calibrate(view(x[held]), y[held]) for view, x in zip(views, sets)]
        sure = [sure_from(a * view(x[held]) + b, y[held], base) for view, (a, b), x in zip(views, scales, sets)]
        if np.isinf(sure).all():
            break
        given = unlabelled(views, scales, sure)
        if not any(some.n for sums in given for some in sums):
            break
        for view, x, sums in zip(views, sets, given):
            view.step(x[known], y[known], sums)
    scales = [calibrate(view(x[held]), y[held]) for view, x in zip(views, sets)]
    odds = np.column_stack([a * view(x[held]) + b - base for (a, b), view, x in zip(scales, views, sets)])
    # Weights that only add: a view whose weight would be negative is left out.
    use = [0, 1]
    weights = [0.0, 0.0]
    while use:
        fitted = Logistic(odds[:, use], y[held], balance=False, strength=0.5)
        found = fitted.beta[:-1] / fitted.scale
        if (found > 0).all():
            for i, w in zip(use, found):
                weights[i] = float(min(w, 2.0))
            break
        use = [i for i, w in zip(use, found) if w > 0]
    return Model(tuple(views), tuple(scales), tuple(weights), base)


def _features(meta_cols: list[str], numbers: list[bool]):
    """(text features, metadata features) of the rows of a batch."""
    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return text_features(batch), meta_features([batch.column(c).to_pylist() for c in meta_cols], numbers)

    return of


def _numbers(docs: DataFrame, meta_cols) -> list[bool]:
    kinds = dict(docs.dtypes)
    return [kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal") for c in meta_cols]


def _prepared(docs: DataFrame, id_col: str, text_col: str, meta_cols) -> tuple[DataFrame, list[bool]]:
    """(id, text, meta0, meta1, ...): the text as text, numbers as whole numbers, all else as text."""
    numbers = _numbers(docs, meta_cols)
    columns = [_cast(docs[c], number).alias(f"meta{i}") for i, (c, number) in enumerate(zip(meta_cols, numbers))]
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *columns), numbers


def _cast(column, number: bool):
    return column.cast("long" if number else "string")


def features(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", meta_cols=("lang", "source", "n_chars")) -> DataFrame:
    """(id, fold, weight, x): the features of every row, written once. A row of a text that is there n times weighs 1 / n."""
    rows, numbers = _prepared(docs, id_col, text_col, meta_cols)
    names = [f"meta{i}" for i in range(len(numbers))]
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"k1": F.xxhash64(text), "k2": F.hash(text)})
    repeated = space.keep(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"))
    rows = rows.join(small(repeated), ["k1", "k2"], "left").select(
        "id", "text", *names, (F.pmod(F.xxhash64("k1"), F.lit(100)) < CALIBRATE).alias("fold"), (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))
    of = _features(names, numbers)

    def work(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                both = np.column_stack(of(part)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("fold"), part.column("weight"), pa.array([r.tobytes() for r in both], pa.binary())],
                                                 ["id", "fold", "weight", "x"])

    return space.keep(in_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, fold boolean, weight double, x binary"))


def _arrays(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(packed), np.float16).reshape(len(packed), -1).astype(np.float64)
    return x[:, :-META], x[:, -META:]


def fit(made: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit to the features of ``features`` and the labels (doc_id, quality).

    About ``labelled_rows`` labelled documents at most, by a hash of their id, are gathered on the driver; all other rows take part
    without a label, as sums. A document that is labelled more than once has its smallest label; of rows with the same id one is
    taken. Without rows of both classes the model knows the base rate alone.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("y"))
    marked = marked.join(made.select("id").distinct(), "id", "left_semi")
    space = Workspace(made.sparkSession, "cotraining-fit")
    marked = space.keep(marked.select("id", (F.col("y") > 0).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("pick")))
    share = min(1.0, labelled_rows / max(1, marked.count()))
    chosen = space.keep(marked.where(F.col("pick") < int(share * (1 << 30))).select("id", "y"))
    taught = made.join(small(chosen), "id").groupBy("id").agg(F.min(F.struct("x", "fold", "y")).alias("one")).select("id", "one.*")
    found = sorted(taught.collect(), key=lambda r: str(r.id))  # bounded by ``labelled_rows``
    if not found:
        return Model(None)
    text, meta = _arrays([r.x for r in found])
    others = made.join(small(chosen), "id", "left_anti").select("weight", "x")

    def unlabelled(views, scales, sure) -> list[list[Sums]]:
        sizes = [len(view.beta) for view in views]

        def work(batches):
            total = [[Sums.none(d) for _ in (0, 1)] for d in sizes]
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    new = exchange(views, scales, sure, *_arrays(part.column("x").to_pylist()), part.column("weight").to_numpy())
                    for sums, more in zip(total, new):
                        for one, other in zip(sums, more):
                            one.n, one.gradient, one.hessian = one.n + other.n, one.gradient + other.gradient, one.hessian + other.hessian
            flat = np.rint(np.concatenate([_flat(one) for sums in total for one in sums]) * FRACTION).astype(np.int64)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["cell", "total"])

        flat = np.zeros(sum(2 * (1 + d + d * (d + 1) // 2) for d in sizes))
        for row in in_batches(others, work, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect():
            flat[row.cell] = row.total / FRACTION
        out, at = [], 0
        for d in sizes:
            width = 1 + d + d * (d + 1) // 2
            out.append([_unflat(flat[at + i * width: at + (i + 1) * width], d) for i in (0, 1)])
            at += 2 * width
        return out

    return co_train(text, meta, np.array([r.y for r in found]), np.array([r.fold for r in found]), unlabelled, rounds)


def _flat(sums: Sums) -> np.ndarray:
    """All sums in a row; the Hessian is symmetric, so its upper half is enough."""
    return np.concatenate(([sums.n], sums.gradient, sums.hessian[np.triu_indices(len(sums.gradient))]))


def _unflat(flat: np.ndarray, d: int) -> Sums:
    hessian = np.zeros((d, d))
    hessian[np.triu_indices(d)] = flat[1 + d:]
    return Sums(flat[0], flat[1: 1 + d], hessian + np.triu(hessian, 1).T)


SCORES = "text_score double, meta_score double, score double, accepted boolean"


def score(made: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``features``: doc_id, text_score, meta_score, score (chance of good quality by each view and by both), accepted.

    A null text counts as empty, null metadata as a value of its own. Rows are independent: repeated rows and null ids give their own
    rows; an empty table gives none.
    """
    kind = made.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                text, meta, both = model.chance(*_arrays(part.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, (text, meta, both, both >= 0.5))],
                                                 ["doc_id", "text_score", "meta_score", "score", "accepted"])

    return in_batches(made.select("id", "x"), work, f"doc_id {kind}, {SCORES}")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", meta_cols=("lang", "source", "n_chars")) -> DataFrame:
    """The rows of ``docs`` that the model accepts, unchanged, whatever other columns they have."""
    numbers = _numbers(docs, meta_cols)
    names, plain = docs.columns, [f"millrace_meta{i}" for i in range(len(numbers))]
    while set(plain) & set(names):
        plain = [f"_{c}" for c in plain]
    rows = docs.withColumns({c: _cast(docs[m], number) for c, m, number in zip(plain, meta_cols, numbers)})
    at, of = names.index(text_col), _features([f"meta{i}" for i in range(len(numbers))], numbers)

    def work(batches):
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string()), *batch.columns[len(names):]], ["text", *(f"meta{i}" for i in range(len(numbers)))])
            done = 0
            for part in chunks(named, "text"):
                keep = model.chance(*of(part))[2] >= 0.5
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).slice(done, part.num_rows).filter(pa.array(keep))
                done += part.num_rows

    return in_batches(rows, work, docs.schema)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features(documents(spark, sf_dir), Workspace(spark, "cotraining"))
    return score(made, fit(made, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op1_cotraining": Query(op1_cotraining)}
