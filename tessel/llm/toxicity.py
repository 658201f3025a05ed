"""Toxicity: a counterfactually regularised classifier.

A logistic model over the presence of words, word beginnings and word endings is fitted on labelled texts. Every
sentence of those texts that names a group (IDENTITY) is also taken with its identity terms swapped for another term
of the same group and for a neutral noun; the squared change of the model's logit between a sentence and its swapped
forms is added to the loss, so that a mention of a group by itself moves the score as little as the data allow.

The fit uses at most SAMPLE labelled rows, those with the smallest hash of their id, in one task; the model holds at most
FEATURES features (those that tell the classes apart best, by LEAST_Z at least), so what executors receive is bounded.
Scoring reads each text once, whole and however long it is, without a shuffle.

Null or empty text: the model's score without features. Unlabelled or null labels are not used; two different labels for one
id count as two rows, and of documents with one id the smallest text trains. Without rows of both classes every score is the share of toxic rows (0 without rows). Documents with
a null id are scored; repeated rows are scored each. Further columns of the inputs are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

SAMPLE, FEATURES, LEAST_Z, PENALTY, RIDGE, ROUNDS, THRESHOLD = 6000, 1536, 4.0, 1.0, 5e-5, 300, 0.3
#: Interchangeable terms for groups of people, by kind; the first of each kind is the neutral noun.
IDENTITY = [
    "people women men girls boys".split(), "person woman man girl boy".split(), "believers christians muslims jews hindus buddhists atheists sikhs".split(), "religious christian muslim jewish hindu buddhist atheist sikh".split(),
    "people gays lesbians heterosexuals bisexuals".split(), "human gay lesbian straight bisexual transgender queer".split(), "citizens immigrants refugees foreigners natives".split(), "human black white asian latino african european arab".split(),
    "people blacks whites asians latinos africans europeans arabs".split(), "person disabled blind deaf autistic".split(), "people elderly young".split(),
    "personnes femmes hommes musulmans chrétiens juifs noirs blancs".split(), "menschen frauen männer muslime christen juden schwarze weiße".split(), "personas mujeres hombres musulmanes cristianos judíos negros blancos".split(),
]
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_GROUP = {w: kind for kind in IDENTITY for w in kind[1:]}


def features_of(word: str) -> tuple[str, ...]:
    return (word, f"^{word[:4]}", f"^{word[:5]}", f"{word[-4:]}$") if len(word) > 4 else (word, f"^{word}") if len(word) == 4 else (word,)


class _Features(dict):
    """The features that a white-space delimited token brings, remembered; forgets all beyond `most` tokens."""

    def __init__(self, among=None, most: int = 200_000):
        super().__init__()
        self.among, self.most = among, most

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        found = tuple(f for w in _WORD.findall(token) for f in features_of(w) if self.among is None or f in self.among)
        self[token] = found
        return found

    def of(self, text: str) -> set[str]:
        return {f for token in set(text.split()) if (own := self[token]) for f in own}


def swaps(words: list[str]) -> list[list[str]]:
    """The words with each identity term replaced by the next of its kind, and by the kind's neutral noun; none without such a term."""
    if not any(w in _GROUP for w in words):
        return []
    other = lambda w, kind: kind[1 + kind.index(w) % (len(kind) - 1)]
    return [[other(w, _GROUP[w]) if w in _GROUP else w for w in words], [_GROUP[w][0] if w in _GROUP else w for w in words]]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    known: _Features = field(init=False, repr=False)

    def __post_init__(self):
        self.known = _Features(self.weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self.known.of((text or "").lower()))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.empty(0, dtype=np.int64)]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def fit(texts: list[str], labels: list[int], penalty: float = PENALTY) -> Model:
    """Fit in one process; the rows are a bounded sample."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model({}, math.log(share / (1 - share)))
    # features are numbered as they come and a text keeps numbers only: the sample's memory is a few hundred bytes a word
    features, number, bags, pairs = _Features(most=20_000), {}, [], []
    numbers = lambda text: np.array(sorted(number.setdefault(f, len(number)) for f in features.of(text)), dtype=np.int32)
    for text in texts:
        low = (text or "").lower()
        bags.append(numbers(low))
        if any(w in low for w in _GROUP):
            for sentence in _SENTENCE.split(low):
                words = _WORD.findall(sentence)
                pairs += [(numbers(" ".join(words)), numbers(" ".join(x))) for x in swaps(words)]
    seen = [np.bincount(np.concatenate([x for x, k in zip(bags, labels, strict=True) if k == label]), minlength=len(number)).astype(float) for label in (0, 1)]
    n1, n0 = y.sum(), len(y) - y.sum()
    df, p = seen[0] + seen[1], (seen[0] + seen[1]) / len(y)
    z = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(np.where((p > 0) & (p < 1), p * (1 - p), np.inf) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((df >= 3) & (z >= LEAST_Z))
    swapped = np.array(sorted(number[f] for w in _GROUP for f in features_of(w) if f in number), dtype=np.int64)
    good = good[np.argsort(-z[good], kind="stable")][:FEATURES]
    chosen = np.unique(np.concatenate([swapped, good]))
    column = np.full(len(number), -1)
    column[chosen] = np.arange(len(chosen))
    names = [""] * len(chosen)
    for f, i in number.items():
        if column[i] >= 0:
            names[column[i]] = f
    place = {f: i for i, f in enumerate(names)}
    number.clear()
    at = lambda ids: column[ids][column[ids] >= 0]
    x = _Rows([at(b) for b in bags], len(place))
    one, two = (_Rows([at(p[k]) for p in pairs], len(place)) for k in (0, 1))
    w, bias = np.zeros(len(place)), math.log(n1 / n0)
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for t in range(1, ROUNDS + 1):
        g = (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y) / len(y)
        grad = x.back(g) + RIDGE * w
        if pairs:
            change = penalty * 2 * (one.dot(w) - two.dot(w)) / len(pairs)
            grad += one.back(change) - two.back(change)
        grad = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(w[i]) for f, i in place.items() if w[i]}, float(bias))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """A model of at most `sample` labelled rows outside the held-out remainder (crc32 of the id modulo 4 is 2)."""
    chosen = labels.selectExpr("doc_id as __id", "cast(toxic as int) as __toxic").where("__id is not null and __toxic in (0, 1)").where(crc_mod("__id", 4) != 2).distinct()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__toxic").limit(sample)
    rows = documents.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id", "__toxic").agg(F.min("__text").alias("__text"))
    fitted = rows.select("__id", "__toxic", "__text").groupBy(F.lit(0).alias("__all")).applyInArrow(_fitting(penalty), "feature string, weight double").collect()
    if not fitted:
        return fit([], [])
    return Model({r["feature"]: r["weight"] for r in fitted if r["feature"] is not None}, next(r["weight"] for r in fitted if r["feature"] is None))


def _fitting(penalty: float):
    """The fit as a task, which keeps the sample out of the driver's memory: a row for each weight, the bias without a feature."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("__id", "__toxic", "__text")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
        model = fit([t for _, _, t in rows], [y for _, y, _ in rows], penalty)
        return pa.table({"feature": pa.array([*model.weights, None], pa.string()), "weight": pa.array([*model.weights.values(), model.bias], pa.float64())})

    return run


def _slices(batches, rows: int = 256):
    """Batches in runs of a few rows, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def score(documents: DataFrame, model: Model, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """The given columns (by default doc_id) and each text's score."""
    columns = ["doc_id"] if columns is None else columns

    def run(batches):
        for batch in _slices(batches):
            made = [model.score(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], names=[*(f"__c{i}" for i in range(len(columns))), "__score"])

    kinds = "".join(f"__c{i} {documents.schema[c].dataType.simpleString()}, " for i, c in enumerate(columns))
    out = documents.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)), F.col("text").cast("string").alias("__text"))
    return out.mapInArrow(run, f"{kinds}__score double").withColumnsRenamed({**{f"__c{i}": c for i, c in enumerate(columns)}, "__score": name})


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(documents, learn(documents, labels))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, all their columns."""
    model, at = learn(documents, labels), documents.columns.index("text")

    def run(batches):
        for batch in _slices(batches):
            yield batch.filter(pa.array([model.score(x) < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
