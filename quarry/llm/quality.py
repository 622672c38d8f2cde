"""Quality classifier learnt from positive and unlabelled texts (non-negative risk estimator, logistic loss).

Trusted positives are documents labelled 1. The unlabelled side is a sample of all documents, whatever their labels, and
the class prior is estimated from the two: labels 0 are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, ngram_hashes, slices, string_buffers, word_hashes

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!?", "#$%&*+=@^~", "|<>{}[]()", "\"'`", ":;-_/\\")
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    for _c in _g:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    if not len(h):
        return np.zeros(n)
    with np.errstate(over="ignore"):
        key = (h << np.uint64(20)) >> np.uint64(20) | row.astype(np.uint64) << np.uint64(44) if n <= 1 << 20 else h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(key, return_index=True)
    return np.bincount(row[first], minlength=n)


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of numbers for each whole text: shares of kinds of characters, word lengths, repetition."""
    out = []
    for i, j in slices(offsets):
        part, own, n = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], j - i
        size = np.diff(part)
        doc = np.repeat(np.arange(n), size)
        shares = np.bincount(doc * _CLASSES + _CLASS[own], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
        h, row = word_hashes(part, own)
        words = np.bincount(row, minlength=n)
        some = np.maximum(words, 1)
        again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) / some if len(h) else np.zeros(n)
        three, at = ngram_hashes(h, row, 3)
        threes = np.bincount(at, minlength=n)
        letters = shares[:, 0] + shares[:, 1] + shares[:, -1]
        more = [
            np.log1p(size) / 10,
            np.log1p(words) / 8,
            np.minimum((size - words) / some, 40) / 10,
            _distinct(h, row, n) / some,
            np.where(threes > 0, _distinct(three, at, n) / np.maximum(threes, 1), 1),
            again,
            shares[:, 0] / np.maximum(letters, 1e-9),
            (shares[:, 7:12].sum(1)) / np.maximum(letters, 1e-9),
            np.minimum(shares[:, 7:12].sum(1) * size / some, 5),
        ]
        out.append(np.column_stack([shares, *more]))
    return np.concatenate(out) if out else np.zeros((0, _CLASSES + 9))


@dataclass
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 0, unbiased: bool = True) -> Model:
    """Minimise prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) by Adam; not ``unbiased``: prior * R_P(+) + R_U(-).

    Where the estimate of the negative risk of a batch falls below zero, the step ascends on it instead, so that the
    risk of the unlabelled texts cannot be fitted below zero. Without positives every score is the prior.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    width = every.shape[1]
    if not len(positive) or not len(unlabelled):
        level = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(np.log(level / (1 - level)))])
    model = Model(unlabelled.mean(0), unlabelled.std(0) + 1e-6, [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())])
    xp, xu = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (positive, unlabelled))
    m, v, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    rounds = max(1, len(xu) // batch)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs) + 1e-5
        for _ in range(rounds):
            p, u = xp[rng.integers(0, len(xp), batch)], xu[rng.integers(0, len(xu), batch)]
            w1, b1, w2, b2 = model.weights
            x = np.concatenate([p, u])
            a = np.tanh(x @ w1 + b1)
            z = a @ w2 + b2
            zp, zu = z[:batch], z[batch:]
            share = prior if unbiased else 0.0
            negative = np.logaddexp(0, zu).mean() - share * np.logaddexp(0, zp).mean()
            gn = np.concatenate([-share * sigmoid(zp), sigmoid(zu)]) / batch
            gp = np.concatenate([prior * (sigmoid(zp) - 1), np.zeros(batch)]) / batch
            g = gp + gn if negative >= 0 else -gn
            ga = np.outer(g, w2) * (1 - a * a)
            grads = [x.T @ ga + decay * w1, ga.sum(0), a.T @ g + decay * w2, g.sum()]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                model.weights[k] = model.weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0, slack: float = 0.01, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, by the best bin of a classifier of the two.

    A classifier is fitted on one half of each. On the other halves, the unlabelled hold above any threshold at least
    the prior times the positives' share there, so the least ratio of the two shares, over thresholds where confidence
    bounds leave it meaning, estimates the prior. Without rows on either side it is one half.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    model = fit(halves[0][0], halves[1][0], 1.0, epochs=20, seed=seed, unbiased=False)
    p, u = (np.sort(model.logit(h[1])) for h in halves)
    at = np.unique(p)
    above_p, above_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    blur = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    best = int(np.argmin(above_u / above_p + (1 + slack) * blur / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _measured(docs: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` rows (_hash, _text), those that hash lowest; rows of one hash count once."""

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_hash"), pa.array(list(features(*string_buffers(b.column("_text")))), pa.list_(pa.float64()))], names=["h", "x"])
            give_back()

    got = docs.select("_hash", "_text").mapInArrow(measure, "h long, x array<double>").dropDuplicates(["h"]).orderBy("h").limit(most).toPandas()
    return np.array(got["x"].tolist()).reshape(len(got), _CLASSES + 9)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality", where=None) -> Model:
    """Fit on at most ``most`` trusted positives and at most ``most`` unlabelled texts, those that hash lowest.

    Trusted positives are rows whose label is 1, the unlabelled texts rows of ``docs`` with labels unread; ``where``
    limits both. The class prior is estimated from them. Rows with a null key or label are no labels; repeated labels
    of a key count once (1 if at least half say so). Repeated rows count once; null texts are empty. Without positives
    or texts every score is one half.
    """
    rows = docs.select(F.col(key).alias("_key"), key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if where is not None:
        rows, known = rows.where(where), known.where(where)
    rows = rows.select("_key", "_text").withColumn("_hash", F.xxhash64("_key", "_text"))
    known = known.groupBy(F.col(key).alias("_key")).agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("_one")).where("_one")
    trusted = known.orderBy(F.xxhash64("_key"), "_key").limit(most).select("_key")  # bounded, so it can be broadcast
    positive = _measured(rows.join(F.broadcast(trusted), "_key"), most)
    share = min(1.0, 2 * most / max(rows.count(), 1))
    unlabelled = _measured(rows.where(F.pmod(F.xxhash64("_hash"), F.lit(1 << 30)) <= int(share * (1 << 30))), most)
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: the probability of label 1 of each whole text (null: empty).

    A column of ``docs`` that is called like ``name`` is replaced. An empty table stays empty.
    """
    names = [c for c in docs.columns if c != name]
    schema = docs.select(*names).schema.add(name, "double")

    def judge(batches):
        for b in batches:
            offsets, data = string_buffers(b.column(text))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(model.score(features(offsets, data)), pa.float64())], names=schema.names)
            give_back()

    return docs.select(*names).mapInArrow(judge, schema)
