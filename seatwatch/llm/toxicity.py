"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character 4- and 5-grams (lower-cased, whitespace runs
as one space, hashed to 2**BITS buckets an order).  Each n-gram's presence is scaled
by its smoothed log-count ratio between the classes, which counts less the less evidence
(``doubt``, ``power``) it rests on; logistic regression on the scaled presences
gives the weights.  Every n-gram of the sample has a weight; the weights are
one dense table over the buckets, whose size BITS fixes.

Nulls and empty texts score the bias alone.  Extra columns are ignored; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .text_arrays import char_codes, gram_buckets

BITS = 20
ORDERS = (4, 5)


@dataclass
class ToxicityModel:
    weights: np.ndarray  #: float32, len(ORDERS) << BITS: of each bucket's presence; order k starts at k << BITS
    bias: float
    stats: dict = field(default_factory=dict)


class _Presence:
    """The distinct features of texts, by marking a table of all buckets instead of sorting."""

    def __init__(self):
        self.mark = np.zeros(len(ORDERS) << BITS, np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = np.concatenate([gram_buckets(codes, n, BITS).astype(np.int32) + (k << BITS) for k, n in enumerate(ORDERS)])
        at = np.arange(len(found), dtype=np.int32)
        self.mark[found] = at  # the last place of each bucket stays
        return found[self.mark[found] == at]


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the distinct feature ids of its n-grams."""
    presence = _Presence()
    return [presence.of(char_codes([t])[0]) for t in texts]


def fit_features(rows: list[np.ndarray], y: np.ndarray, sizes: tuple[int, int], smoothing: float = 1.0, doubt: float = 16.0, power: float = 2.0, l2: float = 3e-3, rate: float = 0.25, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on presences scaled by log-count ratios -> (features, weight of each one's presence, bias).

    rows: each text's distinct features.  ``sizes``: the labelled rows of class 0 and 1 that the
    sample stands for; rows weigh as if the classes had these sizes.
    """
    prior = float(np.log((sizes[1] + 0.5) / (sizes[0] + 0.5)))
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int32), np.zeros(0), prior
    count = np.array([len(x) for x in rows])
    first = np.concatenate([[0], np.cumsum(count)])
    cols = np.concatenate(rows).astype(np.int32, copy=False)
    # rows in slices of about a million presences: temporaries are as large as a slice
    cuts = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, first[-1], 1 << 20)), [len(y)]])).tolist()
    slices = [(lo, hi, cols[first[lo] : first[hi]]) for lo, hi in zip(cuts, cuts[1:]) if first[lo] < first[hi]]
    add = lambda values, size: sum(np.bincount(c, np.repeat(values[lo:hi], count[lo:hi]), size) for lo, hi, c in slices)
    both, pos = add(np.ones(len(y)), len(ORDERS) << BITS), add((y == 1).astype(float), len(ORDERS) << BITS)
    features = np.flatnonzero(both).astype(np.int32)
    pos, neg = pos[features], (both - pos)[features]
    place = np.zeros(len(ORDERS) << BITS, np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    for _, _, c in slices:
        c[:] = place[c]
    n1 = int(y.sum())
    n0 = len(y) - n1
    ratio = np.log(((pos + smoothing) / (n1 + 2 * smoothing)) / ((neg + smoothing) / (n0 + 2 * smoothing)))
    z2 = ratio**2 / (1 / (pos + smoothing) + 1 / (neg + smoothing))
    ratio *= (z2 / (z2 + doubt)) ** power
    weight = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    weight = weight / weight.sum()
    w, b = np.zeros(len(features)), prior
    g2, gb2 = np.full(len(features), 1e-10), 1e-8
    eta = np.zeros(len(y))
    for _ in range(steps):  # full-batch gradient with per-weight step sizes
        scaled = ratio * w
        for lo, hi, c in slices:
            some = count[lo:hi] > 0
            eta[lo:hi][some] = np.add.reduceat(scaled[c], (first[lo:hi] - first[lo])[some])
        err = weight * (1 / (1 + np.exp(-np.clip(eta + b, -40, 40))) - y)
        grad = add(err, len(features)) * ratio + l2 * w / len(features) ** 0.5
        g2 += grad * grad
        gb2 += err.sum() ** 2
        w -= rate * grad / np.sqrt(g2)
        b -= rate * err.sum() / np.sqrt(gb2)
    return features, w * ratio, float(b)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The model's probability that a text is toxic, as a double column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        presence = _Presence()
        for batch in batches:
            out = np.full(len(batch), model.bias)
            for i, t in enumerate(batch):
                out[i] += model.weights[presence.of(char_codes([t.as_py()])[0])].sum(dtype=np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return score(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 1500, **options) -> ToxicityModel:
    """Fits on at most ``per_class`` labelled texts of each class (see labelled_sample).

    The sample is bounded, so one executor task fits the model and the driver gets the weights of the
    n-grams that the sample has, at most one for each bucket.
    """
    texts, sizes = labelled_sample(docs, labels, "toxic", per_class, [0, 1], train)
    stands_for = (sizes.get(0, 0), sizes.get(1, 0))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, label = [], [], []
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows += gram_sets(part.column("text").to_pylist())
                label += part.column("label").to_pylist()
                ids += part.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # whatever order the rows came in
        features, weights, bias = fit_features([rows[i] for i in order], np.array([label[i] for i in order], int), stands_for, **options)
        yield pa.RecordBatch.from_pylist([{"features": features.tobytes(), "weights": weights.astype(np.float32).tobytes(), "bias": bias, "fitted_on": len(rows)}])

    got = texts.select("doc_id", "label", "text").repartition(1).mapInArrow(fit, "features binary, weights binary, bias double, fitted_on long").first()
    dense = np.zeros(len(ORDERS) << BITS, np.float32)
    if got is None:  # no texts, no task
        return ToxicityModel(dense, fit_features([], np.zeros(0, int), stands_for)[2], {"labelled": sum(stands_for), "fitted_on": 0, "features": 0})
    dense[np.frombuffer(got["features"], np.int32)] = np.frombuffer(got["weights"], np.float32)
    return ToxicityModel(dense, got["bias"], {"labelled": sum(stands_for), "fitted_on": got["fitted_on"], "features": len(got["features"]) // 4})


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 where score >= threshold), for every row of docs."""
    scored = docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the threshold, columns unchanged."""
    return docs.where(toxicity_score(F.col("text"), model) < threshold)
