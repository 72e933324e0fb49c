"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - eta) with ordered thresholds and one eta,
a weighted sum of hashed text features that all grades share.  Features of a
text: the shares of its byte trigrams (case kept) in 2**14 hashed buckets, and
hashed word-shape tokens (a word that repeats the one before, repeats within the
text, shares of capitals, digits and symbols, in steps).

Grades are whole numbers in order of merit, as raters give them.  Where labels are two
marks (quality, toxic), graded_labels() makes them one scale of three: what is poor is
worst, what is sound but toxic is between, what is sound and civil is best.

A text of no words has the features of an empty one, and so has a null one.  Extra columns
are ignored; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .text_arrays import blocks, gram_buckets, word_hashes

GRAM_BITS = 14
#: Shape features: five shares, each on a scale of STEPS hat functions.
STEPS = 8
SHAPES = 5
WIDTH = (1 << GRAM_BITS) + SHAPES * STEPS
#: Factor on trigram shares, which are small next to the shape features; and how many trigrams a
#: text counts as having besides its own, so that a few words tell little.
GRAM_SCALE = 10.0
GRAM_PRIOR = 64

_CLASS = np.zeros((3, 256), np.float32)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


@dataclass
class OrdinalModel:
    weights: np.ndarray  #: WIDTH
    thresholds: np.ndarray  #: increasing, one fewer than grades
    stats: dict = field(default_factory=dict)

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _window_repeats(words: np.ndarray, size: int = 64) -> float:
    """The mean share of repeats in windows of ``size`` words, the same scale for short and long texts.  The
    last window ends with the text and weighs by the words that no other window has."""
    n = len(words)
    whole, rest = divmod(n, size)
    if not whole:
        s = np.sort(words)
        return float((s[1:] == s[:-1]).mean())
    s = np.sort(words[: whole * size].reshape(-1, size), axis=1)
    total = (s[:, 1:] == s[:, :-1]).mean() * whole * size
    if rest:
        last = np.sort(words[n - size :])
        total += (last[1:] == last[:-1]).mean() * rest
    return float(total / n)


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x (SHAPES * STEPS)."""
    rows = len(offsets) - 1
    length = np.maximum(np.diff(offsets), 1)
    shares = np.zeros((rows, SHAPES))
    for k in range(3):
        shares[:, k] = _row_sums(_CLASS[k][data], offsets) / length
    words, firsts = word_hashes(data, offsets, lower=False)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    inner = firsts[:-1][firsts[:-1] < firsts[1:]]
    same[inner] = 0
    count = np.diff(firsts)
    shares[:, 3] = _row_sums(same, firsts) / np.maximum(count, 1)
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        if b > a + 1:
            shares[i, 4] = _window_repeats(words[a:b])
    place = np.minimum(np.sqrt(shares), 1) * (STEPS - 1)
    low = np.minimum(place.astype(int), STEPS - 2)
    out = np.zeros((rows, SHAPES, STEPS))
    r, s = np.indices(place.shape)
    out[r, s, low] = 1 - (place - low)
    out[r, s, low + 1] = place - low
    return out.reshape(rows, -1)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets at each place, which of them lie inside one row, and what each row's counts are divided by."""
    found = gram_buckets(data, 3, GRAM_BITS)
    inside = np.ones(len(found), bool)
    for back in (1, 2):
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(found))]] = False
    return found, inside, np.maximum(np.diff(offsets) - 2, 0) + GRAM_PRIOR


def linear_predictor(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    eta = shape_features(data, offsets) @ weights[1 << GRAM_BITS :]
    found, inside, count = _trigrams(data, offsets)
    if len(found):
        value = np.zeros(len(data))
        value[: len(found)] = weights[: 1 << GRAM_BITS][found] * inside
        eta += GRAM_SCALE * _row_sums(value, offsets) / count
    return eta


def text_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text's features."""
    offsets = np.array([0, len(data)])
    shape = shape_features(data, offsets)[0]
    found, inside, count = _trigrams(data, offsets)
    index, n = np.unique(found[inside], return_counts=True)
    on = np.flatnonzero(shape)
    return np.concatenate([index.astype(np.int32), (on + (1 << GRAM_BITS)).astype(np.int32)]), np.concatenate([GRAM_SCALE * n / count[0], shape[on]]).astype(np.float32)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, sizes: list[int], l2: float = 1e-5, steps: int = 150) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model.  ``sizes``: labelled rows of each grade, which weigh the sample."""
    k = len(sizes)
    share = np.cumsum(np.maximum(sizes, 0.5))[:-1] / np.sum(np.maximum(sizes, 0.5))
    theta = np.log(share / (1 - share))
    if len(set(grade.tolist())) < 2:
        return OrdinalModel(np.zeros(WIDTH), theta, {"fitted_on": len(rows)})
    cols = np.concatenate([r[0] for r in rows])
    vals = np.concatenate([r[1] for r in rows]).astype(np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    had = np.bincount(grade, minlength=k)
    weight = (np.array(sizes) / np.maximum(had, 1))[grade]
    weight = weight / weight.sum()
    w = np.zeros(WIDTH)
    gap = np.log(np.maximum(np.diff(theta), 1e-3))  # theta_0, then exp(gap) between thresholds: always ordered
    base = theta[0]
    g2, b2, t2 = np.full(WIDTH, 1e-10), 1e-8, np.full(k - 2, 1e-8)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(steps):
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gap))])
        edges = np.concatenate([[-40], theta, [40]])
        eta = np.bincount(doc, vals * w[cols], minlength=len(rows))
        up, low = sig(edges[grade + 1] - eta), sig(edges[grade] - eta)
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up) * (grade < k - 1), low * (1 - low) * (grade > 0)
        d_eta = weight * (du - dl) / p  # of -log p
        d_theta = np.zeros(k - 1)
        np.add.at(d_theta, np.minimum(grade, k - 2), -weight * du / p)
        np.add.at(d_theta, np.maximum(grade - 1, 0), weight * dl / p)
        grad = np.bincount(cols, vals * d_eta[doc], minlength=WIDTH) + l2 * w
        g2 += grad * grad
        w -= 0.3 * grad / np.sqrt(g2)
        db = d_theta.sum()
        b2 += db * db
        base -= 0.3 * db / np.sqrt(b2)
        if k > 2:
            dg = np.exp(gap) * np.cumsum(d_theta[::-1])[::-1][1:]
            t2 += dg * dg
            gap -= 0.1 * dg / np.sqrt(t2)
    theta = base + np.concatenate([[0], np.cumsum(np.exp(gap))])
    return OrdinalModel(w, theta, {"fitted_on": len(rows), "sizes": list(sizes)})


def grade_probabilities(text: Column, model: OrdinalModel) -> Column:
    """struct<expected_grade double, tail array<double>>: tail[k-1] = P(grade >= k)."""

    @F.arrow_udf("expected_grade double, tail array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            eta = np.zeros(len(batch))
            for lo, data, offsets in blocks(batch):
                eta[lo : lo + len(offsets) - 1] = linear_predictor(data, offsets, model.weights)
            tail = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - eta[:, None], -40, 40)))
            ends = np.arange(len(batch) + 1, dtype=np.int32) * tail.shape[1]
            yield pa.StructArray.from_arrays([pa.array(tail.sum(1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tail.ravel()))], ["expected_grade", "tail"])

    return score(text)


def graded_labels(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 sound but abusive, 2 sound.  Null where quality is null; a null toxic counts as 0."""
    return labels.select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).when(F.col("quality") >= 1, 2).alias("grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, per_grade: int = 1500, train: Column | None = None, **options) -> OrdinalModel:
    """Fits on at most ``per_grade`` rated texts of each grade; ratings (doc_id, grade from 0).

    The sample is bounded by ``per_grade``, so one executor task fits the model and the driver gets its weights.
    """
    texts, sizes = labelled_sample(docs, ratings, "grade", per_grade, list(range(grades)), train)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, grade = [], [], []
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows += [text_features(np.frombuffer((t or "").encode(), np.uint8)) for t in part.column("text").to_pylist()]
                grade += part.column("label").to_pylist()
                ids += part.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # whatever order the rows came in
        model = fit_ordinal([rows[i] for i in order], np.array([grade[i] for i in order], int), [sizes.get(k, 0) for k in range(grades)], **options)
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "thresholds": model.thresholds.tobytes(), "fitted_on": len(rows)}])

    # one task holds the bounded sample; the driver gets the weights alone
    got = texts.select("doc_id", "label", "text").repartition(1).mapInArrow(fit, "weights binary, thresholds binary, fitted_on long").first()
    if got is None:  # no texts, no task
        return fit_ordinal([], np.zeros(0, int), [sizes.get(k, 0) for k in range(grades)])
    return OrdinalModel(np.frombuffer(got["weights"]), np.frombuffer(got["thresholds"]), {"fitted_on": got["fitted_on"], "sizes": sizes})


def score_quality(docs: DataFrame, model: OrdinalModel, grade: int = 1, at_least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= 1), ...), keep (P(grade >= ``grade``) >= ``at_least``), for every row."""
    scored = docs.select("doc_id", grade_probabilities(F.col("text"), model).alias("_g"))
    return scored.select("doc_id", "_g.expected_grade", "_g.tail", (F.col("_g.tail")[grade - 1] >= at_least).alias("keep"))


def keep_sound(docs: DataFrame, model: OrdinalModel, grade: int = 1, at_least: float = 0.5) -> DataFrame:
    """The rows of docs with P(grade >= ``grade``) >= ``at_least``, columns unchanged."""
    return docs.where(grade_probabilities(F.col("text"), model)["tail"][grade - 1] >= at_least)
