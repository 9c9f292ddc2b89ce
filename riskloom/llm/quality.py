"""Quality classifier: naive Bayes support vectors (NBSVM).

Indicators of n-grams (byte 3-grams, and 3-grams of word shapes with a mark on words that repeat their predecessor) are scaled by
the class log-count ratio, each text's vector is brought to unit length, and a linear model with hinge loss is fit by dual coordinate descent.
Margins become probabilities by a logistic curve fit on labelled rows that the descent did not see.

The fit takes at most ``SAMPLE`` labelled rows, by hash of the id; the features of these go to the driver (about 25 MB). Scoring is
one pass over whole texts in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fold, gather, labelled_sample, lean, text_or_empty
from riskloom.llm.textbytes import SCORED_BYTES, RangeHash, bucket, row_groups, runs, string_buffers, unique_pairs

SAMPLE = 8000
BITS = 18
PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_UPPER, _LOWER, _DIGIT = np.zeros((3, 256), bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_END = np.full(256, 2, np.int64)  # what a word ends with: a letter or digit, a mark of prose, another sign
_END[48:58] = _END[65:91] = _END[97:123] = _END[128:] = 0
_END[[33, 34, 39, 41, 44, 46, 58, 59, 63]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of the n-grams that occur."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(data):
        return row, row
    wide = data.astype(np.int64)
    grams = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    whole = row[:-2] == row[2:]
    found = [(row[:-2][whole], bucket(grams[whole], 1, BITS))]
    start, end = runs(~_WHITE[data], offsets[:-1])
    if len(start):
        own = row[start]
        size = end - start
        count = lambda mask: np.diff(np.append(0, np.cumsum(mask[data]))[np.stack([start, end])], axis=0)[0]
        upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
        code = np.minimum(4, np.log2(size).astype(np.int64))
        for flag in (upper > 1, (upper > 0) & (lower == 0), _UPPER[data[start]], digit > 0, lower == 0):
            code = code * 2 + flag
        code = code * 3 + _END[data[end - 1]]
        h = RangeHash(data)(start, end)
        again = np.append(False, (h[1:] == h[:-1]) & (own[1:] == own[:-1]))
        code = code * 2 + again
        found.append((own, bucket(code, 2, BITS)))
        for n in (2, 3):
            same = own[: 1 - n] == own[n - 1 :]
            gram = sum(code[k : len(code) - n + 1 + k] << (12 * k) for k in range(n))
            found.append((own[: 1 - n][same], bucket(gram[same], 1 + n, BITS)))
    return unique_pairs(np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found]), BITS)


@dataclass
class Model:
    """Weights by feature, a bias, and the logistic curve of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    fitted: bool = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, found = features(data, offsets)
        n = len(offsets) - 1
        value = np.bincount(rows, self.weights[0][found], n)
        norm = np.sqrt(np.bincount(rows, self.weights[1][found], n))
        margin = value / np.maximum(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def log_count_ratio(rows: np.ndarray, found: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature among the indicators of class 1 over that of class 0."""
    one = (y == 1)[rows]
    p, q = (alpha + np.bincount(found[m], minlength=1 << BITS) for m in (one, ~one))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int,
                            cost: np.ndarray, epochs: int = 15, seed: int = 1, among: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss over the rows ``among`` (all); ``cost`` bounds each row's dual variable."""
    n = len(y)
    among = np.arange(n) if among is None else among
    cut = np.searchsorted(rows, np.arange(n + 1))
    w, bias, dual = np.zeros(width), 0.0, np.zeros(n)
    square = np.bincount(rows, values**2, n) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in among[rng.permutation(len(among))]:
            c, v = cols[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]]
            slope = y[i] * (w[c] @ v + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[c] += step * v
                bias += step
                most = max(most, abs(new - dual[i]))
                dual[i] = new
        if most < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of P(1 | margin) by Newton's method, with Platt's smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.stack([margin, np.ones(len(y))])
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        grad = x @ (p - target)
        hess = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        at -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
    return max(float(at[0]), 1e-3), float(at[1])


def fit_rows(rows: np.ndarray, found: np.ndarray, y: np.ndarray, cost: float = 1.0) -> Model:
    """Model from the (row, feature) pairs of labelled rows; one row in five is kept for the curve."""
    n = len(y)
    weights = np.zeros((2, 1 << BITS))
    if n < 20 or len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (n + 2)
        return Model(weights, 0.0, 1.0, float(np.log(p / (1 - p))), False)
    fit = np.arange(n) % 5 != 4
    k = fit[rows]
    seen = found[k]
    ratio = log_count_ratio(rows[k], seen, y)
    often = np.bincount(seen, minlength=1 << BITS) >= 3
    del k, seen  # the pairs fill the driver's memory: no copy of them is kept longer than it is used
    ratio[~often] = 0
    keep = ratio[found] != 0
    rows, found = rows[keep], found[keep]
    del keep
    values = ratio[found]
    values /= np.maximum(np.sqrt(np.bincount(rows, values**2, n)), 1e-9)[rows]
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    w, bias = dual_coordinate_descent(rows, found, values, sign, 1 << BITS, cost * 0.5 / share, among=np.flatnonzero(fit))
    margin = np.bincount(rows, w[found] * values, n) + bias
    slope, shift = logistic_curve(margin[~fit], y[~fit])
    weights[0], weights[1] = w * ratio, ratio**2
    return Model(weights.astype(np.float32), bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> Model:
    """Model learnt from labelled rows outside the held-out fold."""
    rows = labelled_sample(labels, docs, label, fold(id_column, PARTS) == HELD_OUT, sample, id_column, text_column)
    return fit_rows(*gather(rows, features))


@lean
def _scores(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    for column in texts:
        data, offsets = string_buffers(column)
        parts = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_groups(offsets, SCORED_BYTES)]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())


def score_column(model: Model, text_column: str = "text") -> Column:
    """The score of each whole text, 0 to 1."""
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _scores(texts, model)

    return F.arrow_udf(scores, "double")(text_or_empty(text_column))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= threshold).

    A null text is empty; an empty text gets the score of a text without features. Without labels, or with one class only, every score is
    the smoothed share of class 1. Repeated rows are scored each; null ids stay null. Other columns are not read.
    """
    model = fit(docs, labels, id_column, text_column, sample=sample)
    return (docs.select(F.col(id_column).alias("doc_id"), fold(id_column, PARTS).eqNullSafe(F.lit(HELD_OUT)).alias("held_out"),
                        score_column(model, text_column).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns unchanged; all rows if labels of both classes are wanting."""
    model = fit(docs, labels, id_column, text_column, sample=sample)
    return docs.where(score_column(model, text_column) >= threshold) if model.fitted else docs
