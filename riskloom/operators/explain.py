"""Score explanations (X1, X3, X4) as long tables (id, feature, phi) keyed by client id.

``tree_attribution`` computes interventional Shapley values of a Spark gradient-boosted tree model
against a background table: the node structure is read from the fitted model (small: trees x nodes). For one (row, background) pair and one leaf, only the features
on which the two rows go different ways on the leaf's path matter; with a = features that must come
from the row and b = features that must come from the background, each of the a features gets
v (a-1)! b! / (a+b)! and each of the b features -v a! (b-1)! / (a+b)!. Margin values are put on the
probability scale per pair by (p(x) - p(z)) / (F(x) - F(z)), which keeps base + sum(phi) = p(x).

The background never leaves the executors. A leaf knows a background row only by the bits that tell which of its path's features the row passes, so rows
are grouped by (leaf, bits): at most 2 ** depth groups a leaf, however many rows. The pair's scale also depends on the background row's margin; as a function of that margin it is
smooth, so a group keeps its rows' margins as weights at Chebyshev nodes over the background's range, as many as bring the
interpolation to 1e-12. Cost and memory of the rows to explain depend on the model alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.sampling import sample_n

CHUNK_ROWS = 2048


def attribution_base_value(scores: DataFrame, prob: str = "p", n: int | None = None, id_col: str = "SK_ID_CURR",
                           seed: int = 0) -> DataFrame:
    """Mean probability over the background sample (all rows when ``n`` is None)."""
    bg = sample_n(scores, n, id_col, seed) if n else scores
    return bg.agg(F.avg(prob).alias("base_value"), F.count(F.lit(1)).alias("n_background"))


def global_attribution(long_df: DataFrame, feature: str = "feature", phi: str = "phi") -> DataFrame:
    """Mean absolute attribution per feature."""
    return long_df.groupBy(feature).agg(F.avg(F.abs(F.col(phi))).alias("mean_abs_phi"),
                                        F.count(F.col(phi)).alias("n"))


def linear_attribution(values_long: DataFrame, id_col: str = "SK_ID_CURR", feature: str = "feature",
                       value: str = "value") -> DataFrame:
    """Exact Shapley values of the standardised linear scorer sum_f (x_f - mean_f) / std_f.

    For a linear model the interventional values are w_f (x_f - E x_f); with w_f = 1 / std_f they need
    only per-feature moments (one row per feature). Used as a reference attribution table
    with a closed form, and to check tree attributions' table plumbing.
    """
    stats = values_long.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    j = values_long.join(stats, feature, "inner")  # one row per feature
    phi = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    return j.select(id_col, feature, phi.alias("phi")).where(F.col("phi").isNotNull())


# ---- tree attributions ----------------------------------------------------------------------------


def _tree_tables(model):
    """(leaves, weights) from a fitted GBTClassificationModel: for each tree, each leaf's value and its
    path as per-feature intervals (lo, hi]."""
    trees = model.trees
    weights = list(model.treeWeights)
    out = []
    for t, tree in enumerate(trees):
        # node structure from the fitted model (driver-side metadata: trees x nodes)
        root = tree._call_java("rootNode")
        leaves: list[tuple[float, dict[int, tuple[float, float]]]] = []
        stack = [(root, {})]
        while stack:
            node, bounds = stack.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                leaves.append((float(node.prediction()), bounds))
                continue
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("category splits are not handled; train on numbers")
            j = int(split.featureIndex())
            thr = float(split.threshold())
            lo, hi = bounds.get(j, (-math.inf, math.inf))
            left = dict(bounds)
            left[j] = (lo, min(hi, thr))
            right = dict(bounds)
            right[j] = (max(lo, thr), hi)
            stack.append((node.leftChild(), left))
            stack.append((node.rightChild(), right))
        out.append(leaves)
    return out, weights


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value and its path: the interval (low, high] of each feature on it."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Which features of the path each row passes, one bit each."""
        passed = (x[:, self.features] > self.low) & (x[:, self.features] <= self.high)
        return passed.astype(np.int64) @ (1 << np.arange(len(self.features), dtype=np.int64))


def _leaves(trees, weights) -> list[Leaf]:
    out = []
    for leaves, w in zip(trees, weights, strict=True):
        for v, bounds in leaves:
            low, high = (np.array([b[k] for b in bounds.values()], float) for k in (0, 1))
            out.append(Leaf(w * v, np.array(list(bounds), np.int64), low, high))
    return out


def _margins(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    f = np.zeros(len(x))
    for leaf in leaves:
        f += leaf.value * (leaf.bits(x) == (1 << len(leaf.features)) - 1)
    return f


def _probability(margin: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(margin)


def _slopes(fx: np.ndarray, fz: np.ndarray) -> np.ndarray:
    """(p(x) - p(z)) / (F(x) - F(z)) for all pairs, the derivative where both are equal."""
    a, b = fx[:, None], fz[None, :]
    t = a - b
    far = np.abs(t) > 1e-2
    series = 1 + t * t / 6 * (1 + t * t / 20 * (1 + t * t / 42))  # sinh(t) / t
    with np.errstate(over="ignore"):
        near = series / (2 * np.cosh(a) * np.cosh(b))
    return np.where(far, (np.tanh(a) - np.tanh(b)) / (2 * np.where(far, t, 1.0)), near)


def _nodes(low: float, high: float) -> np.ndarray:
    """Chebyshev nodes over the margins' range, enough for 1e-12: the logistic curve's poles lie at a distance of pi / 2 from the real line."""
    half = max((high - low) / 2, 1e-3)
    s = math.pi / 2 / half
    k = math.ceil(math.log(1e13) / math.log(s + math.sqrt(s * s + 1))) + 3
    return (low + high) / 2 + half * np.cos(np.pi * np.arange(k) / (k - 1))


def _basis(z: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Weights of each value at the nodes (barycentric form); rows sum to one."""
    w = np.where(np.arange(len(nodes)) % 2, -1.0, 1.0)
    w[[0, -1]] /= 2
    gap = z[:, None] - nodes[None, :]
    hit = gap == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        share = w / np.where(hit, 1.0, gap)
        share /= share.sum(axis=1, keepdims=True)
    return np.where(hit.any(axis=1, keepdims=True), hit.astype(float), share)


def _complete(batch: pa.RecordBatch, what: str) -> np.ndarray:
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
    if np.isnan(x).any():
        raise ValueError(f"{what} has missing values")
    return x


def _ranges(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            f = _margins(_complete(batch, "the background"), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (f.min(), f.max(), len(f), _probability(f).sum())], ["low", "high", "n", "p"])


def _grouped(batches: Iterator[pa.RecordBatch], shared, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(leaf, bits, weights): a task's background rows by what each leaf knows of them."""
    leaves, held = shared.value, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _complete(batch, "the background")
        basis = _basis(_margins(x, leaves), nodes)
        for k, leaf in enumerate(leaves):
            found, at = np.unique(leaf.bits(x), return_inverse=True)
            sums = np.zeros((len(found), len(nodes)))
            np.add.at(sums, at, basis)
            for m, v in zip(found.tolist(), sums, strict=True):
                held[k, m] = held[k, m] + v if (k, m) in held else v
    yield from _rows_of(held)


def _rows_of(held: dict) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for low in range(0, len(keys), 1024):
        part = keys[low : low + 1024]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([m for _, m in part], pa.int64()),
                                          pa.array([held[k].tolist() for k in part], pa.list_(pa.float64()))], ["leaf", "bits", "weights"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for k, m, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = v.values.to_numpy()
            held[k, m] = held[k, m] + x if (k, m) in held else x
    yield from _rows_of(held)


@dataclass(frozen=True)
class Background:
    """A background as the leaves know it: number of rows, mean probability, nodes, and per leaf the bits that occur with their weights."""

    n: int
    base: float
    nodes: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray]]


def compress_background(leaves: Sequence[Leaf], background: DataFrame) -> Background:
    """Two passes over the background (double columns in the features' order): the range of margins, then the groups of each leaf, added up by leaf."""
    spark = background.sparkSession
    shared = spark.sparkContext.broadcast(list(leaves))
    told = background.mapInArrow(partial(_ranges, shared=shared), "low double, high double, n long, p double").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    if not told["n"]:
        raise ValueError("the background is empty")
    nodes, schema = _nodes(told["low"], told["high"]), "leaf int, bits long, weights array<double>"
    found = background.mapInArrow(partial(_grouped, shared=shared, nodes=nodes), schema).repartition("leaf").mapInArrow(_added, schema)
    groups: list[tuple[list, list]] = [([], []) for _ in leaves]
    for r in found.toLocalIterator():  # the model's size
        groups[r["leaf"]][0].append(r["bits"])
        groups[r["leaf"]][1].append(r["weights"])
    return Background(int(told["n"]), told["p"] / told["n"], nodes, [(np.array(m, np.int64), np.array(w).reshape(len(m), len(nodes))) for m, w in groups])


def _shares(row_bits: int, leaf: Leaf, groups: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(path features x nodes): what a row with these bits gets from the leaf, to be multiplied by the slopes at the nodes."""
    bits, weights = groups
    d = len(leaf.features)
    whole = (1 << d) - 1
    met = (row_bits | bits) == whole
    bits, weights = bits[met], weights[met]
    mine, theirs = row_bits & ~bits & whole, ~row_bits & bits & whole
    a, b = np.bitwise_count(mine).astype(int), np.bitwise_count(theirs).astype(int)
    fact = np.array([math.factorial(k) for k in range(d + 1)], float)
    up = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0)
    down = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0)
    of = [np.where(mine >> k & 1, up, 0.0) - np.where(theirs >> k & 1, down, 0.0) for k in range(d)]
    return leaf.value * np.array(of).reshape(d, len(bits)) @ weights


def _attributions(x: np.ndarray, leaves: Sequence[Leaf], background: Background, memo: dict) -> np.ndarray:
    """phi (rows x features) in probability units."""
    phi = np.zeros(x.shape)
    slopes = _slopes(_margins(x, leaves), background.nodes) / background.n
    for k, leaf in enumerate(leaves):
        if not len(leaf.features):
            continue
        found, at = np.unique(leaf.bits(x), return_inverse=True)
        for i, m in enumerate(found.tolist()):
            if (k, m) not in memo:
                memo[k, m] = _shares(m, leaf, background.groups[k])
            rows = np.flatnonzero(at == i)
            phi[np.ix_(rows, leaf.features)] += slopes[rows] @ memo[k, m].T
    return phi


def tree_attribution(model, rows: DataFrame, background: DataFrame, features: Sequence[str],
                     id_col: str = "SK_ID_CURR", names: Sequence[str] | None = None) -> DataFrame:
    """Long table (id, feature, phi) for a fitted ``GBTClassificationModel`` on ``features``.

    ``background`` is the table the caller draws (the source takes 10,000 rows), of any size: it is read twice where it lies, and only its groups by
    leaf, of the model's size, are sent to the tasks. Rows
    and background must be complete: impute as the model does first, a missing value is an error. ``names`` replaces the feature
    names in the result.
    """
    feats = list(features)
    shown = np.array(list(names) if names is not None else feats, dtype=object)
    values = [F.col(f"`{f}`").cast("double").alias(f"c{i}") for i, f in enumerate(feats)]
    leaves = _leaves(*_tree_tables(model))
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((leaves, compress_background(leaves, background.select(*values))))

    def run(batches):
        (own, known), memo = shared.value, {}
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK_ROWS):
                part = pdf.iloc[i : i + CHUNK_ROWS]
                x = part.iloc[:, 1:].to_numpy(dtype=float)
                if np.isnan(x).any():
                    raise ValueError("a row to explain has missing values")
                phi = _attributions(x, own, known, memo)
                yield pd.DataFrame({id_col: np.repeat(part[id_col].to_numpy(), len(feats)), "feature": np.tile(shown, len(part)), "phi": phi.reshape(-1)})

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("feature", T.StringType()),
                           T.StructField("phi", T.DoubleType())])
    return rows.select(F.col(id_col), *values).mapInPandas(run, schema)


def additivity_check(long_df: DataFrame, scores: DataFrame, base_value: float, id_col: str = "SK_ID_CURR",
                     prob: str = "p") -> DataFrame:
    """Per client: base + sum(phi) - p (should be ~0)."""
    s = long_df.groupBy(id_col).agg(F.sum("phi").alias("sum_phi"))
    return s.join(scores.select(id_col, prob), id_col).select(
        id_col, (F.lit(base_value) + F.col("sum_phi") - F.col(prob)).alias("gap"))


__all__ = ["attribution_base_value", "compress_background", "global_attribution", "linear_attribution", "tree_attribution",
           "additivity_check"]
