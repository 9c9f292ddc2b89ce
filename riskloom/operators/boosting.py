"""Boosted trees of many settings and folds, grown side by side on one table of bin numbers (M3).

The trees are those of Spark's ``GBTClassifier`` where every row and feature takes part in every tree: log loss on labels -1 and 1, splits by the gain in
variance, a first tree of weight 1 and the step size for the others. Every bound between two bins is a candidate (Spark takes its candidates from
10,000 sampled rows). One pass over the table makes a level of the current trees of all models: a task sends the weight and the residuals' sum of each bin for
every open node, the group of a node adds these up and picks the split, and the driver gets one row per node. Trees that settings have in common are
grown once: a tree depends on the depth, from the third on also on the step size, and not on the number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that a task works on at a time.
CHUNK_ROWS = 65_536
# Features are counted together while their bins have no more combinations than this.
JOINT = 1024
# Bins of open nodes that a pass sums up, two doubles each; a level with more takes several passes.
CELLS = 1 << 23
# A gain that is a smaller share of the node's squared residuals is rounding.
NOISE = 1e-12
# Trees are kept as full heaps of nodes.
MAX_DEPTH = 10


class Setting(NamedTuple):
    depth: int
    step: float
    trees: int


class Tree:
    """Nodes by heap number: the feature (-1: a leaf), the code above which a row goes right, and the value."""

    def __init__(self, depth: int):
        self.feature = np.full(2**depth - 1, -1)
        self.code = np.zeros(2**depth - 1, dtype=int)
        self.value = np.zeros(2 ** (depth + 1) - 1)

    def nodes(self, columns: np.ndarray) -> np.ndarray:
        """The node of each row, from the codes of each feature."""
        at = np.zeros(columns.shape[1], dtype=np.int16)
        for i in np.flatnonzero(self.feature >= 0):  # parents first
            here = at == i
            at += here * np.int16(i + 1)
            at += here & (columns[self.feature[i]] > self.code[i])
        return at


def _key(setting: Setting, t: int, fold: int) -> tuple:
    return t, setting.depth, setting.step if t > 1 else 0.0, fold


def _margin(columns: np.ndarray, trees: Sequence[Tree], step: float) -> np.ndarray:
    out = np.zeros(columns.shape[1])
    for t, tree in enumerate(trees):
        out += (step if t else 1.0) * tree.value[tree.nodes(columns)]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], p: int, dtype: str) -> Iterator[tuple]:
    """(codes of each feature, label, fold, weight) of some batches at a time."""
    lot: list[pa.RecordBatch] = []
    for batch in batches:
        lot += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in lot) >= CHUNK_ROWS:
            yield _chunk(lot, p, dtype)
            lot = []
    if lot:
        yield _chunk(lot, p, dtype)


def _chunk(lot: Sequence[pa.RecordBatch], p: int, dtype: str) -> tuple:
    table = pa.Table.from_batches(lot)
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype=dtype).reshape(-1, p)
    return np.ascontiguousarray(codes.T), *(table[c].to_numpy() for c in ("label", "fold", "weight"))


def _joint(sizes: Sequence[int]) -> list[list[int]]:
    """Features that are counted together; one with a single bin has no split."""
    out: list[list[int]] = []
    cells = JOINT + 1
    for i in sorted((i for i, s in enumerate(sizes) if s > 1), key=lambda i: sizes[i]):
        if cells * sizes[i] > JOINT:
            out.append([])
            cells = 1
        out[-1].append(i)
        cells *= sizes[i]
    return out


def _sums(batches: Iterator[pa.RecordBatch], jobs: Sequence[tuple], sizes: Sequence[int], dtype: str, weighted: bool) -> Iterator[pa.RecordBatch]:
    """For each job (previous trees, step, tree, fold, open nodes): one row per node with weights and residuals' sums by bin and the squares' sum."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    groups = _joint(sizes)
    found = [np.zeros((2, len(nodes), start[-1])) for *_, nodes in jobs]
    squares = [np.zeros(len(nodes)) for *_, nodes in jobs]
    for columns, label, fold, weight in _chunks(batches, len(sizes), dtype):
        y = 2 * label - 1
        joint = []
        for group in groups:
            j = np.zeros(len(y), dtype=np.int64)
            for i in group:
                j = j * sizes[i] + columns[i]
            joint.append(j)
        index = np.empty(len(y), dtype=np.int64)
        for (previous, step, tree, held, nodes), sums, square in zip(jobs, found, squares, strict=True):
            k = len(nodes)
            slots = np.full(len(tree.value), k)  # k: rows of the held fold and of other nodes
            slots[nodes] = range(k)
            slot = np.where(fold == held, k, slots[tree.nodes(columns)])
            residual = 4 * y / (1 + np.exp(2 * y * _margin(columns, previous, step))) if previous else y
            sent = (weight if weighted else None, weight * residual if weighted else residual)
            square += np.bincount(slot, sent[1] * residual, k + 1)[:k]
            for group, j in zip(groups, joint, strict=True):
                shape = [sizes[i] for i in group]
                cells = int(np.prod(shape))
                np.multiply(slot, cells, out=index)
                index += j
                for part, w in zip(sums, sent, strict=True):
                    counted = np.bincount(index, w, (k + 1) * cells)[: k * cells].reshape(k, *shape)
                    for a, i in enumerate(group, 1):
                        part[:, start[i] : start[i + 1]] += counted.sum(axis=tuple(b for b in range(1, len(group) + 1) if b != a)) if len(group) > 1 else counted
    task = TaskContext.get().partitionId()
    for job, ((*_, nodes), sums, square) in enumerate(zip(jobs, found, squares, strict=True)):
        rows = [(job, int(n), task, sums[:, j].tobytes(), float(square[j])) for j, n in enumerate(nodes) if sums[0, j].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64()), strict=True)],
                                             ["job", "node", "task", "sums", "square"])


def _best(sums: np.ndarray, square: float, sizes: Sequence[int]) -> tuple:
    """(feature or -1, code, weight, sum, weight and sum of the left side) of the split with the largest gain; ties: the first feature, the smallest code."""
    wide = np.zeros((2, len(sizes), max(sizes)))
    wide[:, np.arange(max(sizes)) < np.array(sizes)[:, None]] = sums
    left = np.cumsum(wide, axis=2)
    all_ = left[:, :, -1:]
    right = all_ - left
    some = int(np.argmax(sizes))  # a feature with one bin is not counted
    n, s = (float(v) for v in all_[:, some, 0])
    there = np.cumsum(wide[0] > 0, axis=1)
    both = (there > 0) & (there < there[:, -1:])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(both, left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - s * s / n, -np.inf)
    f, c = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f) if gain[f, c] > NOISE * square else -1), int(c), n, s, float(left[0, f, c]), float(left[1, f, c])


def _split(found: pa.Table, sizes: Sequence[int]) -> pa.Table:
    found = found.sort_by("task")  # the same sums whatever the order of arrival
    sums = sum(np.frombuffer(b).reshape(2, -1) for b in found["sums"].to_pylist())
    best = _best(sums, sum(found["square"].to_pylist()), sizes)
    names = ["job", "node", "feature", "code", "n", "s", "left_n", "left_s"]
    return pa.table([pa.array([v]) for v in (found["job"][0].as_py(), found["node"][0].as_py(), *best)], names=names).cast(
        pa.schema([(c, pa.int32() if c in names[:4] else pa.float64()) for c in names]))


def grow(data: DataFrame, sizes: Sequence[int], dtype: str, settings: Sequence[Setting], folds: int, weighted: bool = False) -> dict[tuple, Tree]:
    """The trees of all settings for each fold (trained on the other folds), from (label, fold, weight, codes): labels 0 and 1, codes one number of type
    ``dtype`` per feature, below the feature's size. ``margins`` reads the result."""
    trees: dict[tuple, Tree] = {}
    tasks = max(1, 2 * data.sparkSession.sparkContext.defaultParallelism)  # each sends its sums once
    rows = data.coalesce(tasks)

    def split(found: pa.Table) -> pa.Table:
        return _split(found, sizes)

    for t in range(max(s.trees for s in settings)):
        now = {_key(s, t, f): s for s in settings if s.trees > t for f in range(folds)}
        trees |= {key: Tree(s.depth) for key, s in now.items()}
        todo = [(key, 0) for key in now]
        while todo:
            grown = []
            width = max(1, CELLS // sum(sizes))
            for lot in (todo[i : i + width] for i in range(0, len(todo), width)):
                keys = list(dict.fromkeys(key for key, _ in lot))
                jobs = [([trees[_key(now[key], u, key[-1])] for u in range(t)], now[key].step, trees[key], key[-1], [n for k, n in lot if k == key]) for key in keys]
                sent = rows.mapInArrow(partial(_sums, jobs=jobs, sizes=sizes, dtype=dtype, weighted=weighted), "job int, node int, task int, sums binary, square double")
                splits = sent.groupBy("job", "node").applyInArrow(split, "job int, node int, feature int, code int, n double, s double, left_n double, left_s double")
                for r in splits.collect():
                    tree, n = trees[keys[r["job"]]], r["node"]
                    tree.value[n] = r["s"] / r["n"]
                    if r["feature"] < 0:
                        continue
                    tree.feature[n], tree.code[n] = r["feature"], r["code"]
                    tree.value[2 * n + 1] = r["left_s"] / r["left_n"]
                    tree.value[2 * n + 2] = (r["s"] - r["left_s"]) / (r["n"] - r["left_n"])
                    grown += [(keys[r["job"]], c) for c in (2 * n + 1, 2 * n + 2) if c < len(tree.feature)]
            todo = sorted(grown)
    return trees


def margins(data: DataFrame, trees: dict[tuple, Tree], sizes: Sequence[int], dtype: str, settings: Sequence[Setting]) -> DataFrame:
    """(label, fold, m0, m1, ...): each row's margin under each setting, by the trees of its own fold."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, label, fold, _ in _chunks(batches, len(sizes), dtype):
            out = np.zeros((len(settings), len(label)))
            for f in np.unique(fold):
                own = columns[:, fold == f]
                for i, s in enumerate(settings):
                    out[i, fold == f] = _margin(own, [trees[_key(s, t, int(f))] for t in range(s.trees)], s.step)
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(fold), *map(pa.array, out)], ["label", "fold", *[f"m{i}" for i in range(len(settings))]])

    return data.mapInArrow(scored, f"label double, fold int, {', '.join(f'm{i} double' for i in range(len(settings)))}")


def rows_of(data: DataFrame, label: str, weight: str | None) -> DataFrame:
    """The columns that ``grow`` reads."""
    return data.select(F.col(label).alias("label"), "fold", (F.col(weight) if weight else F.lit(1.0)).alias("weight"), "codes")
