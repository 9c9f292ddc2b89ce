"""Imputation (I1-I3). A NaN is a missing value like NULL.

Simple strategies are one aggregation for the fill values plus one projection. The iterative strategy
regresses each incomplete column on the others for a few rounds. ``impute_regression`` gathers a round's cross products of all columns in one pass
and solves all regressions by sweeping them on the driver; the rounds' coefficients are applied in the next pass, so a round is one scan and only the result
is written. ``impute_iterative`` is the form in which a column sees those filled before it in the same round: a fit and a
written table for each column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import missing
from riskloom.operators.clean import drop_null_rows, drop_sparse_columns
from riskloom.operators.profile import box_stats
from riskloom.session import written

# Branches of the tree that adds the tasks' cross products up.
BRANCHES = 32
# A column whose part not explained by the others is a smaller share than this is left out of a regression.
COLLINEAR = 1e-9

STRATEGIES = ("mean", "median", "most_frequent", "constant")


def _ref(c: str):
    return F.col(f"`{c}`")


def _value(df: DataFrame, c: str):
    return F.when(~missing(df, c), _ref(c))


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str = "mean", fill_value: float = 0.0) -> dict:
    """Fill value per column. mean: exact average; median: exact, from one histogram of all columns;
    most_frequent: the most common value, smallest on ties (one aggregation over (column, value))."""
    cols = list(columns)
    if strategy == "constant":
        return {c: fill_value for c in cols}
    if strategy == "mean":
        r = df.agg(*[F.avg(_value(df, c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return {c: r[f"c{i}"] for i, c in enumerate(cols)}
    if strategy == "median":
        return {r["column"]: r["median"] for r in box_stats(_long(df, cols), "value", ["column"]).collect()}
    if strategy == "most_frequent":
        return {r["column"]: r["value"] for r in most_frequent(df, cols).collect()}
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the values that are there."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _value(df, c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the modal value of each column (ties: smallest value)."""
    counts = _long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # largest count, then smallest value: an algebraic max over (n, -value), partial per task, so a
    # column with many distinct values never lands in one task
    best = counts.groupBy("column").agg(F.max(F.struct(F.col("n"), (-F.col("value")).alias("neg"))).alias("m"))
    return best.select("column", (-F.col("m.neg")).alias("value"), F.col("m.n").alias("n"))


def impute_simple(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "mean",
                  fill_value: float = 0.0) -> DataFrame:
    """Replace missing values in the numeric columns by the per-column fill value.

    Mean and median make an integer column a double; the other strategies keep its type. A column without any value stays NULL.
    """
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    vals = fill_values(df, cols, strategy, fill_value)

    def filled(c: str):
        if c not in cols:
            return _ref(c)
        whole = df.schema[c].dataType.typeName() in ("integer", "long")
        kind = "double" if whole and strategy in ("mean", "median") else df.schema[c].dataType.simpleString()
        return F.coalesce(_value(df, c).cast(kind), F.lit(vals.get(c)).cast(kind)).alias(c)

    return df.select(*[filled(c) for c in df.columns])


def impute_iterative(df: DataFrame, columns: Sequence[str], rounds: int = 3, id_col: str = "SK_ID_CURR",
                     reg_param: float = 0.0) -> DataFrame:
    """I2, column after column: start from the means, then per round fit each incomplete column on the other columns as they are by then (rows
    where it is observed) and replace its missing values by the prediction. Complete columns are only regressors."""
    cols = list(columns)
    x = {c: f"_x{i}" for i, c in enumerate(cols)}  # plain names: the originals may hold dots
    gaps = df.agg(*[F.max(missing(df, c)).alias(x[c]) for c in cols]).first()
    incomplete = [c for c in cols if gaps[x[c]]]
    filled = impute_simple(df.select("*", *[missing(df, c).alias(f"_m{x[c]}") for c in incomplete]), cols, "mean")
    others = [_ref(c) for c in filled.columns if c not in cols]
    cur = written(filled.select(*others, *[_ref(c).cast("double").alias(x[c]) for c in cols]), "imputed")
    for _ in range(rounds):
        for c in incomplete:
            rest = [x[o] for o in cols if o != c]
            if not rest:
                continue
            va = VectorAssembler(inputCols=rest, outputCol="_features", handleInvalid="keep")
            gap = F.col(f"_m{x[c]}")
            model = LinearRegression(featuresCol="_features", labelCol=x[c], predictionCol="_p", regParam=reg_param).fit(va.transform(cur.where(~gap)))
            scored = model.transform(va.transform(cur))
            cur = written(scored.withColumn(x[c], F.when(gap, F.col("_p")).otherwise(F.col(x[c]))).drop("_features", "_p"), "imputed")
    return cur.select(*[F.col(x[c]).alias(c) if c in x else _ref(c) for c in df.columns])


def sweep(a: np.ndarray, k: int) -> None:
    """Sweep a symmetric matrix of cross products on its column ``k``, in place: after sweeping x1, x2 ... the other columns hold their coefficients."""
    d = a[k, k]
    row, col = a[k] / d, a[:, k].copy()
    a -= np.outer(col, row)
    a[k], a[:, k] = row, -col / d
    a[k, k] = 1.0 / d


def regressions(total: np.ndarray, gaps: dict[int, np.ndarray]) -> np.ndarray:
    """Coefficients (constant and columns x columns) of each column of ``gaps`` on all others, over the rows where it is there.

    total, gaps[c]: cross products of the constant and the columns over all rows, and over the rows in which column c is missing. Columns that
    the others explain are left out of a regression (coefficient zero).
    """
    out = np.zeros((len(total), len(total) - 1))
    for c, missed in gaps.items():
        a = total - missed
        whole = a.diagonal().copy()
        if whole[0] <= 0:
            continue
        used = []
        for k in [0, *(k for k in range(1, len(a)) if k != c + 1)]:
            if a[k, k] > COLLINEAR * max(whole[k], 1e-300) and a[k, k] > 0:
                sweep(a, k)
                used.append(k)
        out[used, c] = a[used, c + 1]
    return out


def _filled(x: np.ndarray, gap: np.ndarray, rounds: Sequence[np.ndarray]) -> np.ndarray:
    """Standardised rows with their gaps filled by the rounds' coefficients, from zero (the means)."""
    now = np.where(gap, 0.0, x)
    for coefficients in rounds:
        now = np.where(gap, coefficients[0] + now @ coefficients[1:], now)
    return now


def _columns(batch: pa.RecordBatch, p: int, means: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:p]]).astype(float)
    return (x - means) / scales, ~np.isfinite(x)


def _cross_products(batches: Iterator[pa.RecordBatch], means: np.ndarray, scales: np.ndarray, incomplete: list[int],
                    rounds: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(column, sums): a task's cross products, over all rows (column -1) and over those in which each incomplete column is missing."""
    p, sums, seen = len(means), np.zeros((len(incomplete) + 1, len(means) + 1, len(means) + 1)), False
    for batch in batches:
        if not batch.num_rows:
            continue
        x, gap = _columns(batch, p, means, scales)
        now = np.column_stack([np.ones(len(x)), _filled(x, gap, rounds)])
        sums[0] += now.T @ now
        for i, c in enumerate(incomplete):
            part = now[gap[:, c]]
            sums[i + 1] += part.T @ part
        seen = True
    if seen:
        for c, x in zip([-1, *incomplete], sums, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.ravel().tolist()], pa.list_(pa.float64()))], ["col", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, sums in zip(batch.column("col").to_pylist(), batch.column("sums"), strict=True):
            x = sums.values.to_numpy()
            held[c] = held[c] + x if c in held else x
    for c, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64()))], ["col", "sums"])


def _projected(batches: Iterator[pa.RecordBatch], means: np.ndarray, scales: np.ndarray, rounds: Sequence[np.ndarray], empty: list[int]) -> Iterator[pa.RecordBatch]:
    p = len(means)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, _ = _columns(batch, p, means, scales)
        raw = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:p]]
        now = _filled(x, ~np.isfinite(x), rounds) * scales + means
        done = [c if k in empty else pa.array(np.where(np.isnan(raw[k]), now[:, k], raw[k])) for k, c in enumerate(batch.columns[:p])]
        yield pa.RecordBatch.from_arrays([*done, *batch.columns[p:]], batch.schema.names)


def impute_regression(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = 3) -> DataFrame:
    """Start from the means, then per round regress every incomplete column on all others (rows where it is there), all from the round's
    start, and replace its missing values by the predictions. All numeric columns by default; they become doubles, other columns are unchanged.

    One scan per round: a task sends one packed array of cross products for each incomplete column, added up in a tree, and the driver
    sweeps them (columns squared numbers for each). Infinite values stay, and count as missing in the regressions; a column without
    any value stays NULL; a constant column is filled with its value.
    """
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    others = [c for c in df.columns if c not in cols]
    p = len(cols)
    x, rest = {c: f"x{i}" for i, c in enumerate(cols)}, {c: f"o{i}" for i, c in enumerate(others)}
    value = {c: F.when(~missing(df, c), _ref(c).cast("double")) for c in cols}
    plain = written(df.select(*[value[c].alias(x[c]) for c in cols], *[_ref(c).alias(rest[c]) for c in others]), "gaps")
    finite = [F.when(F.abs(F.col(v)) < float("inf"), F.col(v)) for v in x.values()]
    told = plain.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)],
                     *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(finite)], *[F.count(v).alias(f"n{i}") for i, v in enumerate(finite)]).first()
    means = np.array([told[f"m{i}"] or 0.0 for i in range(p)])
    scales = np.array([told[f"s{i}"] or 1.0 for i in range(p)])
    empty = [i for i in range(p) if not told[f"n{i}"]]
    incomplete = [i for i in range(p) if 0 < told[f"n{i}"] < told["n"]]
    made: list[np.ndarray] = []
    for _ in range(rounds if incomplete and p > 1 else 0):
        leaves = plain.select(*x.values()).mapInArrow(partial(_cross_products, means=means, scales=scales, incomplete=incomplete, rounds=list(made)), "col int, sums array<double>")
        branches = leaves.withColumn("branch", F.spark_partition_id() % BRANCHES).repartition("col", "branch").select("col", "sums").mapInArrow(_added, "col int, sums array<double>")
        found = {r["col"]: np.array(r["sums"]).reshape(p + 1, p + 1) for r in branches.repartition("col").mapInArrow(_added, "col int, sums array<double>").toLocalIterator()}
        made.append(regressions(found.pop(-1), found))
    done = plain.mapInArrow(partial(_projected, means=means, scales=scales, rounds=made, empty=empty), plain.schema)
    return done.select(*[F.col((x | rest)[c]).alias(c) for c in df.columns])


def cleanup(df: DataFrame, min_fill: float, impute: bool = False, strategy: str = "mean") -> DataFrame:
    """Drop sparse columns, then impute or drop incomplete rows. The table is written once, as it is read for the decision and for the result."""
    kept = drop_sparse_columns(written(df, "cleanup"), min_fill)
    return impute_simple(kept, strategy=strategy) if impute else drop_null_rows(kept)
