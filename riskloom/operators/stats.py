"""Statistics (C1-C5): pairwise correlation, correlation pruning, one-way ANOVA, chi-square.

Correlation is pairwise-complete with non-finite values treated as missing and constant columns
giving NULL. A few pairs: one aggregation with sample (co)variances per pair. All pairs of a wide row:
per-task matrix moments (numpy matrix products over an Arrow batch), packed by pairs of column blocks and
added up in a tree - work n * p^2 stays in the executors, the driver only sees pairs.
Chi-square needs the observed cells and their margins only. P-values are tail probabilities of a one-row result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import missing, nonfinite_to_null
from riskloom.session import written

# Variance at or below this counts as constant.
VAR_TOLERANCE = 1e-12
# Columns of a block of the moment matrix, and branches of the tree that adds the blocks up.
BLOCK, BRANCHES = 64, 32
# Cells of a chi-square grid that may be laid out on request.
GRID_CELLS = 1_000_000


def _ref(c: str):
    return F.col(f"`{c}`")


def _clean(c: str):
    return nonfinite_to_null(_ref(c).cast("double"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C1 (few columns): (col_i, col_j, corr, abs_corr, n) for i < j, pairwise-complete, one pass."""
    cols = list(columns)
    aggs, meta = [], []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            both = _clean(cols[i]).isNotNull() & _clean(cols[j]).isNotNull()
            x = F.when(both, _clean(cols[i]))
            y = F.when(both, _clean(cols[j]))
            k = len(meta)
            aggs += [F.covar_samp(x, y).alias(f"c{k}"), F.var_samp(x).alias(f"vx{k}"), F.var_samp(y).alias(f"vy{k}"),
                     F.count(x).alias(f"n{k}")]
            meta.append((cols[i], cols[j]))
    wide = df.agg(*aggs)
    parts = []
    for k, (a, b) in enumerate(meta):
        vx, vy = F.col(f"vx{k}"), F.col(f"vy{k}")
        r = F.when((vx > VAR_TOLERANCE) & (vy > VAR_TOLERANCE), F.col(f"c{k}") / F.sqrt(vx * vy))
        parts.append(F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), r.alias("corr"), F.col(f"n{k}").alias("n")))
    long = wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return long.select("col_i", "col_j", "corr", F.abs("corr").alias("abs_corr"), "n")


def _moments(batches: Iterator[pa.RecordBatch], means: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """One row per pair of column blocks: the packed sums (n, x, y, xx, yy, xy; first index from the first block) of a task's rows."""
    p = len(means)
    sums = np.zeros((4, p, p))  # n, x, xx, xy: y and yy are the transposes of x and xx
    seen = False
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, p))
        here = ~np.isnan(x)
        z, m = np.where(here, x - means, 0.0), here.astype(float)
        sums += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        seen = True
    if not seen:
        return
    n, sx, sxx, sxy = sums
    cuts = range(0, p, block)
    for i in cuts:
        for j in cuts:
            if j >= i:
                at, ta = np.s_[i : i + block, j : j + block], np.s_[j : j + block, i : i + block]
                packed = np.stack([n[at], sx[at], sx[ta].T, sxx[at], sxx[ta].T, sxy[at]])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([packed.ravel().tolist()], pa.list_(pa.float64()))], ["i", "j", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed arrays of each block pair that come to this task; one array per pair is held."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, sums in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("sums"), strict=True):
            x = sums.values.to_numpy()
            held[i, j] = held[i, j] + x if (i, j) in held else x
    for (i, j), x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64()))], ["i", "j", "sums"])


def _unpacked(batches: Iterator[pa.RecordBatch], p: int, block: int) -> Iterator[pa.RecordBatch]:
    """(i, j, n, sx, sy, sxx, syy, sxy) for the columns i < j of each block pair."""
    for batch in batches:
        for bi, bj, sums in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("sums"), strict=True):
            rows, cols = min(block, p - bi), min(block, p - bj)
            i, j = np.divmod(np.arange(rows * cols), cols)
            kept = bi + i < bj + j
            parts = sums.values.to_numpy().reshape(6, -1)[:, kept]
            yield pa.RecordBatch.from_arrays([pa.array((bi + i)[kept].astype(np.int32)), pa.array((bj + j)[kept].astype(np.int32)), *[pa.array(x) for x in parts]],
                                             ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])


def blocked_moments(clean: DataFrame, means: np.ndarray, block: int = BLOCK, branches: int = BRANCHES) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of all pairs of the numeric columns of ``clean``, centred on ``means``.

    A task sends (p / block) ** 2 / 2 rows of packed sums whatever the number of pairs. They are added up in a tree: first the tasks of a branch
    for each block pair, then the branches.
    """
    schema = "i int, j int, sums array<double>"
    leaves = clean.mapInArrow(partial(_moments, means=means, block=block), schema).withColumn("branch", F.spark_partition_id() % branches)
    level = leaves.repartition("i", "j", "branch").select("i", "j", "sums").mapInArrow(_merged, schema)
    whole = level.repartition("i", "j").mapInArrow(_merged, schema)
    return whole.mapInArrow(partial(_unpacked, p=len(means), block=block), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")


def correlation_matrix_pairs(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """C1 (all pairs of a wide row): same output as ``correlation_pairs`` from blocked moments.

    The numeric columns are written once in the shared folder and read twice: one JVM aggregation
    for the global means (p numbers to the driver), then one pass centring on them,
    so the moment sums stay well conditioned (``blocked_moments``). A task holds four p x p arrays.
    """
    cols = list(columns)
    p = len(cols)
    clean = written(df.select(*[_clean(c).alias(f"x{i}") for i, c in enumerate(cols)]), "correlation")
    means_row = clean.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(p)]).first()
    means = np.array([0.0 if means_row[i] is None else float(means_row[i]) for i in range(p)])
    summed = blocked_moments(clean, means, block)
    n = F.col("n")
    vx = F.try_divide(F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n), n - 1)
    vy = F.try_divide(F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n), n - 1)
    cov = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n), n - 1)
    ok = (n > 1) & (vx > VAR_TOLERANCE) & (vy > VAR_TOLERANCE)
    r = F.when(ok, cov / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in cols])
    return summed.select(names[F.col("i")].alias("col_i"), names[F.col("j")].alias("col_j"), r.alias("corr"),
                         F.abs(r).alias("abs_corr"), n.cast("long").alias("n"))


def correlated_drop_report(pairs: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """C2 decision table (column, dropped): a column is dropped when any earlier column (by position)
    correlates above ``threshold`` with it, whether or not that earlier column is itself dropped."""
    pos = {c: i for i, c in enumerate(columns)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    # pairs are emitted with col_i before col_j in column order
    hit = pairs.where(F.col("abs_corr") > threshold).select(
        F.when(order[F.col("col_i")] < order[F.col("col_j")], F.col("col_j")).otherwise(F.col("col_i")).alias("column"))
    hits = hit.distinct().withColumn("dropped", F.lit(True))
    names = pairs.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(hits, "column", "left").select("column", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def prune_correlated(df: DataFrame, threshold: float = 0.8, fraction: float | None = None,
                     protect: Sequence[str] = ("SK_ID_CURR",), seed: int = 0,
                     id_col: str = "SK_ID_CURR") -> tuple[DataFrame, list[str]]:
    """Drop the later column of every pair above ``threshold``; returns (frame, dropped names).

    Numeric columns except ``protect`` take part (the label included, as in the source). With
    ``fraction`` the correlations come from a hash sample of rows.
    """
    from riskloom.operators.sampling import sample_fraction

    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short") and f.name not in set(protect)]
    src = sample_fraction(df, fraction, id_col, seed) if fraction else df
    told = correlated_drop_report(correlation_matrix_pairs(src, numeric), numeric, threshold)
    dropped = sorted(r["column"] for r in told.where("dropped").collect())
    return df.drop(*[_ref(c) for c in dropped]), dropped


# ---- ANOVA and chi-square -------------------------------------------------------------------------


def anova_table(df: DataFrame, value: str, group: str, groups: Sequence[str] | None = None) -> DataFrame:
    """One row (f_stat, eta_sq, df_between, df_within, ss_between, ss_within); group as a factor.

    NULL and NaN values and NULL groups are left out. One group, or as many groups as rows, has no F: NULL.
    """
    d = df.where(~missing(df, value) & _ref(group).isNotNull())
    if groups:
        d = d.where(_ref(group).isin(list(groups)))
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(_ref(value).cast("double")).alias("m"),
                             F.coalesce(F.var_samp(_ref(value).cast("double")), F.lit(0.0)).alias("v"))
    # the per-group table has one row per group
    tot = g.agg(F.sum("n").alias("N"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"),
                F.count(F.lit(1)).alias("G"))
    gm = tot.first()
    grand, df1, df2 = gm["grand"] or 0.0, int(gm["G"]) - 1, int(gm["N"] or 0) - int(gm["G"])
    ssb = F.sum(F.col("n") * (F.col("m") - F.lit(grand)) * (F.col("m") - F.lit(grand)))
    ssw = F.sum((F.col("n") - 1) * F.col("v"))
    between, within = F.col("ss_between") / F.lit(float(max(df1, 1))), F.col("ss_within") / F.lit(float(max(df2, 1)))
    return g.agg(ssb.alias("ss_between"), ssw.alias("ss_within")).select(
        F.when(F.lit(df1 > 0 and df2 > 0), F.try_divide(between, within)).alias("f_stat"),
        F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta_sq"),
        F.lit(df1).cast("long").alias("df_between"), F.lit(df2).cast("long").alias("df_within"),
        "ss_between", "ss_within")


def with_anova_p(table: DataFrame) -> DataFrame:
    """The one row of ``anova_table`` with its p-value."""
    return _with_p(table, lambda r: f_sf(r["f_stat"], r["df_between"], r["df_within"]))


def with_chi2_p(table: DataFrame) -> DataFrame:
    """The one row of ``chi2_table`` with its p-value."""
    return _with_p(table, lambda r: chi2_sf(r["chi2"], r["dof"]))


def _with_p(table: DataFrame, tail) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pdf.assign(p=pd.Series([tail(r) for r in rows], dtype="float64", index=pdf.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInPandas(run, f"{schema}, p double")


def anova(df: DataFrame, value: str, group: str, groups: Sequence[str] | None = None) -> tuple[float | None, float | None, float | None]:
    """(F, p, eta squared)."""
    r = with_anova_p(anova_table(df, value, group, groups)).first()
    return r["f_stat"], r["p"], r["eta_sq"]


def _cells(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observed cells, x margin, y margin) over non-NULL pairs; the table is aggregated once and the cells are written."""
    base = df.where(_ref(x).isNotNull() & _ref(y).isNotNull()).select(
        _ref(x).cast("string").alias("x"), _ref(y).cast("string").alias("y"))
    cells = written(base.groupBy("x", "y").agg(F.count(F.lit(1)).alias("observed")), "cells")
    return (cells, cells.groupBy("x").agg(F.sum("observed").alias("r")), cells.groupBy("y").agg(F.sum("observed").alias("c")))


def chi2_table(df: DataFrame, x: str, y: str) -> DataFrame:
    """C4: one row (chi2, dof, n), with Yates' correction for one degree of freedom; NULL without a degree of freedom.

    From observed cells only: chi2 = n (sum O^2 / (r c) - 1). In a 2x2 table |O - E| is the same in all cells, and the sum
    of 1 / E is n (sum 1 / r) (sum 1 / c), so empty cells need no row either.
    """
    cells, rows, cols = _cells(df, x, y)
    m = rows.agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("r")).alias("inv"), F.sum("r").alias("n")).first()
    k = cols.agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("c")).alias("inv")).first()
    n, dof = float(m["n"] or 0), max(int(m["k"]) - 1, 0) * max(int(k["k"]) - 1, 0)
    j = cells.join(rows, "x").join(cols, "y")
    share = F.sum(F.col("observed") * F.col("observed") / F.col("r") / F.col("c"))
    gap = F.max(F.abs(F.col("observed") - F.col("r") * F.col("c") / F.lit(n or 1.0)))
    if dof == 1:
        rest = gap - F.least(F.lit(0.5), gap)
        chi2 = rest * rest * F.lit(n * m["inv"] * k["inv"])
    else:
        chi2 = F.when(F.lit(dof > 0), F.lit(n) * (share - F.lit(1.0)))
    return j.agg(chi2.cast("double").alias("chi2"), F.lit(dof).cast("long").alias("dof"), F.coalesce(F.sum("observed"), F.lit(0)).alias("n"))


def chi2_test(df: DataFrame, x: str, y: str) -> tuple[float | None, float | None]:
    """C4: (chi2, p)."""
    r = with_chi2_p(chi2_table(df, x, y)).first()
    return r["chi2"], r["p"]


def chi2_contributions(df: DataFrame, x: str, y: str) -> DataFrame:
    """C5, sparse: the observed cells (x, y, observed, expected, share), and in every row the number of empty cells and their share together.

    share: (O - E)^2 / E divided by the table total (no continuity correction; NULL when independent). An empty cell's term is its E, and all E
    sum to n, so the empty cells' total is n less the observed cells' E: no cell that holds nothing is ever made.
    """
    cells, rows, cols = _cells(df, x, y)
    t = cells.join(rows, "x").join(cols, "y")
    n = rows.agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("k")).first()
    grid = int(n["k"]) * cols.count()
    expected = F.col("r").cast("double") * F.col("c").cast("double") / F.lit(float(n["n"] or 1))
    t = t.select("x", "y", "observed", expected.alias("expected"))
    term = (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")
    told = t.agg(F.sum(term).alias("t"), F.sum("expected").alias("e"), F.count(F.lit(1)).alias("k")).first()
    empty = grid - int(told["k"])
    rest = max(float(n["n"] or 0) - float(told["e"] or 0.0), 0.0) if empty else 0.0
    total = F.lit(float(told["t"] or 0.0) + rest)
    return t.select(F.col("x").alias(x), F.col("y").alias(y), "observed", "expected", F.try_divide(term, total).alias("share"),
                    F.lit(empty).cast("long").alias("empty_cells"), F.try_divide(F.lit(rest), total).alias("empty_share"))


def chi2_grid(df: DataFrame, x: str, y: str, max_cells: int = GRID_CELLS) -> DataFrame:
    """C5, the full grid of two small vocabularies: (x, y, observed, expected, share) for empty cells too.

    For tables of categories to look at; more than ``max_cells`` cells are an error (``chi2_contributions`` has no bound).
    """
    cells, rows, cols = _cells(df, x, y)
    sizes = rows.count(), cols.count()
    if sizes[0] * sizes[1] > max_cells:
        raise ValueError(f"a grid of {sizes[0]} x {sizes[1]} cells; chi2_contributions has the observed ones")
    n = rows.agg(F.sum("r").alias("n")).first()["n"] or 0
    margin = F.array(*[F.struct(F.lit(r["y"]).alias("y"), F.lit(r["c"]).alias("c")) for r in cols.collect()]) if sizes[1] else F.array()  # bounded above
    if not sizes[1]:
        return chi2_contributions(df, x, y).drop("empty_cells", "empty_share")
    grid = rows.select("x", "r", F.explode(margin).alias("m")).select("x", "m.y", (F.col("r").cast("double") * F.col("m.c").cast("double") / F.lit(float(n))).alias("expected"))
    t = grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("observed", F.lit(0)).alias("observed"), "expected")
    term = (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")
    tot = t.agg(F.sum(term).alias("t")).first()["t"]
    return t.select(F.col("x").alias(x), F.col("y").alias(y), "observed", "expected", F.try_divide(term, F.lit(float(tot or 0.0))).alias("share"))


# ---- distribution tails (one number each, on the driver) ---------------------------------------


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def f_sf(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f) for the F(d1, d2) distribution."""
    if f is None or not math.isfinite(f):
        return None
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        s, term, ap = 1.0 / a, 1.0 / a, a
        for _ in range(1000):
            ap += 1
            term *= x / ap
            s += term
            if abs(term) < abs(s) * 1e-16:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float | None, dof: float) -> float | None:
    if x is None or not math.isfinite(x) or dof <= 0:
        return None
    return gammainc_upper(dof / 2.0, x / 2.0)
