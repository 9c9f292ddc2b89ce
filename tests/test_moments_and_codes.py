"""Blocked correlation moments, regression imputation by sweeping, the distributed dictionary, sparse chi-square."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import encode, impute, stats


def wide(seed, rows=300, p=11):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 4))
    x = base @ rng.normal(size=(4, p)) + rng.normal(size=(rows, p)) * 0.5 + rng.normal(size=p) * 100
    x[rng.random(x.shape) < 0.15] = np.nan
    return x


def frame(spark, x, parts=7):
    rows = [(i, *[None if np.isnan(v) and i % 2 else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"`c.{j}` double" for j in range(x.shape[1]))).repartition(parts)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_blocked_correlation(spark, block):
    x = wide(1)
    x[3, 2] = np.inf
    x[:, 5] = 7.0
    df = frame(spark, x)
    cols = [f"c.{j}" for j in range(x.shape[1])]
    got = {(r.col_i, r.col_j): (r.corr, r.n) for r in stats.correlation_matrix_pairs(df, cols, block=block).collect()}
    assert len(got) == 55
    x[3, 2] = np.nan
    for (a, b), (r, n) in got.items():
        i, j = cols.index(a), cols.index(b)
        assert i < j
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert n == both.sum()
        assert r is None if 5 in (i, j) else np.isclose(r, np.corrcoef(x[both, i], x[both, j])[0, 1], rtol=1e-9)


def test_moments_send_block_pairs_only(spark):
    x = np.nan_to_num(wide(2, p=10))
    rows = frame(spark, x).drop("id").toDF(*[f"x{i}" for i in range(10)]).mapInArrow(
        lambda batches: stats._moments(batches, np.zeros(10), 4), "i int, j int, sums array<double>").withColumn("t", F.spark_partition_id())
    per = {r.t: r["count"] for r in rows.groupBy("t").count().collect()}
    assert set(per.values()) == {6}  # 3 blocks: 6 pairs, not 45
    assert stats.blocked_moments(spark.createDataFrame([], "x0 double, x1 double"), np.zeros(2)).count() == 0


def brute_round(x, now, missing):
    out = now.copy()
    for c in range(x.shape[1]):
        if missing[:, c].any():
            a = np.column_stack([np.ones(len(x)), np.delete(now, c, axis=1)])
            there = ~missing[:, c]
            b = np.linalg.lstsq(a[there], now[there, c], rcond=None)[0]
            out[~there, c] = a[~there] @ b
    return out


@pytest.mark.parametrize("rounds", [1, 3])
def test_regression_imputation_is_that_of_brute_force(spark, rounds):
    x = wide(3)
    x[:, 0] = np.arange(len(x))  # complete
    missing = np.isnan(x)
    now = np.where(missing, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        now = brute_round(x, now, missing)
    df = frame(spark, x).withColumn("note", F.lit("n"))
    got = impute.impute_regression(df, [f"c.{j}" for j in range(x.shape[1])], rounds=rounds).orderBy("id")
    assert got.columns == df.columns
    made = np.array([[r[f"c.{j}"] for j in range(x.shape[1])] for r in got.collect()])
    assert np.allclose(made, now, rtol=1e-7, atol=1e-7)


def test_regression_imputation_edges(spark):
    inf = float("inf")
    rows = [(1, 1.0, 2.0, None, 5.0, 1.0), (2, 2.0, 4.0, None, 5.0, inf), (3, 3.0, None, None, None, 3.0), (4, None, 8.0, None, 5.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, empty double, same double, wild double")
    got = {r.id: r for r in impute.impute_regression(df, ["a", "b", "empty", "same", "wild"]).collect()}
    assert all(r.empty is None for r in got.values()) and got[3].same == 5.0 and got[2].wild == inf
    assert all(np.isfinite(v) for r in got.values() for v in (r.a, r.b)) and np.isfinite(got[4].wild)
    same = impute.impute_regression(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
    assert {tuple(r) for r in same.collect()} == {(1.0, 2.0), (2.0, 3.0)}  # nothing to fill
    assert impute.impute_regression(df.limit(0), ["a", "b"]).count() == 0
    twin = [(float(i), float(2 * i), None if i == 7 else 3.0 * i) for i in range(20)]  # collinear regressors
    filled = impute.impute_regression(spark.createDataFrame(twin, "a double, b double, c double")).where("a = 7").first()
    assert np.isclose(filled.c, 21.0)


def test_dictionary_is_a_dense_rank(spark):
    values = [None if i % 17 == 0 else f"v{i * 7919 % 5003}é" for i in range(20_000)]
    df = spark.createDataFrame([(i, v, "x" if i % 2 else None, None) for i, v in enumerate(values)], "id int, `a.b` string, c string, none string").repartition(9)
    rank = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    got = {r.id: r for r in encode.factorize(df, ["a.b", "c", "none"]).collect()}
    assert len(got) == len(values)
    assert all(got[i]["a.b"] == rank.get(v, -1) and got[i].c == (0 if i % 2 else -1) and got[i].none == -1 for i, v in enumerate(values))
    table = {(r.column, r.value): r.code for r in encode.dictionary(df, ["a.b", "c", "none"]).collect()}
    assert table == {("a.b", v): c for v, c in rank.items()} | {("c", "x"): 0}


def test_factorize_with_a_given_vocabulary(spark):
    df = spark.createDataFrame([("b", "q"), ("z", "p"), (None, None)], "a string, b string")
    assert sorted(tuple(r) for r in encode.factorize(df, ["a", "b"], {"a": ["a", "b"]}).collect()) == [(-1, -1), (-1, 0), (1, 1)]


def test_sparse_one_hot_has_the_ones_of_the_wide_form(spark):
    df = spark.createDataFrame([(1, "b", "q"), (2, "a", None), (3, None, "p")], "id int, a string, b string")
    out, width = encode.one_hot_sparse(df, ["a", "b"])
    wide_form, names = encode.one_hot(df, ["a", "b"])
    assert width == len(names)
    ones = {r.id: [i for i, n in enumerate(names) if r[n]] for r in wide_form.collect()}
    assert {r.id: r.indices for r in out.collect()} == ones
    assert {r.id: r.indices for r in encode.one_hot_sparse(df, ["a", "b"], null_category=False)[0].collect()} == {1: [1, 3], 2: [0], 3: [2]}


def test_sparse_chi_square_sums_up_the_empty_cells(spark):
    rows = [("x", "u")] * 10 + [("y", "v")] * 20 + [("z", "w")] * 5 + [("x", "v")] * 2 + [(None, "u"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    grid = {(r.a, r.b): r for r in stats.chi2_grid(df, "a", "b").collect()}
    sparse = {(r.a, r.b): r for r in stats.chi2_contributions(df, "a", "b").collect()}
    assert len(grid) == 9 and len(sparse) == 4
    assert all(np.isclose(r.share, grid[k].share) and r.observed == grid[k].observed and r.empty_cells == 5 for k, r in sparse.items())
    empty = sum(r.share for k, r in grid.items() if k not in sparse)
    assert all(np.isclose(r.empty_share, empty) for r in sparse.values())
    with pytest.raises(ValueError, match="grid"):
        stats.chi2_grid(df, "a", "b", max_cells=8)
    none = spark.createDataFrame([], "a string, b string")
    assert stats.chi2_contributions(none, "a", "b").count() == 0 == stats.chi2_grid(none, "a", "b").count()
