"""NULL / NaN / infinity rules on tiny inline frames."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalar import clip_at_zero, nonfinite_to_null, safe_ratio
from riskloom.operators.aggregate import Feature, Subset, aggregate_block, category_features, spec_features
from riskloom.operators.blocks import factorize_expr
from riskloom.operators.clean import filter_not_value
from riskloom.operators.encode import one_hot

INF = float("inf")


def test_filter_keeps_null(spark):  # T1
    df = spark.createDataFrame([(1, "F"), (2, "XNA"), (3, None)], "k int, g string")
    assert sorted(r.k for r in filter_not_value(df, "g", "XNA").collect()) == [1, 3]


def test_safe_ratio(spark):  # T2
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (None, 1.0), (3.0, 2.0)], "a double, b double")
    out = [r.r for r in df.select(safe_ratio("a", "b").alias("r")).collect()]
    assert out[0] == INF and out[1] == -INF and out[2] is None and out[3] is None and out[4] == 1.5


def test_aggregate_edges(spark):  # T3-T6
    rows = [(1, 5.0, "a"), (2, None, None), (2, None, "b"), (3, 1.0, "a"), (3, INF, "a"), (4, INF, "b"), (4, -INF, "b")]
    df = spark.createDataFrame(rows, "k int, v double, c string")
    feats = spec_features(df, {"v": ["min", "max", "mean", "sum", "var", "size", "nunique"]})
    out = {r.k: r for r in aggregate_block(df, "k", feats, "X_").collect()}
    assert out[1].X_v_VAR is None and out[1].X_v_SIZE == 1  # one row: var NULL
    assert out[2].X_v_SUM == 0 and out[2].X_v_MEAN is None and out[2].X_v_NUNIQUE == 0  # all-NULL sum = 0
    assert out[3].X_v_MIN == 1.0 and out[3].X_v_MAX is None and out[3].X_v_MEAN is None  # inf flows, then NULL
    assert out[4].X_v_MEAN is None and out[4].X_v_SUM is None


def test_subset_block_null_when_absent(spark):  # T14
    df = spark.createDataFrame([(1, "Active", 2.0), (1, "Closed", 3.0), (2, "Closed", 4.0), (3, "Active", None)],
                               "k int, s string, v double")
    feats = spec_features(df, {"v": ["sum", "size", "mean"]})
    sub = Subset("A_", "s = 'Active'", tuple(feats))
    out = {r.k: r for r in aggregate_block(df, "k", feats, "B_", [sub]).collect()}
    assert out[2].A_v_SUM is None and out[2].A_v_SIZE is None  # no Active row: whole subset NULL
    assert out[3].A_v_SUM == 0 and out[3].A_v_SIZE == 1  # Active rows, all values NULL: sum 0
    assert out[1].A_v_SUM == 2.0 and out[1].B_v_SUM == 5.0


def test_clip_null_to_zero(spark):  # T7
    df = spark.createDataFrame([(None,), (-3.0,), (2.0,)], "x double")
    assert [r.c for r in df.select(clip_at_zero("x").alias("c")).collect()] == [0, 0, 2.0]


def test_one_hot_null_column_and_shares(spark):  # T8, shares sum to 1
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "b"), (2, "a")], "k int, c string")
    enc, names = one_hot(df, ["c"])
    assert names == ["c_a", "c_b", "c_nan"]
    no_null = spark.createDataFrame([(1, "a")], "k int, c string")
    assert one_hot(no_null, ["c"])[1] == ["c_a", "c_nan"]
    feats = category_features("c", ["a", "b"], True)
    shares = aggregate_block(df, "k", feats, "").collect()
    for r in shares:
        assert math.isclose(r.c_a_MEAN + r.c_b_MEAN + r.c_nan_MEAN, 1.0)


def test_factorize_sorted_null_minus_one(spark):  # T9
    df = spark.createDataFrame([("M",), ("F",), (None,)], "g string")
    assert [r.c for r in df.select(factorize_expr("g", ["F", "M"]).alias("c")).collect()] == [1, 0, -1]


def test_nonfinite_to_null(spark):
    df = spark.createDataFrame([(INF,), (-INF,), (float("nan"),), (1.0,)], "x double")
    assert [r.y for r in df.select(nonfinite_to_null("x").alias("y")).collect()] == [None, None, None, 1.0]


def test_correlation_rules(spark):  # T10, T11
    import numpy as np

    from riskloom.operators.stats import correlated_drop_report, correlation_matrix_pairs, correlation_pairs

    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        x = float(rng.normal())
        rows.append((x, 2 * x + 0.01 * float(rng.normal()), 5.0, None if i % 7 == 0 else float(rng.normal()),
                     INF if i == 3 else x * -1.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    cols = ["a", "b", "c", "d", "e"]
    small = {(r.col_i, r.col_j): r.corr for r in correlation_pairs(df, cols).collect()}
    big = {(r.col_i, r.col_j): r.corr for r in correlation_matrix_pairs(df, cols).collect()}
    assert small[("a", "c")] is None and big[("a", "c")] is None  # constant column
    assert small[("a", "b")] > 0.99 and small[("a", "e")] < -0.99  # inf skipped
    for k, v in small.items():
        if v is not None:
            assert abs(v - big[k]) < 1e-9
    pdf = df.toPandas().replace([INF, -INF], np.nan)
    assert abs(pdf["a"].corr(pdf["d"]) - small[("a", "d")]) < 1e-9  # pairwise complete like pandas
    pairs = correlation_pairs(df, cols)
    dropped = {r.column for r in correlated_drop_report(pairs, cols, 0.8).where("dropped").collect()}
    assert dropped == {"b", "e"}  # later columns of correlated pairs; e dropped though a or b also dropped


def test_chi2_yates_and_anova(spark):  # T12, C3
    from riskloom.operators.stats import anova, chi2_test

    rows = [("x", "u")] * 10 + [("x", "v")] * 20 + [("y", "u")] * 30 + [("y", "v")] * 15 + [(None, "u")]
    df = spark.createDataFrame(rows, "a string, b string")
    chi2, p = chi2_test(df, "a", "b")
    # hand computation with Yates' correction, NULL pair skipped (n = 75)
    obs = [[10, 20], [30, 15]]
    n = 75.0
    rt, ct = [30, 45], [40, 35]
    exp = sum((abs(obs[i][j] - rt[i] * ct[j] / n) - 0.5) ** 2 / (rt[i] * ct[j] / n) for i in range(2) for j in range(2))
    assert math.isclose(chi2, exp, rel_tol=1e-12)
    assert 0 < p < 0.01
    g = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("c", 7.0), ("c", 8.0),
                               ("c", 9.0)], "g string, q double")
    f, pval, eta = anova(g, "q", "g")
    assert math.isclose(f, 27.0) and math.isclose(eta, 54.0 / 60.0)
    assert math.isclose(pval, 0.001, rel_tol=0.05)


def test_nan_input_is_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 5.0)], "k int, v double")
    feats = spec_features(df, {"v": ["max", "mean", "size"]})
    r = aggregate_block(df, "k", feats, "").first()
    assert r.v_MAX == 5.0 and r.v_MEAN == 3.5 and r.v_SIZE == 3
