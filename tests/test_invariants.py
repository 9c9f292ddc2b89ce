"""Invariants and brute-force twins of the scalable operators."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators import blocks as B
from riskloom.operators.aggregate import spec_features
from riskloom.operators.joins import join_subset_aggregate
from riskloom.operators.metrics import auc_roc, threshold_gain_sweep
from riskloom.operators.ordered import ordered_cumsum
from riskloom.operators.profile import box_stats
from riskloom.operators.ranking import waterfall_steps
from riskloom.operators.sampling import hash_rank, stratified_split
from riskloom.plans.features import build_features, fixture_tables
from riskloom.sources.fixtures import load_fixture


def test_block_join_keeps_rows(spark):
    t = fixture_tables(spark, SF_SMALL)
    app = B.application_features(t["application"])
    wide = build_features(t)
    assert wide.count() == app.count()
    assert wide.select("SK_ID_CURR").distinct().count() == wide.count()


def test_active_closed_within_bureau(spark):
    blk = B.bureau_block(load_fixture(spark, SF_SMALL, "fx_bureau"), load_fixture(spark, SF_SMALL, "fx_bureau_balance"))
    bad = blk.where(F.coalesce("ACTIVE_AMT_CREDIT_SUM_SUM", F.lit(0.0)) + F.coalesce("CLOSED_AMT_CREDIT_SUM_SUM", F.lit(0.0))
                    > F.col("BURO_AMT_CREDIT_SUM_SUM") + 1e-6)
    assert bad.count() == 0


def test_conditional_equals_filter_join(spark):  # J3 as oracle of the one-pass form
    bureau = load_fixture(spark, SF_SMALL, "fx_bureau")
    spec = {"DAYS_CREDIT": ["min", "max", "mean", "var"], "AMT_CREDIT_SUM": ["max", "mean", "sum"],
            "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"]}
    feats = spec_features(bureau, spec)
    base = bureau.select("SK_ID_CURR").distinct()
    plain = join_subset_aggregate(base, bureau, "SK_ID_CURR", feats, "ACTIVE_", "CREDIT_ACTIVE = 'Active'")
    one = B.bureau_block(bureau, load_fixture(spark, SF_SMALL, "fx_bureau_balance")).select(
        "SK_ID_CURR", *[c for c in plain.columns if c != "SK_ID_CURR"])
    a = {r.SK_ID_CURR: r for r in plain.collect()}
    for r in one.collect():
        for c in plain.columns:
            x, y = r[c], a[r.SK_ID_CURR][c]
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (c, x, y)


def test_hash_rank_equals_row_number(spark):
    app = load_fixture(spark, SF_MID_OR_SMALL(), "fx_application")
    r = hash_rank(app, ["TARGET"], "SK_ID_CURR", 7)
    w = Window.partitionBy("TARGET").orderBy("_h", "SK_ID_CURR")
    brute = r.withColumn("_rn", F.row_number().over(w))
    assert brute.where(F.col("_rn") != F.col("_rank")).count() == 0
    s = stratified_split(app, "TARGET", 0.25, "SK_ID_CURR", 7)
    per = {(x.TARGET, x.is_test): x["count"] for x in s.groupBy("TARGET", "is_test").count().collect()}
    for t in (0, 1):
        n = per.get((t, True), 0) + per.get((t, False), 0)
        assert per.get((t, True), 0) == math.floor(n * 0.25 + 0.5)


def SF_MID_OR_SMALL():
    return SF_SMALL


def test_ordered_cumsum_matches_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v), int(c)) for g, v, c in zip(rng.integers(0, 3, 3000), rng.normal(size=3000), rng.integers(1, 5, 3000))]
    df = spark.createDataFrame(rows, "g int, v double, c long").dropDuplicates(["g", "v"])
    got = ordered_cumsum(df, "v", ["c"], ["g"], buckets=16)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("w", F.sum("c").over(w))
    j = got.join(want, ["g", "v"])
    assert j.count() == df.count()
    assert j.where(F.col("cum_c") != F.col("w")).count() == 0


def test_auc_and_sweep_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400) * 0.5 + 0.4 * y, 2)  # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    auc = auc_roc(df).first()["auc"]
    pos, neg = p[y == 1], p[y == 0]
    brute = (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))
    assert math.isclose(auc, brute, rel_tol=1e-12)
    sw = {round(r.threshold, 2): r for r in threshold_gain_sweep(df).collect()}
    for k in (0, 13, 35, 50, 64, 100):
        t = k / 100.0
        fp = int(np.sum((y == 0) & (p >= t)))
        fn = int(np.sum((y == 1) & (p < t)))
        assert sw[round(t, 2)].fp == fp and sw[round(t, 2)].fn == fn


def test_box_stats_match_pandas(spark):
    bureau = load_fixture(spark, SF_SMALL, "fx_bureau")
    got = {r.CREDIT_ACTIVE: r for r in box_stats(bureau, "AMT_CREDIT_SUM", ["CREDIT_ACTIVE"]).collect()}
    pdf = bureau.select("CREDIT_ACTIVE", "AMT_CREDIT_SUM").toPandas()
    for k, grp in pdf.groupby("CREDIT_ACTIVE"):
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert math.isclose(got[k][name], grp["AMT_CREDIT_SUM"].quantile(q), rel_tol=1e-12)


def test_waterfall_ends_at_total(spark):
    rows = [(1, f"f{i}", float((-1) ** i * (i + 1))) for i in range(12)] + [(2, "f0", 0.5)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, feature string, phi double")
    wf = waterfall_steps(df, 0.25, k=10).collect()
    last = max((r for r in wf if r.SK_ID_CURR == 1), key=lambda r: r.step)
    assert math.isclose(last.running, 0.25 + sum(r[2] for r in rows if r[0] == 1))
    assert len([r for r in wf if r.SK_ID_CURR == 1]) == 12  # base, rest, 10 bars
