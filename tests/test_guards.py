"""No caps: wide vocabularies, odd names and values, NULL and NaN rules; exact cardinality split, build-or-load reuse."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalar import parity_hash
from riskloom.operators.aggregate import discover_vocabulary, fill_rate
from riskloom.operators.clean import distinct_counts, split_columns_by_cardinality, transpose_client
from riskloom.operators.encode import category_share_long, one_hot
from riskloom.operators.impute import impute_simple
from riskloom.operators.metrics import auc_roc, log_loss, roc_points
from riskloom.operators.profile import box_stats
from riskloom.operators.sampling import kfold, random_split, sample_fraction, stratified_split
from riskloom.operators.stats import anova_table, chi2_contributions, chi2_grid, chi2_sf, chi2_table, f_sf, with_anova_p, with_chi2_p
from riskloom.session import scratch_path
from riskloom.sources.sinks import build_or_load


def test_1500_values(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), (F.col("id") % 1500).cast("string").alias("s"))
    assert len(discover_vocabulary(df, ["s"])["s"]) == 1500
    wide, names = one_hot(df, ["s"])
    assert len(names) == 1501 and len(wide.columns) == 1502
    long = category_share_long(df, "k", ["s"])
    assert long.count() == 1500 and math.isclose(long.agg(F.sum("share")).first()[0], 3.0)


def test_odd_names_and_values(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "it's"), (3, "nan"), (4, None)], "SK_ID_CURR int, c string")
    wide, names = one_hot(df, ["c"])
    assert len(set(names)) == len(names) == 4
    assert fill_rate(wide).count() == len(wide.columns)
    t = transpose_client(wide)
    assert t.count() == 4 * 4 and t.agg(F.sum("value")).first()[0] == 4
    assert {r["column"]: r.n_distinct for r in distinct_counts(spark.createDataFrame([(0.0,), (-0.0,)], "x double")).collect()} == {"x": 1}


def test_splits_are_independent(spark):
    df = spark.range(1, 20001).withColumnRenamed("id", "SK_ID_CURR")
    s = random_split(random_split(df, 0.25, seed=7, name="a"), 0.2, seed=9, name="b")
    both = s.where("a AND b").count()
    assert abs(both - 1000) < 150
    odd = spark.createDataFrame([(-5,), (5 * 10**15,), (None,)], "SK_ID_CURR long")
    assert odd.select(parity_hash("SK_ID_CURR", 1).alias("h")).where("h BETWEEN 0 AND 1152921504606846975").count() == 3
    neg = spark.range(-10000, 0).withColumnRenamed("id", "SK_ID_CURR")
    assert abs(sample_fraction(neg, 0.1).count() - 1000) < 150
    text = df.select(F.concat(F.lit("x"), "SK_ID_CURR").alias("SK_ID_CURR"))
    assert abs(sample_fraction(text, 0.1).count() - 2000) < 250


def test_null_label_and_group_stay(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, float("nan") if i == 5 else float(i)) for i in range(30)],
                               "SK_ID_CURR int, TARGET int, x double")
    assert stratified_split(df, "TARGET", 0.5).count() == 30 == kfold(df, 3, label="TARGET").count()
    per = {r.TARGET: r.n for r in box_stats(df, "x", ["TARGET"]).collect()}
    assert per[None] == 10 and sum(per.values()) == 29


def test_edges_give_null(spark):
    one = spark.createDataFrame([(1, 0.2, "a"), (1, 0.7, "a")], "y int, p double, g string")
    assert auc_roc(one).first()["auc"] is None
    assert all(r.fpr is None for r in roc_points(one).collect())
    assert anova_table(one, "p", "g").first()["f_stat"] is None
    assert chi2_table(one, "y", "g").first()["chi2"] is None
    indep = spark.createDataFrame([(a, b) for a in "xy" for b in "uv" for _ in range(5)], "a string, b string")
    assert all(r.share is None for r in chi2_contributions(indep, "a", "b").collect())
    assert all(r.share is None for r in chi2_grid(indep, "a", "b").collect())
    sure = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0), (0, 0.5)], "y int, p double")
    got = log_loss(sure).first()["log_loss_sum"]
    want = -2 * math.log(1e-15) - math.log(1 - 1e-15) + math.log(2)
    assert math.isclose(got, want, rel_tol=1e-2)


def test_nan_is_missing_and_means_stay_whole(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (2, 2, 1.0), (3, 4, None), (4, None, 4.0)], "i int, k long, x double")
    assert {r["column"]: r.fill_rate for r in fill_rate(df, ["x"]).collect()} == {"x": 0.5}
    mean = {r.i: r for r in impute_simple(df, ["k", "x"], "mean").collect()}
    assert math.isclose(mean[4].k, 7 / 3) and mean[1].x == 2.5 == mean[3].x
    med = {r.i: r for r in impute_simple(df, ["k", "x"], "median").collect()}
    assert med[4].k == 2.0 and med[1].x == 2.5
    freq = {r.i: r for r in impute_simple(df, ["x"], "most_frequent").collect()}
    assert freq[1].x == 1.0


def test_chi2_without_a_grid(spark):
    rows = [("a", "u")] * 9 + [("a", "v")] * 3 + [("b", "v")] * 8
    r = with_chi2_p(chi2_table(spark.createDataFrame(rows, "x string, y string"), "x", "y")).first()
    e = {("a", "u"): 12 * 9 / 20, ("a", "v"): 12 * 11 / 20, ("b", "u"): 8 * 9 / 20, ("b", "v"): 8 * 11 / 20}
    o = {("a", "u"): 9, ("a", "v"): 3, ("b", "u"): 0, ("b", "v"): 8}
    want = sum((abs(o[c] - e[c]) - 0.5) ** 2 / e[c] for c in e)
    assert math.isclose(r.chi2, want, rel_tol=1e-12) and r.dof == 1
    assert math.isclose(r.p, math.erfc(math.sqrt(want / 2)), rel_tol=1e-9)


@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (135.806723, 100, 0.01)])
def test_chi2_tail_table(x, dof, p):
    assert math.isclose(chi2_sf(x, dof), p, rel_tol=1e-5)


@pytest.mark.parametrize("f, d1, d2, p", [(4.9646, 1, 10, 0.05), (3.3258, 5, 10, 0.05), (2.0391, 30, 20, 0.05)])
def test_f_tail_table(f, d1, d2, p):
    assert math.isclose(f_sf(f, d1, d2), p, rel_tol=1e-3)


@pytest.mark.parametrize("f, d2", [(0.3, 5), (1.7, 12), (9.0, 40), (2.5, 1000)])
def test_f_tail_closed_form(f, d2):  # two numerator degrees of freedom
    assert math.isclose(f_sf(f, 2, d2), (1 + 2 * f / d2) ** (-d2 / 2), rel_tol=1e-9)


def test_anova_p(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 8.0), ("b", 9.0)], "g string, v double")
    r = with_anova_p(anova_table(df, "v", "g")).first()
    assert math.isclose(r.f_stat, 98.0) and math.isclose(r.p, f_sf(98.0, 1, 2)) and r.p < 0.02


def test_cardinality_split_exact(spark):
    rows = [(i % 2, 7, float(i % 3), None if i % 4 == 0 else "x", float("nan") if i == 3 else float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, c double, d string, e double")
    kinds = {r.column: r.kind for r in split_columns_by_cardinality(df).collect()}
    assert kinds == {"a": "categorical", "b": "categorical", "c": "numeric", "d": "categorical", "e": "categorical"}
    pdf = df.toPandas()
    for c, k in kinds.items():
        assert (pdf[c].nunique() <= 2) == (k == "categorical")


def test_build_or_load_builds_once(spark):
    path = scratch_path(spark, f"bol-{uuid.uuid4().hex}")
    calls = []

    def build():
        calls.append(1)
        return spark.range(0, 10)

    assert build_or_load(spark, path, build).count() == 10
    assert build_or_load(spark, path, build).count() == 10
    assert len(calls) == 1


def test_sampling_methods(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "SK_ID_CURR")
    h = sample_fraction(df, 0.2, seed=1).count()
    b = sample_fraction(df, 0.2, seed=1, method="bernoulli").count()
    assert abs(h - 4000) < 300 and abs(b - 4000) < 300
    assert sample_fraction(df, 0.2, seed=1).count() == h  # hash form: same rows every run
