"""End-to-end lifecycle on the smallest tables: build, prune, split, train, evaluate, explain."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.plans import pipeline as PL
from riskloom.plans.features import fixture_tables


def test_lifecycle(spark):
    import uuid

    tables = fixture_tables(spark, SF_SMALL)
    data, dropped = PL.create_datasets(spark, tables, name=f"t-{uuid.uuid4().hex}", sample_fraction=None)
    assert "SK_ID_CURR" in data.columns and all(c not in data.columns for c in dropped)
    train, test = PL.prepare_data(data, test_fraction=0.25, seed=3)
    assert train.join(test, "SK_ID_CURR", "inner").count() == 0
    run = PL.run_model(train, test, maxIter=4, maxDepth=3)
    assert 0.0 <= run.auc <= 1.0 and sum(run.confusion.values()) == test.count()
    base, long = PL.explain_scores(run, train, test.limit(10), background_n=20)
    sums = {r.SK_ID_CURR: r.s for r in long.groupBy("SK_ID_CURR").agg(F.sum("phi").alias("s")).collect()}
    p = {r.SK_ID_CURR: r.probability_1 for r in run.scores.collect()}
    for k, s in sums.items():
        assert math.isclose(base + s, p[k], abs_tol=1e-6)


def test_settings_have_their_own_tables(spark):
    import uuid

    tables, name = fixture_tables(spark, SF_SMALL), f"t-{uuid.uuid4().hex}"
    _, many = PL.create_datasets(spark, tables, name=name, threshold=0.8, sample_fraction=None)
    _, few = PL.create_datasets(spark, tables, name=name, threshold=0.999, sample_fraction=None)
    _, again = PL.create_datasets(spark, tables, name=name, threshold=0.8, sample_fraction=None)
    assert set(few) < set(many) and many == again


def test_odd_feature_names_train_and_explain(spark):
    rows = [(i, i % 2, "a.b" if i % 2 else "it's", "nan" if i % 5 else None, float(i % 7), None) for i in range(200)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, c string, d string, x double, empty double")
    from riskloom.operators.encode import one_hot

    wide, _ = one_hot(df, ["c", "d"])
    train, test = PL.prepare_data(wide, test_fraction=0.25, seed=3)
    run = PL.run_model(train, test, maxIter=3, maxDepth=2)
    base, long = PL.explain_scores(run, train, test, background_n=30)
    assert run.auc == 1.0 and {"c_a.b", "c_it's", "d_nan", "d_nan_text"} <= {r.feature for r in long.select("feature").distinct().collect()}
    sums = {r.SK_ID_CURR: r.s for r in long.groupBy("SK_ID_CURR").agg(F.sum("phi").alias("s")).collect()}
    p = {r.SK_ID_CURR: r.probability_1 for r in run.scores.collect()}
    assert all(math.isclose(base + s, p[k], abs_tol=1e-6) for k, s in sums.items())
