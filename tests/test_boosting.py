"""The search on all rows: trees grown side by side against Spark's own, thresholds of rare values, draws that Spark fits."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.operators import boosting as B
from riskloom.operators import model as M
from riskloom.plans import catalog_model as CM

FEATS = ["a", "b", "c", "d", "one"]


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4))
    x[:, 3] = rng.integers(0, 3, 1500)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * x[:, 3] + rng.normal(size=1500) * 0.4 > 0.5).astype(int)
    rows = [(i, int(t), *map(float, v), 1.0) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, b double, c double, d double, one double")
    return df.withColumn("b", F.when(F.col("SK_ID_CURR") % 7 > 0, F.col("b"))).repartition(4).persist()


@pytest.mark.parametrize("weight", [None, 1.7])
def test_the_search_scores_as_spark_s_trees(spark, loans, weight):
    space = {"stepSize": [0.05, 0.3], "maxDepth": [1, 3], "maxIter": [2, 4]}
    best, table = M.random_search(loans, FEATS, n_iter=4, k=3, space=space, seed=2, pos_weight=weight)
    rows = {r.draw: r for r in table.collect()}
    folded, keep = M._folds(loans, "TARGET", 3, "SK_ID_CURR", 2, True, weight)
    data, _ = M.binned(folded, FEATS, keep)
    judge = BinaryClassificationEvaluator(labelCol="TARGET", numBins=0)
    held = F.col("fold")
    for r in rows.values():
        gbt = M._trees("TARGET", 2, weight is not None, M.BINS, eval(r.params))
        want = [judge.evaluate(gbt.fit(data.where(held != f)).transform(data.where(held == f))) for f in range(3)]
        assert r.mean_auc == pytest.approx(np.mean(want), abs=1e-9)
    assert sorted(rows) == [0, 1, 2, 3] and {(r.rung, r.share, r.rows) for r in rows.values()} == {(0, 1.0, 1500)}
    assert rows[min(rows, key=lambda d: (-rows[d].mean_auc, d))].params == str(best)


def test_the_query_trains_every_draw_on_all_rows(spark, loans, monkeypatch):
    monkeypatch.setattr(CM, "features", lambda *_: loans.withColumn("TARGET", F.col("TARGET").cast("long")))
    got = CM.q_random_search(spark, "").collect()
    assert sorted(r.draw for r in got) == list(range(8)) and {(r.share, r.rows) for r in got} == {(1.0, 1500)}


def test_thresholds_come_from_all_rows(spark):
    """Ten rows of 200,000 tell the label; a sample of 10,000 rows holds none of them as a rule."""
    i = F.col("SK_ID_CURR")
    df = spark.range(200_000).toDF("SK_ID_CURR").select("SK_ID_CURR", (i % 20_000 == 7).cast("int").alias("TARGET"), (i % 20_000 == 7).cast("double").alias("rare"),
                                                        (i * 37 % 101).cast("double").alias("dull"))
    _, table = M.random_search(df, ["dull", "rare"], n_iter=1, k=5, space={"maxDepth": [1], "maxIter": [1], "stepSize": [0.1]})
    assert table.first().mean_auc == 1.0


def test_draws_that_sample_are_fitted_by_spark(spark, loans):
    space = {"stepSize": [0.3], "maxDepth": [2], "maxIter": [2], "subsamplingRate": [0.7, 1.0]}
    _, table = M.random_search(loans, FEATS, n_iter=4, k=2, space=space, seed=1)
    auc = {}
    for r in table.collect():
        auc.setdefault(eval(r.params)["subsamplingRate"], set()).add(r.mean_auc)
    assert set(auc) == {0.7, 1.0} and len(auc[1.0]) == 1 and all(a > 0.7 for x in auc.values() for a in x)
    assert M._setting({"maxDepth": 2, "subsamplingRate": 0.7}, None) is None and M._setting({"minInfoGain": 0.1}, None) is None
    assert M._setting({"maxDepth": 3, "stepSize": 0.2, "maxIter": 7}, None) == B.Setting(3, 0.2, 7)


def test_a_level_may_take_several_passes(spark, loans, monkeypatch):
    folded, keep = M._folds(loans, "TARGET", 2, "SK_ID_CURR", 1, True, None)
    made = M._bins(folded, FEATS, keep, 8)
    data, sizes = B.rows_of(M._packed(made, keep, "uint8"), "TARGET", None), [len(e) + 1 for e in made.edges]
    settings = [B.Setting(3, 0.1, 3), B.Setting(2, 0.2, 2)]
    whole = B.grow(data, sizes, "uint8", settings, 2)
    monkeypatch.setattr(B, "CELLS", 3 * sum(sizes))
    monkeypatch.setattr(B, "CHUNK_ROWS", 64)
    cut = B.grow(data, sizes, "uint8", settings, 2)
    assert whole.keys() == cut.keys() and len(whole) == 2 * (3 + 2)
    for key, tree in whole.items():
        assert (tree.feature == cut[key].feature).all() and (tree.code == cut[key].code).all() and np.allclose(tree.value, cut[key].value, atol=1e-12)


def test_labels_other_than_0_and_1_are_an_error(spark, loans):
    with pytest.raises(ValueError, match="must be 0 or 1"):
        M.random_search(loans.withColumn("TARGET", F.col("TARGET") + 1), FEATS, n_iter=1, k=2, space={"maxDepth": [1], "maxIter": [1]})
