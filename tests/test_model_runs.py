"""Attributions from a compressed background, folds on shared bins, successive halving, the stream's ledger."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.feature import Imputer
from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import model as M
from riskloom.streaming import score_stream as SS


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4))
    x[:, 3] = rng.integers(0, 3, 900)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * x[:, 3] + rng.normal(size=900) * 0.4 > 0.5).astype(int)
    rows = [(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, b double, c double, d double").repartition(4).persist()


FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def model(loans):
    return M.train_classifier(loans, FEATS, maxIter=6, maxDepth=3, stepSize=0.3, seed=1)


def test_training_sketches_its_columns_once(loans, monkeypatch):
    """The medians also tell which columns are empty; the imputer only takes them over."""
    seen, fit = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    k = F.col("SK_ID_CURR")
    gaps = loans.withColumn("a", F.when(k % 3 > 0, F.col("a"))).withColumn("b", F.when(k % 5 == 0, math.nan).otherwise(F.col("b"))).withColumn(
        "none", F.lit(None).cast("double"))
    with pytest.warns(UserWarning, match="without values are left out: none"):
        found = M.train_classifier(gaps, [*FEATS, "none"], maxIter=1, maxDepth=2)
    assert seen == [1] and M.model_features(found) == FEATS
    want = Imputer(strategy="median", inputCols=FEATS, outputCols=[f"{f}_" for f in FEATS]).fit(gaps).surrogateDF.first()
    assert found.stages[0].surrogateDF.first() == want


def margin(x, trees, weights):
    out = 0.0
    for leaves, w in zip(trees, weights, strict=True):
        out += sum(w * v for v, bounds in leaves if all(lo < x[j] <= hi for j, (lo, hi) in bounds.items()))
    return out


def pair_shapley(x, z, trees, weights):
    """Shapley values over all subsets of features, scaled to the pair's probabilities."""
    p = len(x)
    f = lambda keep: margin([x[j] if j in keep else z[j] for j in range(p)], trees, weights)
    value = {s: f(s) for k in range(p + 1) for s in combinations(range(p), k)}
    phi = np.zeros(p)
    for j in range(p):
        for s in value:
            if j not in s:
                w = math.factorial(len(s)) * math.factorial(p - len(s) - 1) / math.factorial(p)
                phi[j] += w * (value[tuple(sorted((*s, j)))] - value[s])
    fx, fz = value[tuple(range(p))], value[()]
    prob = lambda m: 1 / (1 + math.exp(-2 * m))
    return phi * ((prob(fx) - prob(fz)) / (fx - fz) if abs(fx - fz) > 1e-9 else 2 * prob(fx) * (1 - prob(fx)))


def test_attributions_are_those_of_all_subsets(spark, loans, model):
    rows, background = loans.where("SK_ID_CURR < 12"), loans.where("SK_ID_CURR >= 860")
    got = X.tree_attribution(model.stages[-1], M.imputed_rows(model, rows), M.imputed_rows(model, background), [f"{f}__imp" for f in FEATS], names=FEATS)
    phi = {(r.SK_ID_CURR, r.feature): r.phi for r in got.collect()}
    trees, weights = X._tree_tables(model.stages[-1])
    z = [[r[f] for f in FEATS] for r in background.collect()]
    for r in rows.collect():
        want = np.mean([pair_shapley([r[f] for f in FEATS], b, trees, weights) for b in z], axis=0)
        assert np.allclose([phi[r.SK_ID_CURR, f] for f in FEATS], want, atol=1e-9)


def test_attributions_add_up_over_any_background(spark, loans, model):
    background = M.imputed_rows(model, loans)
    leaves = X._leaves(*X._tree_tables(model.stages[-1]))
    many = X.compress_background(leaves, background.drop("SK_ID_CURR"))
    few = X.compress_background(leaves, background.drop("SK_ID_CURR").limit(50))
    size = lambda b: sum(len(m) for m, _ in b.groups)
    assert many.n == 900 and size(many) <= sum(2 ** len(x.features) for x in leaves) and size(many) < 3 * size(few)  # the model's size, not the rows'
    long = X.tree_attribution(model.stages[-1], background, background, [f"{f}__imp" for f in FEATS], names=FEATS)
    scores = M.batch_score(model, loans)
    base = scores.agg(F.avg("probability_1")).first()[0]
    assert math.isclose(base, many.base, abs_tol=1e-12)
    worst = X.additivity_check(long, scores, base, prob="probability_1").agg(F.max(F.abs("gap"))).first()[0]
    assert worst < 1e-10
    with pytest.raises(ValueError, match="empty"):
        X.compress_background(leaves, background.drop("SK_ID_CURR").limit(0))


@pytest.mark.parametrize(("low", "high"), [(-0.1, 0.1), (-3.0, 4.0), (-15.0, 12.0), (0.7, 0.7)])
def test_slopes_are_interpolated_to_rounding(low, high):
    nodes = X._nodes(low, high)
    z, x = np.linspace(low, high, 301), np.linspace(low - 1, high + 1, 67)
    exact = X._slopes(x, z)
    assert np.allclose(X._slopes(x, nodes) @ X._basis(z, nodes).T, exact, atol=1e-11)
    assert np.allclose(X._basis(nodes, nodes), np.eye(len(nodes)))


def test_folds_share_their_bins(spark, loans):
    df = loans.withColumn("empty", F.lit(None).cast("double")).withColumn("b", F.when(F.col("SK_ID_CURR") % 7 == 0, float("nan")).otherwise(F.col("b")))
    oof, aucs, imps = M.cross_validate_oof(df, [*FEATS, "empty"], k=4, maxIter=5, maxDepth=3, pos_weight=1.5)
    assert oof.count() == 900 == oof.select("SK_ID_CURR").distinct().count()
    told = {r.fold: r.auc for r in aucs.collect()}
    assert sorted(told) == [0, 1, 2, 3] and all(a > 0.75 for a in told.values())
    got = imps.collect()
    assert len(got) == 20 and all(r.importance == 0 for r in got if r.feature == "empty")
    again, _, _ = M.cross_validate_oof(df, [*FEATS, "empty"], k=4, maxIter=5, maxDepth=3, pos_weight=1.5, parallelism=1)
    assert {tuple(r) for r in oof.collect()} == {tuple(r) for r in again.collect()}  # concurrent folds are the same folds


def test_bins_keep_the_order(spark, loans):
    data, used = M.binned(loans, ["a", "d"], ["SK_ID_CURR"], bins=8)
    rows = sorted((r.a, r.features[0]) for r in loans.join(data, "SK_ID_CURR").selectExpr("a", "features").collect())
    codes = [c for _, c in rows]
    assert used == ["a", "d"] and codes == sorted(codes) and len(set(codes)) == 8


def test_halving_keeps_the_better_half(spark, loans):
    space = {"stepSize": [0.05, 0.3], "maxDepth": [1, 3], "maxIter": [2, 4]}
    best, table = M.random_search(loans, FEATS, n_iter=5, k=3, space=space, seed=2, rungs=3)
    rungs = {}
    for r in table.collect():
        rungs.setdefault(r.rung, {})[r.draw] = r
    assert [len(rungs[k]) for k in range(3)] == [5, 3, 2]
    for k in (0, 1):
        order = sorted(rungs[k], key=lambda d: (-rungs[k][d].mean_auc, d))
        assert set(rungs[k + 1]) == set(order[: len(rungs[k + 1])])
        assert rungs[k][order[0]].rows < rungs[k + 1][order[0]].rows
    last = rungs[2]
    assert last[min(last, key=lambda d: (-last[d].mean_auc, d))].params == str(best) and {r.rows for r in last.values()} == {900}


def test_a_replayed_batch_replaces_its_scores(spark, loans, model, tmp_path, monkeypatch):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    rows = loans.drop("TARGET")
    rows.where("SK_ID_CURR < 500").coalesce(1).write.parquet(src)
    schema = rows.schema
    with monkeypatch.context() as m:
        def stop(*_):
            raise RuntimeError("stopped between the scores and the ledger")

        m.setattr(SS, "enter", stop)
        with pytest.raises(Exception, match="stopped between"):
            SS.stream_score(spark, model, src, out, ckpt, schema)
    assert spark.read.parquet(f"{out}/scores").count() == 500 and SS.read_scores(spark, out).count() == 0  # written, not entered
    got = SS.stream_score(spark, model, src, out, ckpt, schema)
    want = {tuple(r) for r in M.batch_score(model, rows.where("SK_ID_CURR < 500")).collect()}
    assert got.count() == 500 and {tuple(r) for r in got.collect()} == want
    rows.where("SK_ID_CURR >= 400").withColumn("a", F.col("a") + 1).coalesce(1).write.mode("append").parquet(src)
    SS.stream_score(spark, model, src, out, ckpt, schema)
    scores = SS.read_scores(spark, out)
    assert scores.count() == 1000 and [r.rows for r in SS.read_ledger(spark, out).orderBy("batch_id").collect()] == [500, 500]
    newest = {r.SK_ID_CURR: r.batch_id for r in SS.newest_scores(scores).collect()}
    assert len(newest) == 900 and newest[399] == 0 and newest[400] == 1
