"""Model on the embeddings table (64 numbers, label == 3 as target), attributions, stream scoring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from riskloom.operators import explain as X
from riskloom.operators import model as M
from riskloom.operators.metrics import auc_roc
from riskloom.operators.sampling import sample_n
from riskloom.session import scratch_path
from riskloom.streaming.score_stream import stream_score

FEATS = [f"e{i}" for i in range(64)]


@pytest.fixture(scope="module")
def emb(spark):
    t = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("SK_ID_CURR"), (F.col("label") == 3).cast("int").alias("TARGET"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@pytest.fixture(scope="module")
def fitted(emb):
    return M.train_classifier(emb, FEATS, "TARGET", pos_weight=M.class_weight(emb), seed=1, maxIter=5, maxDepth=3)


def test_model_learns(fitted, emb):
    s = M.batch_score(fitted, emb, keep=["TARGET"])
    assert auc_roc(s, "TARGET", "probability_1").first()["auc"] > 0.7
    imp = M.feature_importance(fitted, FEATS)
    assert math.isclose(sum(r.importance for r in imp.collect()), 1.0, rel_tol=1e-6)


def test_tree_attribution_additive(spark, fitted, emb):
    imputer = fitted.stages[0]
    cols = imputer.getOutputCols()
    rows = imputer.transform(emb.limit(40))
    bg = imputer.transform(sample_n(emb, 1000, "SK_ID_CURR", 0))
    long = X.tree_attribution(fitted.stages[-1], rows.select("SK_ID_CURR", *cols), bg.select(*cols), cols)
    sums = {r.SK_ID_CURR: r.s for r in long.groupBy("SK_ID_CURR").agg(F.sum("phi").alias("s")).collect()}
    p = {r.SK_ID_CURR: r.probability_1 for r in M.batch_score(fitted, emb.limit(40)).collect()}
    base = np.mean([r.probability_1 for r in M.batch_score(fitted, sample_n(emb, 1000, "SK_ID_CURR", 0)).collect()])
    for k, s in sums.items():
        assert abs(base + s - p[k]) < 1e-6


def test_stream_equals_batch(spark, fitted, emb):
    run = scratch_path(spark, "test-stream")
    import uuid

    run = f"{run}-{uuid.uuid4().hex}"
    emb.write.parquet(f"{run}/in")
    out = stream_score(spark, fitted, f"{run}/in", f"{run}/out", f"{run}/ckpt", spark.read.parquet(f"{run}/in").schema)
    batch = {r.SK_ID_CURR: r.probability_1 for r in M.batch_score(fitted, emb).collect()}
    got = {r.SK_ID_CURR: r.probability_1 for r in out.collect()}
    assert got.keys() == batch.keys()
    assert all(abs(got[k] - batch[k]) < 1e-12 for k in got)
