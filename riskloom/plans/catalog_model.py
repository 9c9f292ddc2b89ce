"""Model, explanation, streaming and sink queries.

Most results depend on a trained model, so the driver checks them by rows only. The model is fitted once per
session and data folder and reused. Numbers of trees, folds, draws and background rows are the queries' arguments; the operators set no
upper limit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.report import report
from riskloom.operators import explain as X
from riskloom.operators import impute as I
from riskloom.operators import model as M
from riskloom.operators import sampling as G
from riskloom.plans import catalog as C
from riskloom.plans import registry as R
from riskloom.plans.catalog import app, features
from riskloom.plans.features import fixture_tables
from riskloom.plans.registry import register
from riskloom.session import scratch_path, written
from riskloom.sources import sinks as S
from riskloom.sources.manifest import manifest
from riskloom.streaming.score_stream import stream_score

LABEL = "TARGET"
ID = "SK_ID_CURR"
MODEL_PARAMS = {"maxIter": 12, "maxDepth": 4, "stepSize": 0.1}
BACKGROUND = 10_000  # rows, as in the source
_CACHE: dict = {}


def model_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in (ID, LABEL)
            and f.dataType.typeName() in ("double", "integer", "long", "float")]


def split_features(spark: SparkSession, d: str) -> DataFrame:
    """Features with a stratified test flag and, inside the training rows, a validation flag."""
    f = features(spark, d)
    s = G.stratified_split(f, LABEL, 0.25, ID, 7)
    return G.random_split(s, 0.2, ID, 9, name="is_valid").withColumn("is_valid", F.col("is_valid") & ~F.col("is_test"))


def trained(spark: SparkSession, d: str):
    key = (spark.sparkContext.applicationId, d)  # a new context never reuses a cached model
    if key not in _CACHE:
        # read by the weight count, the imputer fit, the trees and the scoring queries: written once
        s = written(split_features(spark, d), "split-features")
        feats = model_features(s.drop("is_test", "is_valid"))
        train = s.where(~F.col("is_test"))
        w = M.class_weight(train, LABEL)
        model = M.train_classifier(train, feats, LABEL, pos_weight=w, validation_col="is_valid", seed=42, **MODEL_PARAMS)
        _CACHE[key] = (model, s, feats)
    return _CACHE[key]


@register("train_classifier")
def q_train_classifier(spark, d):
    """M1 (+ M11 on the held-out rows): scores of the test clients."""
    model, s, _ = trained(spark, d)
    return report(M.batch_score(model, s.where("is_test"), ID, keep=[LABEL]))


@register("batch_score")
def q_batch_score(spark, d):
    """Every client scored."""
    model, s, _ = trained(spark, d)
    return report(M.batch_score(model, s, ID))


@register("feature_importance")
def q_feature_importance(spark, d):
    """M4."""
    model, _, feats = trained(spark, d)
    return report(M.feature_importance(model, feats))


@register("cross_validate_oof")
def q_cross_validate_oof(spark, d):
    """M2: out-of-fold scores of a 5-fold stratified run with the AUC of each row's fold; 5 trees a fold."""
    f = written(features(spark, d), "features")
    feats = model_features(f)
    oof, aucs, _ = M.cross_validate_oof(f, feats, LABEL, k=5, id_col=ID, seed=1001, maxIter=5, maxDepth=3, stepSize=0.1)
    return report(oof.join(aucs.withColumnRenamed("auc", "fold_auc"), "fold"))


@register("random_search")
def q_random_search(spark, d):
    """M3: eight seeded draws over the whole feature row, five stratified folds each, every draw on all rows."""
    f = written(features(spark, d), "features")
    feats = model_features(f)
    space = {"stepSize": [0.05, 0.1, 0.2], "maxDepth": [2, 3, 4], "maxIter": [3, 5]}
    _, table = M.random_search(f, feats, LABEL, n_iter=8, k=5, space=space, id_col=ID, seed=3, parallelism=8, rungs=1)
    return report(table)


@register("tree_attribution")
def q_tree_attribution(spark, d):
    """Interventional attributions of the test clients against a background of ``BACKGROUND`` training rows."""
    model, s, _ = trained(spark, d)
    # the trees see median-imputed values: explain in that space
    rows = M.imputed_rows(model, s.where("is_test"), ID)
    bg = M.imputed_rows(model, G.sample_n(s.where(~F.col("is_test")), BACKGROUND, ID, 0), ID)
    return report(X.tree_attribution(model.stages[-1], rows, bg, [c for c in rows.columns if c != ID], ID, names=M.model_features(model)))


@register("stream_score")
def q_stream_score(spark, d):
    """Test clients' feature rows written as files, scored by a file-source stream."""
    model, s, feats = trained(spark, d)
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    rows = s.where("is_test").select(ID, *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
    S.write_table(rows, f"{run}/in")
    schema = spark.read.parquet(f"{run}/in").schema
    out = stream_score(spark, model, f"{run}/in", f"{run}/out", f"{run}/ckpt", schema, ID)
    return report(out)


@register("impute_iterative")
def q_impute_iterative(spark, d):
    """Three rounds of regression imputation on all numeric columns of the application row."""
    return report(I.impute_regression(app(spark, d), rounds=3))


_MEAN = "coalesce({0}, (SELECT avg({0}) FROM app))"
_LINE = ("coalesce({0}, (SELECT regr_intercept({0}, {1}) FROM app) + (SELECT regr_slope({0}, {1}) FROM app) * {1}) AS {0}")


@register("impute_regression_round", C.sql(["fx_application"], C.rep(
    f"SELECT SK_ID_CURR, {_LINE.format('CNT_FAM_MEMBERS', _MEAN.format('DAYS_EMPLOYED'))}, {_LINE.format('DAYS_EMPLOYED', _MEAN.format('CNT_FAM_MEMBERS'))} FROM app",
    ["CNT_FAM_MEMBERS", "DAYS_EMPLOYED"], [ID]), C.APP_CTE))
def q_impute_regression_round(spark, d):
    """One round on two columns that both have gaps, each regressed on the other's means and values."""
    cols = ["CNT_FAM_MEMBERS", "DAYS_EMPLOYED"]
    return report(I.impute_regression(app(spark, d).select(ID, *cols), cols, rounds=1))


@register("impute_iterative_round", C.sql(["fx_application"], C.rep(
    "SELECT SK_ID_CURR, AMT_CREDIT, coalesce(CNT_FAM_MEMBERS, (SELECT regr_intercept(CNT_FAM_MEMBERS, AMT_CREDIT) FROM app) "
    "+ (SELECT regr_slope(CNT_FAM_MEMBERS, AMT_CREDIT) FROM app) * AMT_CREDIT) AS CNT_FAM_MEMBERS FROM app",
    ["AMT_CREDIT", "CNT_FAM_MEMBERS"], [ID]), C.APP_CTE))
def q_impute_iterative_round(spark, d):
    """One round on two columns, which SQL can express as a regression line."""
    cols = ["AMT_CREDIT", "CNT_FAM_MEMBERS"]
    return report(I.impute_iterative(app(spark, d).select(ID, *cols), cols, rounds=1, id_col=ID))


def _not_again() -> DataFrame:
    raise RuntimeError("the table is there and must not be built again")


@register("build_or_load", R.ORACLE["join_feature_blocks"])
def q_build_or_load(spark, d):
    """S5 (+ S4): the feature table materialised once in the shared folder under a manifest of its input files, then loaded by a second call."""
    path = scratch_path(spark, f"features-{uuid.uuid4().hex}")
    S.build_or_load(spark, path, lambda: features(spark, d), made=manifest(spark, fixture_tables(spark, d)))
    return report(S.build_or_load(spark, path, _not_again, made=manifest(spark, fixture_tables(spark, d))))


@register("write_scores")
def q_write_scores(spark, d):
    """Submission table (id, TARGET) written as CSV and read back."""
    model, s, _ = trained(spark, d)
    path = scratch_path(spark, f"scores-{uuid.uuid4().hex}")
    S.write_scores(M.batch_score(model, s.where("is_test"), ID), path)
    return report(spark.read.option("header", "true").schema(f"{ID} long, TARGET double").csv(path))


@register("persist_model")
def q_persist_model(spark, d):
    """Model saved with Spark ML persistence, loaded back, test clients rescored."""
    model, s, _ = trained(spark, d)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    S.persist_model(model, path)
    return report(M.batch_score(S.load_model(path), s.where("is_test"), ID))
