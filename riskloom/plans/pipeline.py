"""End-to-end batch lifecycle composed from the operators.

``create_datasets``   feature row -> correlation pruning on a hash sample -> table in the shared folder
``prepare_data``      feature selection, stratified test split, optional export of the test clients' rows
``run_model``         class-weighted boosted trees with a separate validation flag, metrics, importances
``explain_scores``    base value over a background sample and per-client tree attributions

Every intermediate that later stages read more than once is written to the shared checkpoint folder
(``build_or_load``), which cuts the lineage: a lost executor recomputes from that table, not from the
raw history tables.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import metrics as M
from riskloom.operators import model as ML
from riskloom.operators import sampling as G
from riskloom.operators.stats import prune_correlated
from riskloom.plans.features import build_features
from riskloom.session import scratch_path
from riskloom.sources import sinks as S
from riskloom.sources.manifest import manifest

ID = "SK_ID_CURR"
LABEL = "TARGET"


def create_datasets(spark: SparkSession, tables: Mapping[str, DataFrame], name: str = "dataset",
                    threshold: float = 0.8, sample_fraction: float | None = 0.25, rebuild: bool = False,
                    vocab=None) -> tuple[DataFrame, list[str]]:
    """Feature row materialised once, correlated columns dropped (decided on a hash sample).

    Both tables are known by a manifest of the input files (path, length, time), the plans over them and the settings: another data folder, a
    changed file or other settings never read an old table. Returns the pruned table and the names of the dropped columns.
    """
    settings = {"vocab": {t: {c: list(x) for c, x in v.items()} for t, v in (vocab or {}).items()}}
    made = manifest(spark, tables, settings)
    full = S.build_or_load(spark, scratch_path(spark, f"{name}-features"), lambda: build_features(tables, vocab), rebuild, made)
    pruned = replace(made, settings=json.dumps(settings | {"threshold": threshold, "sample_fraction": sample_fraction}, sort_keys=True))
    cleaned = S.build_or_load(spark, scratch_path(spark, f"{name}-cleaned"),
                              lambda: prune_correlated(full, threshold, sample_fraction, protect=(ID,), id_col=ID)[0], rebuild, pruned)
    return cleaned, sorted(set(full.columns) - set(cleaned.columns))


def prepare_data(df: DataFrame, features: Sequence[str] | None = None, test_fraction: float = 0.05, seed: int = 0,
                 tables: Mapping[str, DataFrame] | None = None, export_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the listed features (all but id and label by default), stratified by label."""
    feats = list(features) if features is not None else [c for c in df.columns if c not in (ID, LABEL)]
    split = G.stratified_split(df.select(ID, LABEL, *[F.col(f"`{c}`") for c in feats]), LABEL, test_fraction, ID, seed)
    test = split.where("is_test").drop("is_test")
    train = split.where(~F.col("is_test")).drop("is_test")
    if tables is not None and export_dir is not None:
        S.export_client_sample(tables, test.select(ID), export_dir)
    return train, test


@dataclass
class ModelRun:
    model: PipelineModel
    features: list[str]
    scores: DataFrame          # test rows: id, label, prediction, probability_1
    auc: float
    confusion: dict
    report: DataFrame
    importances: DataFrame
    mean_probability: float


def run_model(train: DataFrame, test: DataFrame, features: Sequence[str] | None = None, validation_fraction: float = 0.2,
              seed: int = 0, model_path: str | None = None, **params) -> ModelRun:
    """Fit on the training rows (early stopping on a validation flag inside them, never on the test
    rows), then evaluate on the test rows."""
    feats = list(features) if features is not None else [c for c in train.columns if c not in (ID, LABEL)]
    tr = G.random_split(train, validation_fraction, ID, seed + 1, name="is_valid")
    model = ML.train_classifier(tr, feats, LABEL, pos_weight=ML.class_weight(train, LABEL), validation_col="is_valid",
                                seed=seed, **params)
    scores = ML.batch_score(model, test, ID, keep=[LABEL])
    auc = M.auc_roc(scores, LABEL, "probability_1").first()["auc"]
    conf = M.confusion_matrix(scores.withColumn("p", F.col("probability_1")), LABEL, "p", 0.5).first().asDict()
    rep = M.classification_report(scores, LABEL, "prediction")
    mean_p = M.mean_prediction(scores, LABEL, "probability_1").first()["mean_probability"]
    if model_path:
        S.persist_model(model, model_path)
    return ModelRun(model, feats, scores, auc, conf, rep, ML.feature_importance(model, feats), mean_p)


def explain_scores(run: ModelRun, train: DataFrame, rows: DataFrame, background_n: int = 10_000, seed: int = 0,
                   out_path: str | None = None) -> tuple[float, DataFrame]:
    """(base value, long attributions) for ``rows``; background = ``background_n`` hash-sampled
    training rows, in the model's imputed feature space."""
    drawn = G.sample_n(train, background_n, ID, seed)
    base = ML.batch_score(run.model, drawn, ID).agg(F.avg("probability_1")).first()[0]
    bg, x = ML.imputed_rows(run.model, drawn, ID), ML.imputed_rows(run.model, rows, ID)
    long = X.tree_attribution(run.model.stages[-1], x, bg, [c for c in x.columns if c != ID], ID, names=ML.model_features(run.model))
    if out_path:
        S.persist_attributions(long, base, out_path)
    return base, long
