"""Model training, validation and scoring (M1-M4, M11) on Spark ML.

The boosted-tree classifier is Spark's ``GBTClassifier`` inside a ``Pipeline`` (median imputation, vector
assembly, trees), so a fitted model scores batches and streams alike. Class imbalance enters through a
weight column (positive rows weighted by the majority / minority ratio), early stopping through a
validation indicator column, folds through a hash-made fold column - all reproducible.
"""

from __future__ import annotations

import random
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalar import missing
from riskloom.operators import boosting
from riskloom.operators.boosting import MAX_DEPTH, Setting
from riskloom.operators.metrics import auc_roc
from riskloom.operators.ranking import union_folds
from riskloom.operators.sampling import kfold, sample_fraction
from riskloom.session import written

WEIGHT = "_weight"
VALID = "_is_valid"
# Quantile bins of a feature in cross-validation and search.
BINS = 32
# Relative error of the medians, as in Spark's Imputer.
ERROR = 0.001

# Default tree parameters (learning rate, depth for about 15 leaves, iterations capped).
DEFAULT_PARAMS = {"stepSize": 0.05, "maxDepth": 4, "maxIter": 50, "subsamplingRate": 1.0,
                  "featureSubsetStrategy": "all", "minInstancesPerNode": 1}


def _safe(f: str) -> str:
    """A name that Spark ML can look up: dots and backquotes are escaped; ``unquote`` gives the original."""
    return f.replace("%", "%25").replace(".", "%2E").replace("`", "%60")


def _imputed(f: str) -> str:
    return f"{f}__imp"


def model_features(model: PipelineModel) -> list[str]:
    """The original names of the features that a model takes."""
    return [unquote(c) for c in model.stages[0].getInputCols()]


def build_pipeline(features: Sequence[str], label: str = "TARGET", weighted: bool = False,
                   validation: bool = False, seed: int = 0, medians: DataFrame | None = None, **params) -> Pipeline:
    """Imputation, assembly, trees. With a row of ``medians`` (under the names that Spark ML looks up) nothing is left to find for the imputation."""
    feats = [_safe(f) for f in features]
    p = {**DEFAULT_PARAMS, **params}
    imputer = Imputer(inputCols=feats, outputCols=[_imputed(f) for f in feats], strategy="median")
    if medians is not None:
        imputer = imputer.fit(medians)
    assembler = VectorAssembler(inputCols=[_imputed(f) for f in feats], outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **p)
    if weighted:
        gbt.setWeightCol(WEIGHT)
    if validation:
        gbt.setValidationIndicatorCol(VALID)
    return Pipeline(stages=[imputer, assembler, gbt])


def _prepare(df: DataFrame, features: Sequence[str], label: str | None, pos_weight: float | None) -> DataFrame:
    cols = [F.col("`" + f.replace("`", "``") + "`").cast("double").alias(_safe(f)) for f in features]
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(features)], *cols)
    if label is not None:
        out = out.withColumn(label, F.col(label).cast("double"))
    if pos_weight is not None:
        out = out.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
    return out


def class_weight(df: DataFrame, label: str = "TARGET") -> float:
    """Majority / minority count ratio (A13), used as the positive-class weight."""
    r = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, n = int(r["pos"] or 0), int(r["n"] or 0)
    return (n - pos) / pos if pos else 1.0


def train_classifier(df: DataFrame, features: Sequence[str], label: str = "TARGET", pos_weight: float | None = None,
                     validation_col: str | None = None, seed: int = 0, **params) -> PipelineModel:
    """M1: fit imputation + boosted trees. ``validation_col`` (boolean) marks rows used only for early
    stopping (``validationTol``), kept apart from any test rows. Columns without any value are left out, with a warning."""
    data = _prepare(df, features, label, pos_weight)
    found = data.approxQuantile([_safe(f) for f in features], [0.5], ERROR)  # empty for a column without values
    empty = [f for f, q in zip(features, found, strict=True) if not q]
    if empty:
        warnings.warn(f"columns without values are left out: {', '.join(empty)}", stacklevel=2)
    known = {f: q[0] for f, q in zip(features, found, strict=True) if q}
    medians = df.sparkSession.createDataFrame([tuple(known.values())], T.StructType([T.StructField(_safe(f), T.DoubleType()) for f in known]))
    if validation_col:
        data = data.withColumn(VALID, F.col(validation_col).cast("boolean"))
    pipe = build_pipeline(list(known), label, pos_weight is not None, validation_col is not None, seed, medians, **params)
    return pipe.fit(data)


def batch_score(model: PipelineModel, df: DataFrame, id_col: str = "SK_ID_CURR", keep: Sequence[str] = ()) -> DataFrame:
    """(id, prediction, probability_1) for every row; works on streaming frames too."""
    data = _prepare(df.select(id_col, *keep, *[F.col("`" + f.replace("`", "``") + "`") for f in model_features(model)]), model_features(model), None, None)
    scored = model.transform(data)
    return scored.select(id_col, *keep, F.col("prediction").cast("int").alias("prediction"),
                         vector_to_array("probability")[1].alias("probability_1"))


def imputed_rows(model: PipelineModel, df: DataFrame, id_col: str = "SK_ID_CURR") -> DataFrame:
    """The id and the complete features as the trees see them, in the model's order."""
    names = model_features(model)
    data = _prepare(df.select(id_col, *[F.col("`" + f.replace("`", "``") + "`") for f in names]), names, None, None)
    return model.stages[0].transform(data).select(id_col, *model.stages[0].getOutputCols())


def feature_importance(model: PipelineModel, features: Sequence[str] | None = None) -> DataFrame:
    """M4: (feature, importance) from the tree ensemble (gain-based, normalised to sum 1)."""
    found = dict(zip(model_features(model), model.stages[-1].featureImportances.toArray().tolist()))  # one number per feature
    s = SparkSession.getActiveSession()
    feats = list(features) if features is not None else list(found)
    return s.createDataFrame([(f, float(found.get(f, 0.0))) for f in feats], "feature string, importance double")


class Bins(NamedTuple):
    """The rows with features x0, x1, ... as doubles, written once; the positions of the features that have values, their bins' bounds and their medians."""

    rows: DataFrame
    full: list[int]
    edges: list[np.ndarray]
    medians: list[float]

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        values = [batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in self.full]
        return np.column_stack([np.searchsorted(e, np.where(np.isnan(v), m, v), side="left") for v, e, m in zip(values, self.edges, self.medians, strict=True)])


def _bins(df: DataFrame, features: Sequence[str], keep: Sequence[str], bins: int) -> Bins:
    """One sketch of all columns gives the bins and the medians, which stand for missing values, so no fit has to look for splits or medians again."""
    x = [F.when(~missing(df, f), F.col("`" + f.replace("`", "``") + "`").cast("double")).alias(f"x{i}") for i, f in enumerate(features)]
    plain = written(df.select(*keep, *x), "plain")
    found = plain.approxQuantile([f"x{i}" for i in range(len(features))], [i / bins for i in range(1, bins)] + [0.5], 1 / (8 * bins))
    full = [i for i, q in enumerate(found) if q]
    return Bins(plain, full, [np.unique(found[i][:-1]) for i in full], [found[i][-1] for i in full])


def _vectors(made: Bins, keep: Sequence[str]) -> DataFrame:
    """(``keep``, features vector), written once."""
    made, plain = made._replace(rows=None), made.rows  # tasks take no table along

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = pa.array(made.codes(batch).astype(float).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(made.full)), flat)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "codes"])

    schema = T.StructType([*[plain.schema[c] for c in keep], T.StructField("codes", T.ArrayType(T.DoubleType()))])
    return written(plain.mapInArrow(number, schema).select(*keep, array_to_vector("codes").alias("features")), "binned")


def _packed(made: Bins, keep: Sequence[str], dtype: str) -> DataFrame:
    """(``keep``, codes: a number of type ``dtype`` per feature, as bytes), written once."""
    made, plain = made._replace(rows=None), made.rows

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = pa.array([r.tobytes() for r in made.codes(batch).astype(dtype)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], codes], [*keep, "codes"])

    schema = T.StructType([*[plain.schema[c] for c in keep], T.StructField("codes", T.BinaryType())])
    return written(plain.mapInArrow(number, schema), "packed")


def binned(df: DataFrame, features: Sequence[str], keep: Sequence[str], bins: int = BINS) -> tuple[DataFrame, list[str]]:
    """(``keep``, features vector) with every feature as the number of its quantile bin, written once; and the features that have values. A
    bin's number keeps its order, so trees on numbers are trees on values cut at the bins' bounds."""
    made = _bins(df, features, keep, bins)
    return _vectors(made, keep), [features[i] for i in made.full]


def together(tasks: Sequence[Callable], parallelism: int) -> list:
    """Results of driver-side tasks that each start Spark jobs, some at a time, each in a FAIR pool of its own (where the scheduler has pools)."""
    spark = SparkSession.getActiveSession()

    def pooled(k: int, task: Callable) -> Callable:
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k}")
            return task()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(pooled(k, t)) for k, t in enumerate(tasks)]]


def _trees(label: str, seed: int, weighted: bool, bins: int, params: Mapping) -> GBTClassifier:
    gbt = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **({**DEFAULT_PARAMS, "maxBins": bins + 1} | dict(params)))
    return gbt.setWeightCol(WEIGHT) if weighted else gbt


def _folds(df: DataFrame, label: str, k: int, id_col: str, seed: int, stratified: bool, pos_weight: float | None) -> tuple[DataFrame, list[str]]:
    """The rows with their label (double), fold and weight if any; and these columns' names with the id's."""
    folded = kfold(df, k, id_col, seed, label if stratified else None).withColumn(label, F.col(label).cast("double")).where(F.col(label).isNotNull())
    keep = [id_col, label, "fold"]
    if pos_weight is not None:
        folded, keep = folded.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0))), [*keep, WEIGHT]
    return folded, keep


def cross_validate_oof(df: DataFrame, features: Sequence[str], label: str = "TARGET", k: int = 5,
                       id_col: str = "SK_ID_CURR", seed: int = 1001, stratified: bool = True,
                       pos_weight: float | None = None, bins: int = BINS, parallelism: int | None = None, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: k-fold fit; returns (out-of-fold scores, per-fold AUC, per-fold importances).

    Each fold trains on the other folds and scores its own rows; the scored folds and importances are
    appended by name (U1). The overall AUC is ``auc_roc`` over the out-of-fold table. All folds share one table of binned features, written once, and are
    fitted at the same time (``parallelism``, all by default). Bins and medians are those of all rows; labels take no part in them.
    """
    folded, keep = _folds(df, label, k, id_col, seed, stratified, pos_weight)
    data, used = binned(folded, features, keep, bins)
    gbt = _trees(label, seed, pos_weight is not None, bins, params)
    models = together([partial(gbt.fit, data.where(F.col("fold") != f)) for f in range(k)], parallelism or k)
    scored = [m.transform(data.where(F.col("fold") == f)).select(
        id_col, label, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability_1"), F.lit(f).alias("fold"))
        for f, m in enumerate(models)]
    oof = written(union_folds(scored), "oof")
    aucs = together([partial(lambda f: auc_roc(oof.where(F.col("fold") == f), label, "probability_1").first()["auc"], f) for f in range(k)], parallelism or k)
    spark = df.sparkSession
    imps = []
    for f, m in enumerate(models):
        found = dict(zip(used, m.featureImportances.toArray().tolist(), strict=True))
        imps += [(x, float(found.get(x, 0.0)), f + 1) for x in features]
    return (oof, spark.createDataFrame(list(enumerate(aucs)), "fold int, auc double"), spark.createDataFrame(imps, "feature string, importance double, fold int"))


# The parameter space of the search.
SPACE = {"stepSize": [0.02, 0.05, 0.1], "maxDepth": [3, 4, 5], "maxIter": [20, 40], "subsamplingRate": [0.7, 1.0], "featureSubsetStrategy": ["all", "sqrt", "0.8"]}


def _setting(params: Mapping, pos_weight: float | None) -> Setting | None:
    """What ``boosting`` needs of a draw. None for one with other parameters than depth, step size and trees, for which Spark's own trees are fitted."""
    p = DEFAULT_PARAMS | dict(params)
    setting = Setting(p["maxDepth"], p["stepSize"], p["maxIter"])
    same = all(p[c] == DEFAULT_PARAMS.get(c) for c in p if c not in ("maxDepth", "stepSize", "maxIter"))
    valid = 1 <= setting.depth <= MAX_DEPTH and 0 < setting.step <= 1 and setting.trees >= 1 and (pos_weight is None or pos_weight > 0)
    return setting if same and valid else None


def random_search(df: DataFrame, features: Sequence[str], label: str = "TARGET", n_iter: int = 8, k: int = 5,
                  space: Mapping[str, Sequence] | None = None, id_col: str = "SK_ID_CURR", seed: int = 0,
                  pos_weight: float | None = None, parallelism: int = 4, rungs: int = 1, eta: int = 2, bins: int = BINS) -> tuple[dict, DataFrame]:
    """M3: ``n_iter`` parameter sets drawn (seeded) from ``space`` and scored by stratified k-fold AUC, each on all rows.

    The trees of all draws and folds are grown side by side on one table of binned features (``boosting``); draws that sample rows or features for a tree, or
    limit a node, are fitted by Spark, ``parallelism`` at a time. With several ``rungs`` the search is cut by successive halving: on the first
    all draws are trained on a hash share of the rows (``eta`` ** (1 - rungs) of them), the best 1 / ``eta`` of them go on to a share ``eta`` times as large, and so on to all rows.
    Returns (best parameters, table of draw, params, rung, share, rows, mean_auc, for every rung that a draw reached). Ties: the smaller draw.
    """
    space = dict(space or SPACE)
    rng = random.Random(seed)
    draws = [{name: rng.choice(list(vals)) for name, vals in sorted(space.items())} for _ in range(n_iter)]
    settings = [_setting(d, pos_weight) for d in draws]
    folded, keep = _folds(df, label, k, id_col, seed, True, pos_weight)
    made = _bins(folded, features, keep, bins)
    if not made.full:
        raise ValueError("no feature has values")
    sizes = [len(e) + 1 for e in made.edges]
    dtype = np.min_scalar_type(max(sizes)).name
    packed = _packed(made, keep, dtype) if any(settings) else None
    vectors = None if all(settings) else _vectors(made, keep)
    judge = BinaryClassificationEvaluator(labelCol=label, numBins=0)  # the whole curve
    left, told = list(range(n_iter)), []
    for rung in range(rungs):
        share = float(eta) ** (rung + 1 - rungs)

        def shared(data: DataFrame, share: float = share) -> DataFrame:
            # a share holds the rows of the smaller ones: the same hash, a higher bound
            return data if share >= 1 else sample_fraction(data, share, id_col, seed + 1)

        held = {r["fold"]: r for r in shared(made.rows).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(label).isin(0.0, 1.0)).alias("odd")).collect()}
        rows = sum(r["n"] for r in held.values())
        if any(r["odd"] for r in held.values()):
            raise ValueError(f"{label} must be 0 or 1")
        if len(held) < 2:
            raise ValueError(f"{rows} rows in {len(held)} folds: nothing to train on")
        found = {}
        own = list(dict.fromkeys(settings[d] for d in left if settings[d]))
        if own:
            part = boosting.rows_of(shared(packed) if share >= 1 else written(shared(packed), "rung"), label, WEIGHT if pos_weight is not None else None)
            trees = boosting.grow(part, sizes, dtype, own, k, pos_weight is not None)
            scored = written(boosting.margins(part, trees, sizes, dtype, own), "margins")
            jobs = [(s, f, judge.copy({judge.labelCol: "label", judge.rawPredictionCol: f"m{i}"})) for i, s in enumerate(own) for f in range(k)]
            aucs = dict(zip([(s, f) for s, f, _ in jobs], together([partial(j.evaluate, scored.where(F.col("fold") == f)) for _, f, j in jobs], parallelism), strict=True))
            found |= {(d, f): aucs[settings[d], f] for d in left if settings[d] for f in range(k)}
        others = [(d, f) for d in left if not settings[d] for f in range(k)]
        if others:
            part = shared(vectors) if share >= 1 else written(shared(vectors), "rung")

            def score(draw: int, fold: int, part: DataFrame = part) -> float:
                model = _trees(label, seed, pos_weight is not None, bins, draws[draw]).fit(part.where(F.col("fold") != fold))
                return judge.evaluate(model.transform(part.where(F.col("fold") == fold)))

            found |= dict(zip(others, together([partial(score, d, f) for d, f in others], parallelism), strict=True))
        mean = {d: sum(found[d, f] for f in range(k)) / k for d in left}
        told += [(d, str(draws[d]), rung, share, rows, float(mean[d])) for d in left]
        left = sorted(sorted(left, key=lambda d: (-mean[d], d))[: max(1, -(-len(left) // eta))]) if rung < rungs - 1 else left
    best = min(left, key=lambda d: (-mean[d], d))
    return draws[best], df.sparkSession.createDataFrame(told, "draw int, params string, rung int, share double, rows long, mean_auc double")
