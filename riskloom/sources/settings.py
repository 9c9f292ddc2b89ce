"""Feature list and model parameters from a JSON file: ``most_important_features`` (names) and ``best_params`` (a boosted-tree trainer's names)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Features to select (None: all), parameters for ``train_classifier`` and the positive class's weight (None: from the data)."""

    features: list[str] | None = None
    params: dict = field(default_factory=dict)
    pos_weight: float | None = None
    unused: tuple[str, ...] = ()


def trainer_params(best: dict, max_trees: int | None = None) -> tuple[dict, float | None, tuple[str, ...]]:
    """(parameters of Spark's trainer, class weight, names without a counterpart).

    Leaves become the depth that holds as many; regularisation has no counterpart; ``max_trees`` caps the number of trees, which a file meant for early stopping sets high.
    """
    rest, out = dict(best), {}
    if "learning_rate" in rest:
        out["stepSize"] = float(rest.pop("learning_rate"))
    if "num_leaves" in rest:
        out["maxDepth"] = max(1, math.ceil(math.log2(max(2, int(rest.pop("num_leaves"))))))
    if "n_estimators" in rest:
        trees = int(rest.pop("n_estimators"))
        out["maxIter"] = min(trees, max_trees) if max_trees else trees
    if "colsample_bytree" in rest:
        share = float(rest.pop("colsample_bytree"))
        out["featureSubsetStrategy"] = "all" if share >= 1 else str(share)
    if "bagging_fraction" in rest and rest.get("bagging_freq"):  # without a frequency it has no effect
        out["subsamplingRate"] = float(rest.pop("bagging_fraction"))
        rest.pop("bagging_freq")
    weight = rest.pop("scale_pos_weight", None)
    return out, None if weight is None else float(weight), tuple(sorted(rest))


def read_settings(spark: SparkSession, path: str, max_trees: int | None = None) -> Settings:
    """The settings in a JSON file in any store that Spark reads; missing parts keep their defaults."""
    text = spark.read.text(path, wholetext=True).first()
    found = json.loads(text["value"]) if text else {}
    params, weight, unused = trainer_params(found.get("best_params", {}), max_trees)
    return Settings(found.get("most_important_features"), params, weight, unused)
