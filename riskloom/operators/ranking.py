"""Sorts, limits, per-client windows and unions.

Windows here are partitioned by client (bounded by the features per client) or run over a table of
features (bounded by the feature count, hundreds of rows); none runs over data rows unpartitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_importances(df: DataFrame, n: int, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """The ``n`` largest importances, ties by name (a top-k, no global sort)."""
    return df.orderBy(F.col(importance).desc(), F.col(feature).asc()).limit(n)


def normalised_cumulative_importance(df: DataFrame, feature: str = "feature",
                                     importance: str = "importance") -> DataFrame:
    """Share of the total and running share, in (importance desc, name) order.

    Input is one row per feature; the window covers that small table only.
    """
    order = Window.orderBy(F.col(importance).desc(), F.col(feature).asc())
    total = F.sum(importance).over(Window.partitionBy(F.lit(1)))
    share = F.col(importance) / total
    return df.select(
        feature, importance,
        F.row_number().over(order).cast("long").alias("rank"),
        share.alias("importance_normalized"),
        (F.sum(F.col(importance)).over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cumulative_importance"),
    )


def select_by_cumulative_importance(df: DataFrame, threshold: float = 0.99, feature: str = "feature",
                                    importance: str = "importance") -> DataFrame:
    """Features whose running share stays below ``threshold``."""
    return normalised_cumulative_importance(df, feature, importance).where(F.col("cumulative_importance") < threshold)


def _abs_rank(long_df: DataFrame, id_col: str, feature: str, value: str) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(F.abs(F.col(value)).desc(), F.col(feature).asc())
    return long_df.withColumn("rank", F.row_number().over(w).cast("long"))


def top_k_per_client(long_df: DataFrame, k: int = 10, id_col: str = "SK_ID_CURR", feature: str = "feature",
                     value: str = "phi") -> DataFrame:
    """The ``k`` largest absolute values per client, ties by feature name."""
    return _abs_rank(long_df, id_col, feature, value).where(F.col("rank") <= k)


def rest_bucket(long_df: DataFrame, k: int = 10, id_col: str = "SK_ID_CURR", feature: str = "feature",
                value: str = "phi") -> DataFrame:
    """Per client, the sum and count of all values outside the top ``k``."""
    r = _abs_rank(long_df, id_col, feature, value)
    return r.groupBy(id_col).agg(
        F.coalesce(F.sum(F.when(F.col("rank") > k, F.col(value))), F.lit(0.0)).alias("rest"),
        F.count(F.when(F.col("rank") > k, F.lit(1))).alias("n_rest"),
    )


def waterfall_steps(long_df: DataFrame, base_value: float | DataFrame, k: int = 10, id_col: str = "SK_ID_CURR",
                    feature: str = "feature", value: str = "phi") -> DataFrame:
    """Per client: step 0 base, step 1 all-but-top-k, then the top k ascending by |value|.

    ``running`` is the total after each step; the last step ends at base + sum of all values, so the bars
    are exactly the k strongest features and the rest bucket holds every other one.
    """
    if isinstance(base_value, DataFrame):
        base_value = base_value.first()[0]  # a one-row table: read the scalar
    # one window (rank), one aggregation per client; the steps are laid out inside the client's row
    r = _abs_rank(long_df, id_col, feature, value)
    inside = F.col("rank") <= k
    per = r.groupBy(id_col).agg(
        F.coalesce(F.sum(F.when(~inside, F.col(value))), F.lit(0.0)).alias("_rest"),
        F.array_sort(F.collect_list(F.when(inside, F.struct((-F.col("rank")).alias("o"), F.col(feature).alias("label"),
                                                            F.col(value).cast("double").alias("v"))))).alias("_top"))  # at most k entries
    head = F.array(F.struct(F.lit("base").alias("label"), F.lit(float(base_value)).alias("v")),
                   F.struct(F.lit("rest").alias("label"), F.col("_rest").alias("v")))
    steps = F.concat(head, F.transform("_top", lambda t: F.struct(t["label"].alias("label"), t["v"].alias("v"))))
    out = per.select(id_col, steps.alias("_s")).select(id_col, "_s", F.posexplode("_s").alias("step", "_t"))
    running = F.aggregate(F.slice("_s", F.lit(1), F.col("step") + 1), F.lit(0.0), lambda acc, t: acc + t["v"])
    return out.select(id_col, F.col("step").cast("int").alias("step"), F.col("_t.label").alias("label"), F.col("_t.v").alias(value),
                      running.alias("running"))


def sorted_ids(df: DataFrame, id_col: str = "SK_ID_CURR") -> DataFrame:
    """Distinct ids in ascending order."""
    return df.select(id_col).distinct().orderBy(id_col)


def union_folds(frames: Sequence[DataFrame]) -> DataFrame:
    """Append per-fold tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
