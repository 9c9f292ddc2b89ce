"""Evaluation of scores against labels.

All metrics start from one aggregation per distinct score (or per fixed threshold bucket), so the
data rows are reduced map-side before any ordering; cumulative counts use ``ordered_cumsum``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalar import risk_band, weighted_log_loss_term
from riskloom.operators.ordered import ordered_cumsum

# Business gain per client (per 100 clients) for the threshold sweep.
GAIN_TRUE_NEGATIVE = 5.0
LOSS_FALSE_NEGATIVE = 100.0
LOSS_FALSE_POSITIVE = 5.0
THRESHOLD_STEPS = 100


def score_histogram(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """(score, pos, neg): labelled rows per distinct score."""
    y = F.col(label).cast("long")
    return (df.where(F.col(score).isNotNull())
            .groupBy(score).agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def auc_roc(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """M5: tie-aware area under the ROC curve (Mann-Whitney form): one row (auc, n_pos, n_neg)."""
    hist = score_histogram(df, label, score)
    c = ordered_cumsum(hist, score, ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    return c.agg(
        # one class only: NULL
        F.try_divide(F.sum(F.col("pos") * (below + F.lit(0.5) * F.col("neg"))), F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )


def roc_points(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """M6: for each distinct score t (predict positive when score >= t): tpr, fpr."""
    hist = score_histogram(df, label, score)
    c = ordered_cumsum(hist, score, ["pos", "neg"], descending=True)
    return c.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos").cast("double")).alias("tpr"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("all_neg").cast("double")).alias("fpr"),
    )


def predict_at(score: str, threshold: float):
    return (F.col(score) >= F.lit(float(threshold))).cast("int")


def confusion_matrix(df: DataFrame, label: str = "y", score: str = "p", threshold: float = 0.5) -> DataFrame:
    """M7: tp, fp, tn, fn at a threshold (positive when score >= threshold)."""
    y = F.col(label)
    pr = predict_at(score, threshold)
    return df.agg(
        F.count(F.when((y == 1) & (pr == 1), 1)).alias("tp"),
        F.count(F.when((y == 0) & (pr == 1), 1)).alias("fp"),
        F.count(F.when((y == 0) & (pr == 0), 1)).alias("tn"),
        F.count(F.when((y == 1) & (pr == 0), 1)).alias("fn"),
    )


def classification_report(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """M8: precision, recall, f1, support per class, plus macro and weighted averages."""
    y, p = F.col(label).cast("string"), F.col(pred).cast("string")
    per_true = df.groupBy(y.alias("cls")).agg(F.count(F.lit(1)).alias("support"),
                                              F.count(F.when(y == p, 1)).alias("tp"))
    per_pred = df.groupBy(p.alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    t = per_true.join(per_pred, "cls", "full").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    rows = t.select("cls", prec.alias("precision"), rec.alias("recall"), F.col("support"))
    rows = rows.withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                           .otherwise(F.lit(0.0)))
    rows = rows.select("cls", "precision", "recall", "f1", "support")
    n = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                     F.avg("f1").alias("f1"), n.alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("cls"),
                        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"), n.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """M9."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _grid_bucket(score: str, steps: int):
    """Number of grid thresholds k/steps (k >= 1) at or below the score, exactly (no rounding slip)."""
    s = F.col(score).cast("double")
    b0 = F.floor(s * F.lit(float(steps))).cast("long")
    b1 = F.when((b0 + 1) / F.lit(float(steps)) <= s, b0 + 1).otherwise(b0)
    b2 = F.when(b1 / F.lit(float(steps)) > s, b1 - 1).otherwise(b1)
    return F.least(F.greatest(b2, F.lit(-1)), F.lit(steps))


def threshold_gain_sweep(df: DataFrame, label: str = "y", score: str = "p", steps: int = THRESHOLD_STEPS,
                         gain_tn: float = GAIN_TRUE_NEGATIVE, loss_fn: float = LOSS_FALSE_NEGATIVE,
                         loss_fp: float = LOSS_FALSE_POSITIVE) -> DataFrame:
    """For thresholds k/steps, k = 0..steps: counts and gain per 100 clients.

    gain = (gain_tn * TN - loss_fn * FN - loss_fp * FP) / n * 100. Rows are counted per grid bucket
    (steps + 2 rows), then accumulated over that tiny table.
    """
    y = F.col(label).cast("long")
    b = df.where(F.col(score).isNotNull()).groupBy(_grid_bucket(score, steps).alias("k")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").alias("k"))
    t = grid.join(b, "k", "left").fillna(0, ["pos", "neg"])  # steps + 2 rows
    # predicted positive at threshold k/steps: bucket >= k, a running sum from the top of the grid
    down = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    t = t.select("k", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                 F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    return t.where(F.col("k") >= 0).select(
        (F.col("k") / F.lit(float(steps))).alias("threshold"),
        F.col("tp"), F.col("fp"),
        (F.col("N") - F.col("fp")).alias("tn"),
        (F.col("P") - F.col("tp")).alias("fn"),
        ((F.lit(gain_tn) * (F.col("N") - F.col("fp")) - F.lit(loss_fn) * (F.col("P") - F.col("tp"))
          - F.lit(loss_fp) * F.col("fp")) / (F.col("P") + F.col("N")) * F.lit(100.0)).alias("gain"),
    )


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """Best threshold (largest gain, smallest threshold on ties) and break-even threshold (largest
    threshold whose gain is still >= 0). Input: the sweep table (steps + 1 rows)."""
    w = Window.orderBy(F.col("gain").desc(), F.col("threshold").asc())
    whole = Window.partitionBy(F.lit(1))
    be = F.max(F.when(F.col("gain") >= 0, F.col("threshold"))).over(whole)
    ranked = sweep.select("threshold", "gain", F.row_number().over(w).alias("_r"), be.alias("break_even_threshold"))
    return ranked.where(F.col("_r") == 1).select(F.col("threshold").alias("best_threshold"),
                                                 F.col("gain").alias("best_gain"), "break_even_threshold")


def log_loss(df: DataFrame, label: str = "y", prob: str = "p", pos_weight: float = 1.0) -> DataFrame:
    """weighted binary log loss, summed (and averaged) over rows."""
    t = weighted_log_loss_term(label, prob, pos_weight)
    return df.agg(F.sum(t).alias("log_loss_sum"), F.avg(t).alias("log_loss_mean"))


def risk_bands(df: DataFrame, prob: str = "p", keep: Sequence[str] = ()) -> DataFrame:
    """band of each score."""
    return df.select(*keep, F.col(prob), risk_band(prob).alias("risk_band"))


def mean_prediction(df: DataFrame, label: str = "y", prob: str = "p") -> DataFrame:
    """A17."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("mean_label"), F.avg(prob).alias("mean_probability"))
