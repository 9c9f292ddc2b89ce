"""Running sums in value order without a window over all rows.

A cumulative count over sorted values (ROC, AUC, quantiles, ranks) is usually written as an
un-partitioned window, which moves every row into one task. Here the rows are first collapsed to one
per (group, value) by the caller and written once; then they are split into value buckets whose bounds come from
``approxQuantile``. Bucket totals (groups x buckets rows) give each bucket's offset; the running sum inside a
bucket is a window partitioned by (group, bucket). The number of buckets is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import written

BUCKETS = 1024


def _splits(df: DataFrame, col: str, buckets: int) -> list[float]:
    probs = [i / buckets for i in range(1, buckets)]
    qs = df.approxQuantile(col, probs, 1.0 / (4 * buckets))
    inner = sorted({float(q) for q in qs if q is not None})
    return [float("-inf"), *(inner or [0.0]), float("inf")]


def ordered_cumsum(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    descending: bool = False,
    buckets: int = BUCKETS,
    prefix: str = "cum_",
    total_prefix: str = "all_",
) -> DataFrame:
    """Add ``<prefix><v>``, the inclusive running sum of each value column in ``order_col`` order, and
    ``<total_prefix><v>``, the group's total.

    Rows must be unique per (group_cols, order_col) and ``order_col`` non-NULL; aggregate first. The input is computed once
    (written in the shared folder) and read three times. A NULL group is a group like any other.
    """
    key = "_ord"
    g = list(group_cols)
    base = written(df.withColumn(key, (-F.col(order_col) if descending else F.col(order_col)).cast("double")), "ordered")
    b = Bucketizer(splits=_splits(base, key, buckets), inputCol=key, outputCol="_bkt", handleInvalid="keep").transform(base)
    tot = b.groupBy(*g, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    off = tot.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(g)], F.col("_bkt").alias("_ob"),
                     *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols],
                     *[F.sum(f"_t_{v}").over(whole).alias(f"{total_prefix}{v}") for v in value_cols])
    inside = Window.partitionBy(*g, "_bkt").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    b = b.select("*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in value_cols])
    same = F.col("_bkt") == F.col("_ob")
    for i, c in enumerate(g):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    return b.join(off, same, "inner").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).alias(f"{prefix}{v}") for v in value_cols],
        *[F.col(f"{total_prefix}{v}") for v in value_cols],
    )
