"""Reproducible sampling, splits and folds (G1-G5), all keyed on a hash of the row id.

The hash (60 bits of ``md5(id || ':' || seed)``) is the same in Spark and SQL, so every split can be
checked against an SQL oracle and re-run on the cluster with the same result; splits of different seeds are
independent, and ids may be negative, large or text. Exact per-class quotas use ``hash_rank``: the rank of a
row inside its class ordered by (hash, id), from counts per hash range instead of a window over the class.
Rows without a label are a class of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalar import HASH_BITS, HASH_MOD, parity_hash

H = "_h"
# Hash ranges per class; the hash is uniform, so a range holds its share of the class whatever the ids are.
RANGE_BITS = 14


def with_hash(df: DataFrame, id_col: str, seed: int = 0, name: str = H) -> DataFrame:
    return df.withColumn(name, parity_hash(id_col, seed))


def sample_fraction(df: DataFrame, fraction: float, id_col: str = "SK_ID_CURR", seed: int = 0,
                    method: str = "hash") -> DataFrame:
    """G1: Bernoulli sample of rows. ``hash``: keep a row when its id's hash falls below ``fraction`` of
    the hash range (same rows on any cluster, in SQL too, and after a retry); ``bernoulli``: Spark's
    per-partition sampler (seeded, but tied to the partitioning of the input)."""
    if method == "bernoulli":
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    cut = int(fraction * HASH_MOD)
    return df.where(parity_hash(id_col, seed) < F.lit(cut))


def sample_n(df: DataFrame, n: int, id_col: str = "SK_ID_CURR", seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, the smallest (hash, id); a top-k, so no global sort."""
    return with_hash(df, id_col, seed).orderBy(F.col(H), F.col(id_col)).limit(n).drop(H)


def random_split(df: DataFrame, test_fraction: float, id_col: str = "SK_ID_CURR", seed: int = 0,
                 name: str = "is_test") -> DataFrame:
    """Flag rows whose hash falls below ``test_fraction`` of the range."""
    cut = int(test_fraction * HASH_MOD)
    return df.withColumn(name, parity_hash(id_col, seed) < F.lit(cut))


def hash_rank(df: DataFrame, group_cols: Sequence[str], id_col: str, seed: int = 0, name: str = "_rank") -> DataFrame:
    """Exact ``row_number() over (partition by group order by hash, id)`` without a per-group window.

    1. counts per (group, hash range): groups x 2^RANGE_BITS rows;
    2. running count per group over those counts gives each range's offset;
    3. ``row_number`` inside (group, range).
    Also adds ``_n_group`` (rows in the group). A NULL group is a group like any other.
    """
    g = list(group_cols)
    h = with_hash(df, id_col, seed).withColumn("_b", F.shiftright(F.col(H), HASH_BITS - RANGE_BITS).cast("int"))
    counts = h.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = counts.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(g)], F.col("_b").alias("_ob"),
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("_n_group"))
    inside = Window.partitionBy(*g, "_b").orderBy(H, id_col)
    same = F.col("_b") == F.col("_ob")
    for i, c in enumerate(g):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    out = h.withColumn("_in", F.row_number().over(inside)).join(offsets, same, "inner")
    return out.withColumn(name, F.col("_off") + F.col("_in")).drop("_off", "_in", "_b", "_ob", *[f"_g{i}" for i in range(len(g))])


def stratified_split(df: DataFrame, label: str, test_fraction: float, id_col: str = "SK_ID_CURR", seed: int = 0,
                     name: str = "is_test") -> DataFrame:
    """In each class the ``floor(n * f + 0.5)`` rows of smallest (hash, id) are test rows."""
    r = hash_rank(df, [label], id_col, seed)
    quota = F.floor(F.col("_n_group") * F.lit(float(test_fraction)) + F.lit(0.5))
    return r.withColumn(name, F.col("_rank") <= quota).drop(H, "_rank", "_n_group")


def kfold(df: DataFrame, k: int, id_col: str = "SK_ID_CURR", seed: int = 0, label: str | None = None,
          name: str = "fold") -> DataFrame:
    """fold = hash mod k; stratified: (rank in class by hash - 1) mod k, so class shares match."""
    if label is None:
        return df.withColumn(name, (parity_hash(id_col, seed) % F.lit(k)).cast("int"))
    r = hash_rank(df, [label], id_col, seed)
    return r.withColumn(name, ((F.col("_rank") - 1) % F.lit(k)).cast("int")).drop(H, "_rank", "_n_group")
