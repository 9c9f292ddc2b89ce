"""Joins (J1-J8).

Every feature block is unique on the client key, so the block joins are left equi-joins without
fan-out; the blocks come out of their aggregation hash-partitioned on the key, so the joins reuse that
partitioning. No side is broadcast by hand: the planner does so for sides it has measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregate import Feature, aggregate_block

CLIENT = "SK_ID_CURR"

def join_feature_blocks(base: DataFrame, blocks: Sequence[DataFrame], key: str = CLIENT) -> DataFrame:
    """Left-join each per-client block onto the base table."""
    out = base
    for b in blocks:
        out = out.join(b, key, "left")
    return out


def join_subset_aggregate(base: DataFrame, rows: DataFrame, key: str, features: Sequence[Feature], prefix: str,
                          cond: Column | str) -> DataFrame:
    """Filter, aggregate, left join: the plain form of a conditional subset (test oracle)."""
    agg = aggregate_block(rows.where(cond), key, features, prefix)
    return base.join(agg, key, "left")


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str = CLIENT) -> DataFrame:
    """Rows whose key is among ``ids`` (left semi join; no duplicates from repeated ids)."""
    return df.join(ids.select(key), key, "left_semi")


def semi_join_two_hops(child: DataFrame, parent: DataFrame, ids: DataFrame, parent_key: str = CLIENT,
                       child_key: str = "SK_ID_BUREAU") -> DataFrame:
    """Child rows reached through the parents of the given ids."""
    parents = semi_join_ids(parent.select(parent_key, child_key), ids, parent_key)
    return child.join(parents.select(child_key), child_key, "left_semi")


def raw_join(application: DataFrame, bureau: DataFrame, bureau_balance: DataFrame, key: str = CLIENT,
             bureau_key: str = "SK_ID_BUREAU", suffix: str = "_bureau") -> DataFrame:
    """J6 (chain part): application x bureau x bureau balance, inner equi-joins down one hierarchy.

    Each output row is one balance row with its credit and client, so the row count is that of the
    matched balance rows. Clashing column names from the right side get ``suffix``. Joining several
    sibling history tables on the client (all row pairs per client) is not offered.
    """
    bb = bureau_balance
    for c in bb.columns:
        if c != bureau_key and c in bureau.columns:
            bb = bb.withColumnRenamed(c, c + "_balance")
    credits = bureau.join(bb, bureau_key, "inner").drop(bureau_key)
    right = credits
    for c in credits.columns:
        if c != key and c in application.columns:
            right = right.withColumnRenamed(c, c + suffix)
    return application.join(right, key, "inner")


def join_dictionary(features: DataFrame, dictionary: DataFrame, feature_col: str = "feature",
                    row_col: str = "Row", desc_col: str = "Description") -> DataFrame:
    """Feature name to description (left join)."""
    d = dictionary.select(F.col(row_col).alias(feature_col), F.col(desc_col).alias("description"))
    return features.join(d, feature_col, "left")


def lookup_by_id(stored: DataFrame, ids: DataFrame, key: str = CLIENT) -> DataFrame:
    """Stored per-client rows for requested ids, matched by id (never by row position)."""
    return stored.join(ids.select(key).distinct(), key, "inner")
