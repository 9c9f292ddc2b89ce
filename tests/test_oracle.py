"""Registered queries against their DuckDB SQL on the smallest tables (a representative subset;
tools/check_oracle.py runs all of them)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SUBSET = ["join_feature_blocks", "bureau_block", "previous_block", "installments_block", "credit_card_block",
          "ratio_features", "one_hot", "join_subset_aggregate", "raw_join", "agg_spec", "contingency", "top_k_per_client",
          "waterfall_steps", "describe_features", "top_importances", "correlation_pairs", "chi2_test", "chi2_p_value", "impute_median", "cleanup", "box_stats_null_group",
          "stratified_split_null_label", "log_loss", "category_share_long", "self_lookup_by_id", "stratified_kfold", "auc_roc",
          "threshold_gain_sweep", "box_stats", "client_vs_population"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x if x is not None and str(x) not in ("<NA>", "NaT") else None) for x in r)
           for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_sql(spark, duck, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    d = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert _rows(s) == _rows(d)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "SK_ID_CURR" in df.columns


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_report_rounding_bit_equal(spark, duck):
    """The 30-bit report rounding gives the same doubles in Spark and in DuckDB."""
    import numpy as np

    from riskloom.functions.report import report, round_sig_sql

    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 1, 300) * 10.0 ** rng.integers(-8, 12, 300), [0.0, -0.0, 1.0, 0.5, 1e-300]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, x double")
    got = {r.i: r.x for r in report(df).collect()}
    rows = ", ".join(f"({i}, CAST('{float(v)!r}' AS DOUBLE))" for i, v in enumerate(vals))
    want = dict(duck.sql(f"SELECT i, {round_sig_sql('x')} FROM (VALUES {rows}) t(i, x)").fetchall())
    assert all(got[i] == want[i] for i in got)
    assert all(abs(got[i] - v) <= abs(v) * 2.0 ** -29 for i, v in enumerate(vals))
