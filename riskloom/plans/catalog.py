"""Operator queries of the inventory (sections 2.1-2.13) with their DuckDB oracle SQL.

Each query reads the driver's tables through the fixture views (or data derived from them), runs one
operator over the whole tables and ends in ``report``. Shared inputs:
* ``app``: the application feature row (application_features on fx_application);
* ``features``: the full joined feature row;
* ``scores``: ``labels`` with a hash-made probability (label = toxic), for the evaluation operators;
* ``vl`` / ``zl``: application features in long form, and their standardised linear attributions
  (closed-form Shapley values), the deterministic input of the attribution-table operators.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.checksum import checksum_sql, table_checksum
from riskloom.functions.naming import AGG_SUFFIXES, BLOCK_PREFIXES, feature_root_name
from riskloom.functions.report import report, round_sig_sql
from riskloom.functions.scalar import HASH_MOD, LOG_LOSS_EPS, parity_hash, parity_hash_sql
from riskloom.operators import aggregate as A
from riskloom.operators import blocks as B
from riskloom.operators import clean as P
from riskloom.operators import encode as E
from riskloom.operators import explain as X
from riskloom.operators import impute as I
from riskloom.operators import joins as J
from riskloom.operators import metrics as M
from riskloom.operators import profile as V
from riskloom.operators import ranking as W
from riskloom.operators import sampling as G
from riskloom.operators import stats as C
from riskloom.plans import oracle as O
from riskloom.plans.features import build_features, fixture_tables
from riskloom.plans.registry import register
from riskloom.session import scratch_path, written
from riskloom.sources import fixtures as FX
from riskloom.sources.settings import read_settings
from riskloom.sources.sinks import write_table
from riskloom.sources.tables import load_capped, load_projected, load_table

q = O.q


def rep(body: str, doubles: list[str] = (), others: list[str] = ()) -> str:
    return O.report_wrap(body, [(c, "o") for c in others] + [(c, "d") for c in doubles])


def sql(views: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    return FX.with_fixtures(views, body, extra)


def fx(spark: SparkSession, d: str, name: str) -> DataFrame:
    return FX.load_fixture(spark, d, name)


# ---- shared inputs ---------------------------------------------------------------------------------

APP_BODY, APP_COLS = O.application_sql()
APP_CTE = [("app", APP_BODY)]
FEAT_BODY, FEAT_COLS = O.features_sql()
FEAT_CTE = [("features", FEAT_BODY)]
ALL_FX = ["fx_application", "fx_bureau", "fx_bureau_balance", "fx_previous_application", "fx_pos_cash",
          "fx_installments", "fx_credit_card"]

# Application features used in long form.
Z_FEATURES = ["CODE_GENDER", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED",
              "CNT_FAM_MEMBERS", "NAME_INCOME_TYPE_AUTOMOBILE", "NAME_INCOME_TYPE_BUILDING",
              "NAME_INCOME_TYPE_FURNITURE", "NAME_INCOME_TYPE_HOUSEHOLD", "NAME_INCOME_TYPE_MACHINERY",
              "DAYS_EMPLOYED_PERC", "INCOME_CREDIT_PERC", "INCOME_PER_PERSON", "ANNUITY_INCOME_PERC", "PAYMENT_RATE"]
CORR_COLUMNS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS",
                "PAYMENT_RATE", "INCOME_CREDIT_PERC"]
SELECTED = ["PAYMENT_RATE", "DAYS_BIRTH", "INSTAL_DPD_MEAN", "BURO_DAYS_CREDIT_MAX", "POS_COUNT"]


def app(spark, d):
    return B.application_features(fx(spark, d, "fx_application"))


def features(spark, d):
    return build_features(fixture_tables(spark, d))


def values_long(spark, d):
    return P.transpose_client(app(spark, d), "SK_ID_CURR", Z_FEATURES)


def z_long(spark, d):
    return X.linear_attribution(values_long(spark, d))


def z_long_rounded(spark, d):
    return report(z_long(spark, d))


VL_SQL = ("SELECT SK_ID_CURR, feature, value FROM (SELECT SK_ID_CURR, "
          + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in Z_FEATURES)
          + " FROM app) UNPIVOT INCLUDE NULLS (value FOR feature IN ("
          + ", ".join(q(c) for c in Z_FEATURES) + "))")
ST_SQL = "SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM vl GROUP BY feature"
ZL_SQL = ("SELECT * FROM (SELECT vl.SK_ID_CURR, vl.feature, CASE WHEN st.s > 0 THEN (vl.value - st.m) / st.s END AS phi "
          "FROM vl JOIN st USING (feature)) WHERE phi IS NOT NULL")
# attributions at report precision: sums of 30-bit values are exact, so running totals agree bit for bit
ZLR_SQL = f"SELECT SK_ID_CURR, feature, {round_sig_sql('phi')} AS phi FROM zl"
ZL_CTE = APP_CTE + [("vl", VL_SQL), ("st", ST_SQL), ("zl", ZL_SQL), ("zlr", ZLR_SQL)]


# Attributions of features of several blocks, the stored explanation that names, descriptions and lookups are applied to.
STORED = ["PAYMENT_RATE", "DAYS_BIRTH", "AMT_CREDIT", "INSTAL_DPD_MEAN", "BURO_DAYS_CREDIT_MAX", "POS_COUNT", "INSTAL_COUNT"]
STORED_TOP = 3


def stored_attributions(spark, d):
    return report(X.linear_attribution(P.transpose_client(features(spark, d), "SK_ID_CURR", STORED)))


def stored_top(spark, d):
    """(SK_ID_CURR, feature, phi, rank): each client's strongest stored attributions."""
    return W.top_k_per_client(stored_attributions(spark, d), STORED_TOP)


STORED_CTE = FEAT_CTE + [
    ("svl", "SELECT SK_ID_CURR, feature, value FROM (SELECT SK_ID_CURR, " + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in STORED)
     + " FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(q(c) for c in STORED) + "))"),
    ("sst", "SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM svl GROUP BY feature"),
    ("szl", f"SELECT SK_ID_CURR, feature, {round_sig_sql('phi')} AS phi FROM (SELECT svl.SK_ID_CURR, svl.feature, CASE WHEN sst.s > 0 THEN "
     "(svl.value - sst.m) / sst.s END AS phi FROM svl JOIN sst USING (feature)) WHERE phi IS NOT NULL"),
    ("stop", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(phi) DESC, feature ASC) AS rank FROM szl) "
     f"WHERE rank <= {STORED_TOP}")]


def nan_bureau(spark, d):
    """Credits with NaN amounts, NULL debts, a NULL type and an incomplete whole number."""
    k = F.col("SK_ID_BUREAU")
    return fx(spark, d, "fx_bureau").select(
        "SK_ID_BUREAU", "CREDIT_TYPE", F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("AMT_CREDIT_SUM")).alias("AMT_CREDIT_SUM"),
        "AMT_CREDIT_SUM_DEBT", F.when(k % 17 == 0, F.lit(None)).otherwise(k % 10).cast("long").alias("CNT_PROLONG"))


NAN_COLS = ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "CNT_PROLONG"]
# in SQL the NaN is NULL at once: that is the rule under test
NAN_CTE = [("nb", "SELECT SK_ID_BUREAU, CREDIT_TYPE, CASE WHEN SK_ID_BUREAU % 13 <> 0 THEN AMT_CREDIT_SUM END AS AMT_CREDIT_SUM, "
                  "AMT_CREDIT_SUM_DEBT, CASE WHEN SK_ID_BUREAU % 17 <> 0 THEN CAST(SK_ID_BUREAU % 10 AS BIGINT) END AS CNT_PROLONG FROM fx_bureau")]


def unlabelled(spark, d):
    """Clients of whom every 19th has no label."""
    return fx(spark, d, "fx_application").select(
        "SK_ID_CURR", F.when(F.col("SK_ID_CURR") % 19 != 0, F.col("TARGET")).alias("TARGET"))


UNLABELLED_CTE = [("ul", "SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 19 <> 0 THEN TARGET END AS TARGET FROM fx_application")]


def scores(spark, d):
    lab = load_table(spark, d, "labels")
    h = parity_hash("doc_id", 1).cast("double")
    raw = (F.floor(h * F.lit(50.0) / F.lit(float(HASH_MOD))).cast("double") / F.lit(50.0)) * F.lit(0.7) \
        + F.col("toxic").cast("double") * F.lit(0.3)
    p = F.lit(0.01) + F.lit(0.98) * raw
    return lab.select(F.col("doc_id").alias("SK_ID_CURR"), F.col("toxic").alias("y"), p.alias("p"),
                      (p >= F.lit(0.5)).cast("int").alias("pred"))


_H1 = f"CAST({parity_hash_sql('doc_id', 1)} AS DOUBLE)"
_RAW = (f"(CAST(floor({_H1} * CAST(50 AS DOUBLE) / CAST({HASH_MOD} AS DOUBLE)) AS DOUBLE) / CAST(50 AS DOUBLE)) "
        f"* CAST(0.7 AS DOUBLE) + CAST(toxic AS DOUBLE) * CAST(0.3 AS DOUBLE)")
_P = f"(CAST(0.01 AS DOUBLE) + CAST(0.98 AS DOUBLE) * ({_RAW}))"
SCORES_SQL = (f"SELECT doc_id AS SK_ID_CURR, toxic AS y, {_P} AS p, CASE WHEN {_P} >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred "
              f"FROM labels")
SCORES_CTE = [("scores", SCORES_SQL)]


def ids_sample(spark, d, fraction, seed):
    return G.sample_fraction(fx(spark, d, "fx_application"), fraction, "SK_ID_CURR", seed).select("SK_ID_CURR")


def ids_sample_sql(fraction, seed):
    return f"SELECT SK_ID_CURR FROM fx_application WHERE {parity_hash_sql('SK_ID_CURR', seed)} < {int(fraction * HASH_MOD)}"


# ---- 2.1 sources and sinks ------------------------------------------------------------------------------

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@register("load_table", rep("SELECT * FROM customer", ["c_acctbal"], CUSTOMER))
def q_load_table(spark, d):
    return report(load_table(spark, d, "customer"))


@register("load_capped", rep("SELECT * FROM customer ORDER BY c_custkey LIMIT 100", ["c_acctbal"], CUSTOMER))
def q_load_capped(spark, d):
    return report(load_capped(spark, d, "customer", 100, ["c_custkey"]))


@register("load_table_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def q_load_table_csv(spark, d):
    """S4, then S1: a table written as CSV with a header and read with its schema."""
    base, t = scratch_path(spark, f"csv-{uuid.uuid4().hex}"), load_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    write_table(t, f"{base}/customer.csv", "csv")
    return load_table(spark, base, "customer", "csv", t.schema)


@register("write_table", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def q_write_table(spark, d):
    """Parquet in a folder for each order status, read back."""
    path = scratch_path(spark, f"orders-{uuid.uuid4().hex}")
    t = load_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    write_table(t, path, partition_by=["o_orderstatus"])
    return spark.read.schema(t.schema).parquet(path)


@register("load_projected", "SELECT c_custkey, c_name FROM customer")
def q_load_projected(spark, d):
    return load_projected(spark, d, "customer", ["c_custkey", "c_name"])


def _test_ids_sql():
    h = parity_hash_sql("SK_ID_CURR", 7)
    return (f"SELECT SK_ID_CURR FROM (SELECT SK_ID_CURR, row_number() OVER (PARTITION BY TARGET ORDER BY {h}, SK_ID_CURR) AS rk, "
            f"count(*) OVER (PARTITION BY TARGET) AS n FROM fx_application) "
            f"WHERE rk <= floor(CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE))")


@register("export_client_sample", sql(ALL_FX, """
SELECT 'application' AS "table", count(*) AS "rows" FROM fx_application WHERE SK_ID_CURR IN (SELECT * FROM ids)
UNION ALL SELECT 'bureau', count(*) FROM fx_bureau WHERE SK_ID_CURR IN (SELECT * FROM ids)
UNION ALL SELECT 'bureau_balance', count(*) FROM fx_bureau_balance WHERE SK_ID_BUREAU IN
  (SELECT SK_ID_BUREAU FROM fx_bureau WHERE SK_ID_CURR IN (SELECT * FROM ids))
UNION ALL SELECT 'previous_application', count(*) FROM fx_previous_application WHERE SK_ID_CURR IN (SELECT * FROM ids)
UNION ALL SELECT 'pos_cash', count(*) FROM fx_pos_cash WHERE SK_ID_CURR IN (SELECT * FROM ids)
UNION ALL SELECT 'installments', count(*) FROM fx_installments WHERE SK_ID_CURR IN (SELECT * FROM ids)
UNION ALL SELECT 'credit_card', count(*) FROM fx_credit_card WHERE SK_ID_CURR IN (SELECT * FROM ids)""",
    [("ids", _test_ids_sql())]))
def q_export_client_sample(spark, d):
    """The test clients' rows of every table, written per table and read back."""
    from riskloom.sources.sinks import export_client_sample

    t = fixture_tables(spark, d)
    ids = G.stratified_split(t["application"], "TARGET", 0.25, "SK_ID_CURR", 7).where("is_test").select("SK_ID_CURR")
    paths = export_client_sample(t, written(ids, "ids"), scratch_path(spark, f"sample-{uuid.uuid4().hex}"))
    return W.union_folds([spark.read.parquet(x).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(x.rsplit("/", 1)[1]).alias("table"), "rows")
                          for x in paths])


# Columns of the source tables: texts and whole numbers, then floating ones.
SOURCE_COLUMNS = {
    "application": (["SK_ID_CURR", "TARGET", "NAME_INCOME_TYPE", "CODE_GENDER"],
                    ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS"]),
    "bureau": (["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"], ["DAYS_CREDIT", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"]),
    "bureau_balance": (["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"], []),
    "previous_application": (["SK_ID_PREV", "SK_ID_CURR", "NAME_CONTRACT_STATUS"],
                             ["AMT_APPLICATION", "AMT_CREDIT", "RATE_DOWN_PAYMENT", "CNT_PAYMENT", "DAYS_DECISION", "DAYS_FIRST_DRAWING"]),
    "pos_cash": (["SK_ID_CURR", "MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF", "NAME_CONTRACT_STATUS"], []),
    "installments": (["SK_ID_CURR", "NUM_INSTALMENT_VERSION"], ["AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"]),
    "credit_card": (["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "CNT_DRAWINGS_CURRENT", "NAME_CONTRACT_STATUS"], ["AMT_BALANCE"]),
}


def _sample_checksum_sql() -> str:
    own = "SK_ID_CURR IN (SELECT * FROM ids)"
    far = f"SK_ID_BUREAU IN (SELECT SK_ID_BUREAU FROM fx_bureau WHERE {own})"
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", * FROM ({checksum_sql(f'(SELECT * FROM fx_{t} WHERE {far if t == 'bureau_balance' else own})', *cols)})"
        for t, cols in SOURCE_COLUMNS.items())


@register("export_client_sample_checksum", sql(ALL_FX, _sample_checksum_sql(), [("ids", _test_ids_sql())]))
def q_export_client_sample_checksum(spark, d):
    """Rows and an order-free checksum of all values of every exported table, read back from its files."""
    from riskloom.sources.sinks import export_client_sample

    t = fixture_tables(spark, d)
    ids = G.stratified_split(t["application"], "TARGET", 0.25, "SK_ID_CURR", 7).where("is_test").select("SK_ID_CURR")
    paths = export_client_sample(t, written(ids, "ids"), scratch_path(spark, f"sample-{uuid.uuid4().hex}"))
    told = [table_checksum(spark.read.parquet(x), portable=True).withColumn("table", F.lit(x.rsplit("/", 1)[1])) for x in paths]
    return W.union_folds([x.select("table", "n_rows", "checksum") for x in told])


# ---- 2.2 projections, filters, cleaning -------------------------------------------------------------

RATIOS = B.APPLICATION_RATIOS


@register("filter_not_value", sql(["fx_application"],
          "SELECT SK_ID_CURR, CODE_GENDER FROM fx_application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'"))
def q_filter_not_value(spark, d):
    return P.filter_not_value(fx(spark, d, "fx_application"), "CODE_GENDER", "XNA").select("SK_ID_CURR", "CODE_GENDER")


@register("filter_category", sql(["fx_bureau"], rep(
    "SELECT SK_ID_CURR, SK_ID_BUREAU, AMT_CREDIT_SUM FROM fx_bureau WHERE CREDIT_ACTIVE = 'Active'",
    ["AMT_CREDIT_SUM"], ["SK_ID_CURR", "SK_ID_BUREAU"])))
def q_filter_category(spark, d):
    return report(P.filter_category(fx(spark, d, "fx_bureau"), "CREDIT_ACTIVE", "Active")
                  .select("SK_ID_CURR", "SK_ID_BUREAU", "AMT_CREDIT_SUM"))


@register("sentinel_to_null", sql(["fx_previous_application"],
          "SELECT SK_ID_PREV, SK_ID_CURR, CASE WHEN DAYS_FIRST_DRAWING <> 365243 THEN DAYS_FIRST_DRAWING END AS DAYS_FIRST_DRAWING "
          "FROM fx_previous_application"))
def q_sentinel_to_null(spark, d):
    t = fx(spark, d, "fx_previous_application").select("SK_ID_PREV", "SK_ID_CURR", "DAYS_FIRST_DRAWING")
    return P.sentinel_to_null_columns(t, ["DAYS_FIRST_DRAWING"])


def _ratio_sql(finite: bool) -> str:
    items = []
    for n, (a, b) in RATIOS.items():
        e = f"{a} / {b}"
        items.append((O.finite(e) if finite else O.nan_to_null(e)) + f" AS {n}")
    return rep(f"SELECT SK_ID_CURR, {', '.join(items)} FROM fx_application", list(RATIOS), ["SK_ID_CURR"])


@register("nonfinite_to_null", sql(["fx_application"], _ratio_sql(True)))
def q_nonfinite_to_null(spark, d):
    t = P.ratio_features(fx(spark, d, "fx_application"), RATIOS).select("SK_ID_CURR", *RATIOS)
    return report(P.nonfinite_to_null(t))


@register("ratio_features", sql(["fx_application"], _ratio_sql(False)))
def q_ratio_features(spark, d):
    return report(P.ratio_features(fx(spark, d, "fx_application"), RATIOS).select("SK_ID_CURR", *RATIOS))


DIFFS = {"PAYMENT_DIFF": ("AMT_INSTALMENT", "AMT_PAYMENT"), "DPD_RAW": ("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"),
         "DBD_RAW": ("DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT")}


@register("difference_features", sql(["fx_installments"], rep(
    "SELECT SK_ID_CURR, " + ", ".join(f"{a} - {b} AS {n}" for n, (a, b) in DIFFS.items()) + " FROM fx_installments",
    list(DIFFS), ["SK_ID_CURR"])))
def q_difference_features(spark, d):
    return report(P.difference_features(fx(spark, d, "fx_installments"), DIFFS).select("SK_ID_CURR", *DIFFS))


@register("clip_at_zero", sql(["fx_installments"], rep(
    "SELECT SK_ID_CURR, DPD, DBD FROM " + O.installments_source(), ["DPD", "DBD"], ["SK_ID_CURR"])))
def q_clip_at_zero(spark, d):
    t = P.difference_features(fx(spark, d, "fx_installments"), {"DPD": DIFFS["DPD_RAW"], "DBD": DIFFS["DBD_RAW"]})
    return report(P.clip_at_zero_columns(t, ["DPD", "DBD"]).select("SK_ID_CURR", "DPD", "DBD"))


PREV_DOUBLES = ["AMT_APPLICATION", "AMT_CREDIT", "RATE_DOWN_PAYMENT", "CNT_PAYMENT", "DAYS_DECISION", "DAYS_FIRST_DRAWING"]


@register("drop_columns", sql(["fx_previous_application"], rep(
    "SELECT * EXCLUDE (SK_ID_PREV) FROM fx_previous_application", PREV_DOUBLES, ["SK_ID_CURR", "NAME_CONTRACT_STATUS"])))
def q_drop_columns(spark, d):
    return report(P.drop_columns(fx(spark, d, "fx_previous_application"), ["SK_ID_PREV", "NOT_A_COLUMN"]))


@register("select_features", sql(ALL_FX, rep(
    f"SELECT {', '.join(q(c) for c in SELECTED)}, SK_ID_CURR FROM features",
    [c for c in SELECTED if c != "POS_COUNT"], ["SK_ID_CURR", "POS_COUNT"]), FEAT_CTE))
def q_select_features(spark, d):
    return report(P.select_features(features(spark, d), SELECTED, "SK_ID_CURR"))


@register("select_features_file", sql(ALL_FX, rep(
    f"SELECT {', '.join(q(c) for c in SELECTED)}, SK_ID_CURR FROM features",
    [c for c in SELECTED if c != "POS_COUNT"], ["SK_ID_CURR", "POS_COUNT"]), FEAT_CTE))
def q_select_features_file(spark, d):
    """P9 with the feature list of a JSON file."""
    path = scratch_path(spark, f"settings-{uuid.uuid4().hex}")
    spark.createDataFrame([(json.dumps({"most_important_features": SELECTED}),)], "value string").coalesce(1).write.text(path)
    return report(P.select_features(features(spark, d), read_settings(spark, path).features, "SK_ID_CURR"))


APP_OUT = [c for c, _ in APP_COLS]


_BURO_NAMES = [c for c, _ in O.bureau_sql()[1] if c != "SK_ID_CURR"]


@register("flatten_agg_names", sql(["fx_bureau", "fx_bureau_balance"], rep(
    "SELECT SK_ID_CURR, name, value FROM (SELECT SK_ID_CURR, " + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in _BURO_NAMES)
    + f" FROM ({O.bureau_sql()[0]})) UNPIVOT INCLUDE NULLS (value FOR name IN (" + ", ".join(q(c) for c in _BURO_NAMES) + "))",
    ["value"], ["SK_ID_CURR", "name"])))
def q_flatten_agg_names(spark, d):
    """P10: the bureau block under its flattened ``<PREFIX><column>_<FUNC>`` names, a row per client and name."""
    blk = B.bureau_block(fx(spark, d, "fx_bureau"), fx(spark, d, "fx_bureau_balance"))
    return report(P.transpose_client(blk, "SK_ID_CURR").withColumnRenamed("feature", "name"))


PREV_ALL = ["SK_ID_PREV", "SK_ID_CURR", "NAME_CONTRACT_STATUS", "AMT_APPLICATION", "AMT_CREDIT", "RATE_DOWN_PAYMENT", "CNT_PAYMENT",
            "DAYS_DECISION", "DAYS_FIRST_DRAWING"]


@register("split_columns_by_type", sql(["fx_previous_application"], " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", typeof(max({c})) = 'VARCHAR' AS is_string, count({c}) AS n_filled FROM fx_previous_application" for c in PREV_ALL)))
def q_split_columns_by_type(spark, d):
    """String (categorical) versus other columns of a table, with the number of rows that fill each."""
    t = fx(spark, d, "fx_previous_application")
    strings, _ = P.split_columns_by_type(t)
    filled = A.long_row(t.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(t.columns)]), t.columns, "n_filled")
    return filled.select("column", F.col("column").isin(strings).alias("is_string"), "n_filled")


def _distinct_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {q(c)}) <= 2 THEN 'categorical' ELSE 'numeric' END AS kind "
        f"FROM {table}" for c in cols)


@register("split_columns_by_cardinality", sql(["fx_application"], _distinct_sql("app", APP_OUT), APP_CTE))
def q_split_columns_by_cardinality(spark, d):
    return P.split_columns_by_cardinality(app(spark, d), APP_OUT)


FEAT_OUT = [c for c, _ in FEAT_COLS]


def _fill_sql(table: str, cols: list[str], min_fill: float | None) -> str:
    parts = []
    for c in cols:
        fr = f"avg(CASE WHEN {q(c)} IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
        kept = f", {fr} >= {min_fill} AS kept" if min_fill is not None else ""
        parts.append(f"SELECT '{c}' AS \"column\", {fr} AS fill_rate{kept} FROM {table}")
    return " UNION ALL ".join(parts)


@register("drop_sparse_columns", sql(ALL_FX, _fill_sql("features", FEAT_OUT, 0.6), FEAT_CTE))
def q_drop_sparse_columns(spark, d):
    return P.sparse_column_report(features(spark, d), 0.6, FEAT_OUT)


@register("drop_null_rows", sql(["fx_application"],
          "SELECT SK_ID_CURR, CODE_GENDER, CNT_FAM_MEMBERS FROM fx_application "
          "WHERE CODE_GENDER IS NOT NULL AND CNT_FAM_MEMBERS IS NOT NULL"))
def q_drop_null_rows(spark, d):
    t = fx(spark, d, "fx_application").select("SK_ID_CURR", "CODE_GENDER", "CNT_FAM_MEMBERS")
    return P.drop_null_rows(t, ["CODE_GENDER", "CNT_FAM_MEMBERS"])


@register("fill_zero", sql(["fx_bureau"], rep(
    "SELECT SK_ID_BUREAU, coalesce(AMT_CREDIT_SUM_DEBT, CAST(0 AS DOUBLE)) AS AMT_CREDIT_SUM_DEBT FROM fx_bureau",
    ["AMT_CREDIT_SUM_DEBT"], ["SK_ID_BUREAU"])))
def q_fill_zero(spark, d):
    return report(P.fill_zero(fx(spark, d, "fx_bureau").select("SK_ID_BUREAU", "AMT_CREDIT_SUM_DEBT"), ["AMT_CREDIT_SUM_DEBT"]))


@register("downcast_float", sql(["fx_bureau"],
          "SELECT SK_ID_BUREAU, CAST(AMT_CREDIT_SUM AS FLOAT) AS AMT_CREDIT_SUM FROM fx_bureau"))
def q_downcast_float(spark, d):
    return P.downcast_float(fx(spark, d, "fx_bureau").select("SK_ID_BUREAU", "AMT_CREDIT_SUM"))


@register("filter_one_client", sql(["fx_application", "fx_installments"], rep(
    f"SELECT SK_ID_CURR, NUM_INSTALMENT_VERSION, AMT_PAYMENT FROM fx_installments WHERE SK_ID_CURR IN ({ids_sample_sql(0.05, 3)})",
    ["AMT_PAYMENT"], ["SK_ID_CURR", "NUM_INSTALMENT_VERSION"])))
def q_filter_one_client(spark, d):
    t = fx(spark, d, "fx_installments").select("SK_ID_CURR", "NUM_INSTALMENT_VERSION", "AMT_PAYMENT")
    return report(P.filter_clients(t, ids_sample(spark, d, 0.05, 3)))


TOP_SET = ["PAYMENT_RATE", "DAYS_BIRTH", "AMT_CREDIT"]


@register("top_feature_rows", sql(["fx_application"], rep(
    "SELECT * FROM vl WHERE feature IN (" + ", ".join(f"'{f}'" for f in TOP_SET) + ")", ["value"], ["SK_ID_CURR", "feature"]),
    APP_CTE + [("vl", VL_SQL)]))
def q_top_feature_rows(spark, d):
    fs = spark.createDataFrame([(f,) for f in TOP_SET], "feature string")
    return report(P.top_feature_rows(values_long(spark, d), fs))


@register("transpose_client", sql(["fx_application"], rep("SELECT * FROM vl", ["value"], ["SK_ID_CURR", "feature"]),
                                  APP_CTE + [("vl", VL_SQL)]))
def q_transpose_client(spark, d):
    return report(values_long(spark, d))


# ---- 2.3 encoding --------------------------------------------------------------------------------------

BUREAU_NUM = ["DAYS_CREDIT", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"]


def _one_hot_sql():
    dummies = [f for c in ("CREDIT_ACTIVE", "CREDIT_TYPE") for f in O.dummies(c, O.VOCAB[c])]
    body = ("SELECT SK_ID_CURR, SK_ID_BUREAU, " + ", ".join(BUREAU_NUM) + ", "
            + ", ".join(f"{f.expr} AS {q(f.name)}" for f in dummies) + " FROM fx_bureau")
    return rep(body, BUREAU_NUM, ["SK_ID_CURR", "SK_ID_BUREAU"] + [f.name for f in dummies])


@register("one_hot", sql(["fx_bureau"], _one_hot_sql()))
def q_one_hot(spark, d):
    out, _ = E.one_hot(fx(spark, d, "fx_bureau"), ["CREDIT_ACTIVE", "CREDIT_TYPE"], null_category=True)
    return report(out)


@register("factorize", sql(["fx_application"],
          "SELECT SK_ID_CURR, CASE CODE_GENDER WHEN 'F' THEN 0 WHEN 'M' THEN 1 WHEN 'XNA' THEN 2 ELSE -1 END AS CODE_GENDER "
          "FROM fx_application"))
def q_factorize(spark, d):
    return E.factorize(fx(spark, d, "fx_application").select("SK_ID_CURR", "CODE_GENDER"), ["CODE_GENDER"], {"CODE_GENDER": ["F", "M", "XNA"]})


@register("factorize_dictionary",
          "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY day) - 1 AS BIGINT) AS day, CASE WHEN clerk IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY clerk NULLS LAST) - 1 AS BIGINT) END AS clerk "
          "FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'clerk ' || CAST(o_orderkey * 7919 % 1000003 AS VARCHAR) END AS clerk FROM orders)")
def q_factorize_dictionary(spark, d):
    """E2 on columns of many values: codes from the distributed dictionary."""
    t = load_table(spark, d, "orders").selectExpr(
        "o_orderkey", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'clerk ' || CAST(o_orderkey * 7919 % 1000003 AS STRING) END AS clerk")
    return E.factorize(t, ["day", "clerk"])


@register("one_hot_sparse", sql(["fx_bureau"],
          "SELECT SK_ID_BUREAU, list_sort([CASE WHEN CREDIT_ACTIVE IS NULL THEN na ELSE ca END, na + 1 + CASE WHEN CREDIT_TYPE IS NULL THEN nt ELSE ct END])[1] AS first_index, "
          "list_sort([CASE WHEN CREDIT_ACTIVE IS NULL THEN na ELSE ca END, na + 1 + CASE WHEN CREDIT_TYPE IS NULL THEN nt ELSE ct END])[2] AS second_index, CAST(na + nt + 2 AS BIGINT) AS width "
          "FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY CREDIT_ACTIVE NULLS LAST) - 1 AS BIGINT) AS ca, CAST(dense_rank() OVER (ORDER BY CREDIT_TYPE NULLS LAST) - 1 AS BIGINT) AS ct FROM fx_bureau), "
          "(SELECT count(DISTINCT CREDIT_ACTIVE) AS na, count(DISTINCT CREDIT_TYPE) AS nt FROM fx_bureau)"))
def q_one_hot_sparse(spark, d):
    """E1 as positions instead of columns."""
    out, width = E.one_hot_sparse(fx(spark, d, "fx_bureau").select("SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"), ["CREDIT_ACTIVE", "CREDIT_TYPE"])
    return out.select("SK_ID_BUREAU", F.col("indices")[0].alias("first_index"), F.col("indices")[1].alias("second_index"), F.lit(width).cast("long").alias("width"))


def _share_sql():
    s, cols = O.block_sql("fx_bureau", "SK_ID_CURR", O.dummies("CREDIT_TYPE", O.VOCAB["CREDIT_TYPE"]), "")
    return O.report_wrap(s, cols, ["SK_ID_CURR"])


@register("category_share", sql(["fx_bureau"], _share_sql()))
def q_category_share(spark, d):
    return report(E.category_share(fx(spark, d, "fx_bureau"), "SK_ID_CURR", ["CREDIT_TYPE"]))


@register("category_share_long", sql(["fx_bureau"], rep(
    "SELECT c.SK_ID_CURR, c.\"column\", c.value, CAST(c.n AS DOUBLE) / CAST(t.n AS DOUBLE) AS share FROM ("
    "SELECT SK_ID_CURR, 'CREDIT_TYPE' AS \"column\", CREDIT_TYPE AS value, count(*) AS n FROM fx_bureau GROUP BY 1, 3 UNION ALL "
    "SELECT SK_ID_CURR, 'CREDIT_ACTIVE', CREDIT_ACTIVE, count(*) FROM fx_bureau GROUP BY 1, 3) c "
    "JOIN (SELECT SK_ID_CURR, count(*) AS n FROM fx_bureau GROUP BY 1) t USING (SK_ID_CURR)", ["share"], ["SK_ID_CURR", "column", "value"])))
def q_category_share_long(spark, d):
    """E3 without a vocabulary: a row per client and value."""
    return report(E.category_share_long(fx(spark, d, "fx_bureau"), "SK_ID_CURR", ["CREDIT_TYPE", "CREDIT_ACTIVE"]))


# ---- 2.4 joins ---------------------------------------------------------------------------------------------

BB_OUT = ["MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX", "MONTHS_BALANCE_SIZE"]
BB_SHARES = ["STATUS_0_MEAN", "STATUS_C_MEAN", "STATUS_X_MEAN", "STATUS_nan_MEAN"]


@register("join_child_aggregate", sql(["fx_bureau", "fx_bureau_balance"], rep(
    f"SELECT b.* EXCLUDE (SK_ID_BUREAU), a.* EXCLUDE (SK_ID_BUREAU) FROM fx_bureau b LEFT JOIN ({O.bureau_balance_sql()[0]}) a "
    "USING (SK_ID_BUREAU)", BUREAU_NUM + BB_SHARES, ["SK_ID_CURR", "CREDIT_ACTIVE", "CREDIT_TYPE"] + BB_OUT)))
def q_join_child_aggregate(spark, d):
    joined, _ = B.bureau_with_balance(fx(spark, d, "fx_bureau"), fx(spark, d, "fx_bureau_balance"))
    return report(joined)


SUBSET_SPEC = {"DAYS_CREDIT": ["min", "max", "mean", "var"], "AMT_CREDIT_SUM": ["sum"], "AMT_CREDIT_SUM_DEBT": ["sum", "size"]}


def _subset_sql():
    cols = {c: (c, False) for c in BUREAU_NUM}
    s, sc = O.group_sql("fx_bureau", "SK_ID_CURR", O.spec(cols, SUBSET_SPEC), "ACTIVE_", where="CREDIT_ACTIVE = 'Active'")
    body = f"SELECT a.SK_ID_CURR, s.* EXCLUDE (SK_ID_CURR) FROM fx_application a LEFT JOIN ({s}) s USING (SK_ID_CURR)"
    return O.report_wrap(body, sc, ["SK_ID_CURR"])


@register("join_subset_aggregate", sql(["fx_application", "fx_bureau"], _subset_sql()))
def q_join_subset_aggregate(spark, d):
    bureau = fx(spark, d, "fx_bureau")
    base = fx(spark, d, "fx_application").select("SK_ID_CURR")
    out = J.join_subset_aggregate(base, bureau, "SK_ID_CURR", A.spec_features(bureau, SUBSET_SPEC), "ACTIVE_",
                                  "CREDIT_ACTIVE = 'Active'")
    return report(out)


@register("semi_join_ids", sql(["fx_application", "fx_bureau"],
          f"SELECT SK_ID_CURR, SK_ID_BUREAU, CREDIT_ACTIVE FROM fx_bureau WHERE SK_ID_CURR IN ({ids_sample_sql(0.1, 5)})"))
def q_semi_join_ids(spark, d):
    t = fx(spark, d, "fx_bureau").select("SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE")
    return J.semi_join_ids(t, ids_sample(spark, d, 0.1, 5))


@register("semi_join_two_hops", sql(["fx_application", "fx_bureau", "fx_bureau_balance"],
          "SELECT * FROM fx_bureau_balance WHERE SK_ID_BUREAU IN (SELECT SK_ID_BUREAU FROM fx_bureau WHERE SK_ID_CURR IN "
          f"({ids_sample_sql(0.1, 5)}))"))
def q_semi_join_two_hops(spark, d):
    return J.semi_join_two_hops(fx(spark, d, "fx_bureau_balance"), fx(spark, d, "fx_bureau"), ids_sample(spark, d, 0.1, 5))


@register("raw_join", sql(["fx_application", "fx_bureau", "fx_bureau_balance"], rep(
    "SELECT a.SK_ID_CURR, a.TARGET, a.AMT_CREDIT, a.DAYS_BIRTH, b.CREDIT_ACTIVE, b.DAYS_CREDIT, b.AMT_CREDIT_SUM, "
    "bb.MONTHS_BALANCE, bb.STATUS FROM fx_application a JOIN fx_bureau b ON a.SK_ID_CURR = b.SK_ID_CURR "
    "JOIN fx_bureau_balance bb ON b.SK_ID_BUREAU = bb.SK_ID_BUREAU",
    ["AMT_CREDIT", "DAYS_BIRTH", "DAYS_CREDIT", "AMT_CREDIT_SUM"], ["SK_ID_CURR", "TARGET", "CREDIT_ACTIVE",
                                                                    "MONTHS_BALANCE", "STATUS"])))
def q_raw_join(spark, d):
    a = fx(spark, d, "fx_application").select("SK_ID_CURR", "TARGET", "AMT_CREDIT", "DAYS_BIRTH")
    b = fx(spark, d, "fx_bureau").select("SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "DAYS_CREDIT", "AMT_CREDIT_SUM")
    return report(J.raw_join(a, b, fx(spark, d, "fx_bureau_balance")))


def _root_sql(col: str) -> str:
    head = "^(" + "|".join(BLOCK_PREFIXES) + ")_"
    tail = "_(" + "|".join(AGG_SUFFIXES) + ")$"
    return f"regexp_replace(regexp_replace({col}, '{head}', ''), '{tail}', '')"


@register("join_dictionary", sql(ALL_FX,
          f"SELECT n.SK_ID_CURR, n.rank, n.feature, d.Description AS description FROM (SELECT *, {_root_sql('feature')} AS root FROM stop) n "
          "LEFT JOIN dict d ON n.root = d.Row", STORED_CTE + [("dict", FX.dictionary_sql())]))
def q_join_dictionary(spark, d):
    """The strongest stored attributions of every client with the description of their source column."""
    keyed = stored_top(spark, d).select("SK_ID_CURR", "rank", F.col("feature").alias("name"), feature_root_name("feature").alias("feature"))
    return J.join_dictionary(keyed, FX.dictionary_frame(spark)).select("SK_ID_CURR", "rank", F.col("name").alias("feature"), "description")


@register("self_lookup_by_id", sql(ALL_FX, rep(
    f"SELECT SK_ID_CURR, feature, phi FROM szl WHERE SK_ID_CURR IN ({ids_sample_sql(0.02, 11)})", ["phi"], ["SK_ID_CURR", "feature"]), STORED_CTE))
def q_self_lookup_by_id(spark, d):
    """The stored explanation of requested clients, found by id."""
    stored = written(stored_attributions(spark, d), "attributions")
    return report(J.lookup_by_id(stored, ids_sample(spark, d, 0.02, 11)))


# ---- 2.5 aggregations -------------------------------------------------------------------------------

AGG_SPEC = {"DAYS_CREDIT": list(A.FUNCS), "AMT_CREDIT_SUM_DEBT": list(A.FUNCS)}


def _agg_spec_sql():
    s, cols = O.block_sql("fx_bureau", "SK_ID_CURR", O.spec({c: (c, False) for c in BUREAU_NUM}, AGG_SPEC), "B_")
    return O.report_wrap(s, cols, ["SK_ID_CURR"])


@register("agg_spec", sql(["fx_bureau"], _agg_spec_sql()))
def q_agg_spec(spark, d):
    return report(A.agg_spec(fx(spark, d, "fx_bureau"), "SK_ID_CURR", AGG_SPEC, "B_"))


def _block_subset(body_cols, prefixes: tuple[str, ...], views: list[str]):
    body, cols = body_cols
    keep = [(n, k) for n, k in cols if n.startswith(prefixes)]
    return sql(views, O.report_wrap(f"SELECT SK_ID_CURR, {', '.join(q(n) for n, _ in keep)} FROM ({body}) x", keep, ["SK_ID_CURR"]))


def _spark_subset(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return report(df.select("SK_ID_CURR", *[F.col(f"`{c}`") for c in df.columns if c.startswith(prefixes)]))


@register("bureau_active_closed", _block_subset(O.bureau_sql(), ("ACTIVE_", "CLOSED_"), ["fx_bureau", "fx_bureau_balance"]))
def q_bureau_active_closed(spark, d):
    return _spark_subset(B.bureau_block(fx(spark, d, "fx_bureau"), fx(spark, d, "fx_bureau_balance")), ("ACTIVE_", "CLOSED_"))


@register("two_level_aggregate", _block_subset(O.bureau_sql(False), ("BURO_MONTHS_BALANCE_", "BURO_STATUS_"),
                                               ["fx_bureau", "fx_bureau_balance"]))
def q_two_level_aggregate(spark, d):
    blk = B.bureau_block(fx(spark, d, "fx_bureau"), fx(spark, d, "fx_bureau_balance"), subsets=False)
    return _spark_subset(blk, ("BURO_MONTHS_BALANCE_", "BURO_STATUS_"))


@register("previous_approved_refused", _block_subset(O.previous_sql(), ("APPROVED_", "REFUSED_"), ["fx_previous_application"]))
def q_previous_approved_refused(spark, d):
    return _spark_subset(B.previous_block(fx(spark, d, "fx_previous_application")), ("APPROVED_", "REFUSED_"))


@register("group_count", sql(["fx_installments"], 'SELECT SK_ID_CURR, count(*) AS "COUNT" FROM fx_installments GROUP BY SK_ID_CURR'))
def q_group_count(spark, d):
    return A.group_count(fx(spark, d, "fx_installments"), "SK_ID_CURR")


@register("distinct_ids", sql(["fx_previous_application"], "SELECT DISTINCT SK_ID_CURR FROM fx_previous_application"))
def q_distinct_ids(spark, d):
    return A.distinct_ids(fx(spark, d, "fx_previous_application"), "SK_ID_CURR")


@register("class_balance", sql(["fx_application"], rep(
    "SELECT TARGET, n, CAST(n AS DOUBLE) / sum(n) OVER () AS share, CAST(max(n) OVER () AS DOUBLE) / min(n) OVER () "
    "AS majority_minority_ratio FROM (SELECT TARGET, count(*) AS n FROM fx_application GROUP BY TARGET)",
    ["share", "majority_minority_ratio"], ["TARGET", "n"])))
def q_class_balance(spark, d):
    return report(A.class_balance(fx(spark, d, "fx_application"), "TARGET"))


FOLDS = 3


def _fold_importance(spark, d) -> DataFrame:
    a = G.kfold(app(spark, d), FOLDS, "SK_ID_CURR", 2)
    parts = [P.distinct_counts(a.where(F.col("fold") == f), Z_FEATURES)
             .select(F.col("column").alias("feature"), F.lit(f).alias("fold"), F.col("n_distinct").cast("double").alias("importance"))
             for f in range(FOLDS)]
    return W.union_folds(parts)


def _fold_importance_sql() -> str:
    fold = f"CAST({parity_hash_sql('SK_ID_CURR', 2)} % {FOLDS} AS INTEGER)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {f} AS fold, CAST(count(DISTINCT {q(c)}) AS DOUBLE) AS importance FROM app WHERE {fold} = {f}"
        for f in range(FOLDS) for c in Z_FEATURES)


@register("union_folds", sql(["fx_application"], _fold_importance_sql(), APP_CTE))
def q_union_folds(spark, d):
    return _fold_importance(spark, d)


@register("mean_importance", sql(["fx_application"], rep(
    "SELECT feature, avg(importance) AS importance FROM fi GROUP BY feature", ["importance"], ["feature"]),
    APP_CTE + [("fi", _fold_importance_sql())]))
def q_mean_importance(spark, d):
    return report(A.mean_importance(_fold_importance(spark, d)))


@register("contingency", sql(["fx_bureau"],
          "SELECT CASE WHEN grouping(CREDIT_ACTIVE) = 1 THEN 'Total' ELSE CREDIT_ACTIVE END AS CREDIT_ACTIVE, "
          "CASE WHEN grouping(CREDIT_TYPE) = 1 THEN 'Total' ELSE CREDIT_TYPE END AS CREDIT_TYPE, count(*) AS n "
          "FROM fx_bureau WHERE CREDIT_ACTIVE IS NOT NULL AND CREDIT_TYPE IS NOT NULL GROUP BY CUBE (CREDIT_ACTIVE, CREDIT_TYPE)"))
def q_contingency(spark, d):
    return A.contingency(fx(spark, d, "fx_bureau"), "CREDIT_ACTIVE", "CREDIT_TYPE")


@register("fill_rate", sql(ALL_FX, _fill_sql("features", FEAT_OUT, None), FEAT_CTE))
def q_fill_rate(spark, d):
    return A.fill_rate(features(spark, d), FEAT_OUT)


@register("fill_rate_nan", sql(["fx_bureau"], _fill_sql("nb", NAN_COLS, None), NAN_CTE))
def q_fill_rate_nan(spark, d):
    """A16 on a column with NaN: a NaN isn't a value."""
    return A.fill_rate(nan_bureau(spark, d), NAN_COLS)


@register("mean_prediction", sql([], rep("SELECT avg(CAST(y AS DOUBLE)) AS mean_label, avg(p) AS mean_probability FROM scores",
                                        ["mean_label", "mean_probability"]), SCORES_CTE))
def q_mean_prediction(spark, d):
    return report(M.mean_prediction(scores(spark, d), "y", "p"))


# ---- 2.6 sorts, limits, windows ------------------------------------------------------------------------

def _importance(spark, d) -> DataFrame:
    """Mean |phi| per feature (X4) at report precision."""
    return report(X.global_attribution(z_long(spark, d)).select("feature", F.col("mean_abs_phi").alias("importance")))


IMP_CTE = ZL_CTE + [("imp", f"SELECT feature, {round_sig_sql('avg(abs(phi))')} AS importance FROM zl GROUP BY feature")]
NORM_SQL = ("SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature ASC) AS rank, "
            "CAST(importance AS DOUBLE) / CAST(sum(importance) OVER () AS DOUBLE) AS importance_normalized, "
            "CAST(sum(importance) OVER (ORDER BY importance DESC, feature ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)"
            " / CAST(sum(importance) OVER () AS DOUBLE) AS cumulative_importance FROM imp")


@register("top_importances", sql(["fx_application"], "SELECT * FROM imp ORDER BY importance DESC, feature ASC LIMIT 10", IMP_CTE))
def q_top_importances(spark, d):
    return W.top_importances(_importance(spark, d), 10)


@register("normalised_cumulative_importance", sql(["fx_application"], rep(
    NORM_SQL, ["importance", "importance_normalized", "cumulative_importance"], ["feature", "rank"]), IMP_CTE))
def q_normalised_cumulative_importance(spark, d):
    return report(W.normalised_cumulative_importance(_importance(spark, d)))


@register("select_by_cumulative_importance", sql(["fx_application"], rep(
    f"SELECT * FROM ({NORM_SQL}) WHERE cumulative_importance < 0.99", ["importance", "importance_normalized", "cumulative_importance"],
    ["feature", "rank"]), IMP_CTE))
def q_select_by_cumulative_importance(spark, d):
    return report(W.select_by_cumulative_importance(_importance(spark, d), 0.99))


RANK_SQL = "SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(phi) DESC, feature ASC) AS rank FROM zl"
RANKR_SQL = RANK_SQL.replace("FROM zl", "FROM zlr")
TOPK = 10


@register("top_k_per_client", sql(["fx_application"], rep(
    f"SELECT * FROM ({RANK_SQL}) WHERE rank <= {TOPK}", ["phi"], ["SK_ID_CURR", "feature", "rank"]), ZL_CTE))
def q_top_k_per_client(spark, d):
    return report(W.top_k_per_client(z_long(spark, d), TOPK))


@register("rest_bucket", sql(["fx_application"], rep(
    f"SELECT SK_ID_CURR, coalesce(sum(CASE WHEN rank > {TOPK} THEN phi END), CAST(0 AS DOUBLE)) AS rest, "
    f"count(CASE WHEN rank > {TOPK} THEN 1 END) AS n_rest FROM ({RANKR_SQL}) GROUP BY SK_ID_CURR", ["rest"],
    ["SK_ID_CURR", "n_rest"]), ZL_CTE))
def q_rest_bucket(spark, d):
    return report(W.rest_bucket(z_long_rounded(spark, d), TOPK))


BASE = 0.5


@register("waterfall_steps", sql(["fx_application"], rep(
    f"""SELECT SK_ID_CURR, step, label, phi, sum(phi) OVER (PARTITION BY SK_ID_CURR ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM (
      SELECT SK_ID_CURR, 0 AS step, 'base' AS label, CAST({BASE} AS DOUBLE) AS phi FROM (SELECT DISTINCT SK_ID_CURR FROM zlr)
      UNION ALL SELECT SK_ID_CURR, 1, 'rest', coalesce(sum(CASE WHEN rank > {TOPK} THEN phi END), CAST(0 AS DOUBLE))
        FROM r GROUP BY SK_ID_CURR
      UNION ALL SELECT SK_ID_CURR, CAST(count(*) OVER (PARTITION BY SK_ID_CURR) - rank + 2 AS INTEGER), feature, phi
        FROM r WHERE rank <= {TOPK})""", ["phi", "running"], ["SK_ID_CURR", "step", "label"]), ZL_CTE + [("r", RANKR_SQL)]))
def q_waterfall_steps(spark, d):
    return report(W.waterfall_steps(z_long_rounded(spark, d), BASE, TOPK))


@register("sorted_ids", sql(["fx_bureau"], "SELECT DISTINCT SK_ID_CURR FROM fx_bureau ORDER BY SK_ID_CURR"))
def q_sorted_ids(spark, d):
    return W.sorted_ids(fx(spark, d, "fx_bureau"))


# ---- 2.7 scalar functions -------------------------------------------------------------------------------

@register("feature_root_name", sql(ALL_FX, f"SELECT SK_ID_CURR, rank, feature, {_root_sql('feature')} AS root FROM stop", STORED_CTE))
def q_feature_root_name(spark, d):
    """F1 on the strongest stored attributions of every client."""
    return stored_top(spark, d).select("SK_ID_CURR", "rank", "feature", feature_root_name("feature").alias("root"))


DESCRIBE_SQL = f"""
SELECT n.SK_ID_CURR, n.rank, n.feature, b.description FROM stop n LEFT JOIN (
  SELECT feature, arg_max(Description, len * 2 + prio) AS description FROM (
    SELECT c.feature, c.len, l.Description, l.prio FROM (
      SELECT feature, i AS len, array_to_string(list_slice(toks, 1, i), '_') AS cand
      FROM (SELECT feature, string_split({_root_sql('feature')}, '_') AS toks FROM names),
           LATERAL (SELECT unnest(generate_series(1, len(toks))) AS i) UNION ALL SELECT feature, 1000, feature FROM names) c
    JOIN (SELECT Row, Description, 0 AS prio FROM dict UNION ALL SELECT Row, Description, 1 FROM derived) l ON c.cand = l.Row)
  GROUP BY feature) b USING (feature)"""


@register("describe_features", sql(ALL_FX, DESCRIBE_SQL, STORED_CTE + [("names", "SELECT DISTINCT feature FROM stop"), ("dict", FX.dictionary_sql()),
                                                                        ("derived", FX.derived_sql())]))
def q_describe_features(spark, d):
    """F2 on the strongest stored attributions of every client."""
    top = written(stored_top(spark, d).select("SK_ID_CURR", "rank", "feature"), "top")
    return top.join(V.describe_features(top, FX.dictionary_frame(spark), FX.derived_frame(spark)), "feature", "left").select(
        "SK_ID_CURR", "rank", "feature", "description")


@register("risk_band", sql([], rep(
    "SELECT SK_ID_CURR, p, CASE WHEN p < 0.35 THEN 'none' WHEN p < 0.64 THEN 'substantial' WHEN p IS NOT NULL THEN 'very high' END "
    "AS risk_band FROM scores", ["p"], ["SK_ID_CURR", "risk_band"]), SCORES_CTE))
def q_risk_band(spark, d):
    return report(M.risk_bands(scores(spark, d), "p", ["SK_ID_CURR"]))


POS_WEIGHT = 12.5


_CLIP = f"least(greatest(p, CAST({LOG_LOSS_EPS!r} AS DOUBLE)), CAST({1.0 - LOG_LOSS_EPS!r} AS DOUBLE))"
EDGE_CTE = SCORES_CTE + [("edge", "SELECT y, CASE WHEN SK_ID_CURR % 41 = 0 THEN CAST(0 AS DOUBLE) WHEN SK_ID_CURR % 41 = 1 THEN CAST(1 AS DOUBLE) "
                                  "ELSE p END AS p FROM scores")]


@register("log_loss", sql([], rep(
    f"SELECT sum(t) AS log_loss_sum, avg(t) AS log_loss_mean FROM (SELECT -(CAST({POS_WEIGHT} AS DOUBLE) * CAST(y AS DOUBLE) * ln({_CLIP}) "
    f"+ (CAST(1 AS DOUBLE) - CAST(y AS DOUBLE)) * ln(CAST(1 AS DOUBLE) - {_CLIP})) AS t FROM edge)",
    ["log_loss_sum", "log_loss_mean"]), EDGE_CTE))
def q_log_loss(spark, d):
    """F4 on scores of which some are exactly 0 or 1."""
    k = F.col("SK_ID_CURR") % 41
    edge = scores(spark, d).withColumn("p", F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(F.col("p")))
    return report(M.log_loss(edge, "y", "p", POS_WEIGHT))


# ---- 2.8 statistics -------------------------------------------------------------------------------------


def _corr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            both = f"isfinite(CAST({q(a)} AS DOUBLE)) AND isfinite(CAST({q(b)} AS DOUBLE))"
            x = f"CASE WHEN {both} THEN CAST({q(a)} AS DOUBLE) END"
            y = f"CASE WHEN {both} THEN CAST({q(b)} AS DOUBLE) END"
            r = f"CASE WHEN var_samp({x}) > {C.VAR_TOLERANCE} AND var_samp({y}) > {C.VAR_TOLERANCE} THEN corr({x}, {y}) END"
            parts.append(f"SELECT '{a}' AS col_i, '{b}' AS col_j, {r} AS corr, abs({r}) AS abs_corr, count({x}) AS n FROM {table}")
    return " UNION ALL ".join(parts)


@register("correlation_pairs", sql(["fx_application"], rep(_corr_sql("app", CORR_COLUMNS), ["corr", "abs_corr"],
                                                           ["col_i", "col_j", "n"]), APP_CTE))
def q_correlation_pairs(spark, d):
    return report(C.correlation_pairs(app(spark, d), CORR_COLUMNS))


MATRIX_COLUMNS = FEAT_OUT  # every column of the feature row but the id; the label takes part
_POS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(MATRIX_COLUMNS)) + ") AS t(feature, pos)"
PAIRS_CTE = FEAT_CTE + [
    ("pos", _POS_SQL),
    ("cv", "SELECT SK_ID_CURR, pos, value FROM (SELECT SK_ID_CURR, " + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in MATRIX_COLUMNS)
     + " FROM features) UNPIVOT (value FOR feature IN (" + ", ".join(q(c) for c in MATRIX_COLUMNS) + ")) JOIN pos USING (feature) WHERE isfinite(value)"),
    ("cm", "SELECT pos, avg(value) AS m FROM cv GROUP BY pos"),
    ("cc", "SELECT SK_ID_CURR, pos, value - m AS value FROM cv JOIN cm USING (pos)"),
    ("cp", f"SELECT a.pos AS i, b.pos AS j, CASE WHEN var_samp(a.value) > {C.VAR_TOLERANCE} AND var_samp(b.value) > {C.VAR_TOLERANCE} "
           "THEN corr(a.value, b.value) END AS r, count(*) AS n FROM cc a JOIN cc b ON a.SK_ID_CURR = b.SK_ID_CURR AND a.pos < b.pos GROUP BY 1, 2"),
    # on a grid of 2^-20, so that 20,000 sums in another order print the same
    ("pairs", "SELECT a.feature AS col_i, b.feature AS col_j, floor(r * 1048576 + 0.5) / 1048576 AS corr, "
              "abs(floor(r * 1048576 + 0.5) / 1048576) AS abs_corr, coalesce(n, 0) AS n FROM pos a JOIN pos b ON a.pos < b.pos "
              "LEFT JOIN cp ON cp.i = a.pos AND cp.j = b.pos")]


def _all_pairs(spark, d) -> DataFrame:
    r = F.floor(F.col("corr") * F.lit(1048576.0) + F.lit(0.5)) / F.lit(1048576.0)
    return C.correlation_matrix_pairs(features(spark, d), MATRIX_COLUMNS).select("col_i", "col_j", r.alias("corr"), F.abs(r).alias("abs_corr"), "n")


@register("correlation_matrix_pairs", sql(ALL_FX, "SELECT * FROM pairs", PAIRS_CTE))
def q_correlation_matrix_pairs(spark, d):
    return _all_pairs(spark, d)


def _names_values(cols: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(cols)) + ") AS t(\"column\", pos)"


@register("prune_correlated", sql(ALL_FX,
          "SELECT n.\"column\", EXISTS (SELECT 1 FROM pairs p WHERE p.col_j = n.\"column\" AND p.abs_corr > 0.8) AS dropped FROM names n",
          PAIRS_CTE + [("names", _names_values(MATRIX_COLUMNS))]))
def q_prune_correlated(spark, d):
    """C2 on the whole feature row: which columns ``prune_correlated`` drops."""
    f = written(features(spark, d), "features")
    _, dropped = C.prune_correlated(f, 0.8)
    return f.sparkSession.createDataFrame([(c, c in set(dropped)) for c in MATRIX_COLUMNS], "column string, dropped boolean")


@register("anova", sql(["fx_bureau"], rep("""
SELECT (ssb / CAST(n_groups - 1 AS DOUBLE)) / (ssw / CAST(n_rows - n_groups AS DOUBLE)) AS f_stat, ssb / (ssb + ssw) AS eta_sq,
  CAST(n_groups - 1 AS BIGINT) AS df_between, CAST(n_rows - n_groups AS BIGINT) AS df_within, ssb AS ss_between, ssw AS ss_within FROM (
  SELECT sum(n * (m - grand) * (m - grand)) AS ssb, sum((n - 1) * v) AS ssw, max(n_rows) AS n_rows, max(n_groups) AS n_groups FROM (
    SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand, sum(n) OVER () AS n_rows, count(*) OVER () AS n_groups FROM (
      SELECT CREDIT_TYPE, count(*) AS n, avg(AMT_CREDIT_SUM) AS m, coalesce(var_samp(AMT_CREDIT_SUM), 0) AS v
      FROM fx_bureau WHERE AMT_CREDIT_SUM IS NOT NULL AND CREDIT_TYPE IS NOT NULL GROUP BY CREDIT_TYPE)))""",
    ["f_stat", "eta_sq", "ss_between", "ss_within"], ["df_between", "df_within"])))
def q_anova(spark, d):
    return report(C.anova_table(fx(spark, d, "fx_bureau"), "AMT_CREDIT_SUM", "CREDIT_TYPE"))


@register("anova_p_value")
def q_anova_p_value(spark, d):
    """C3 with its p-value (tail function tested against tabulated values)."""
    return report(C.with_anova_p(C.anova_table(fx(spark, d, "fx_bureau"), "AMT_CREDIT_SUM", "CREDIT_TYPE")))


def _chi2_cells_sql(table: str, x: str, y: str, where: str = "TRUE") -> str:
    return f"""
SELECT g.x, g.y, coalesce(o.observed, 0) AS observed, g.expected, dof FROM (
  SELECT r.x, c.y, CAST(r.rt AS DOUBLE) * CAST(c.ct AS DOUBLE) / CAST(t.n AS DOUBLE) AS expected,
         (t.nr - 1) * (t.nc - 1) AS dof
  FROM (SELECT x, sum(observed) AS rt FROM cells GROUP BY x) r, (SELECT y, sum(observed) AS ct FROM cells GROUP BY y) c,
       (SELECT sum(observed) AS n, count(DISTINCT x) AS nr, count(DISTINCT y) AS nc FROM cells) t) g
LEFT JOIN cells o ON g.x = o.x AND g.y = o.y"""


def _cells_cte(table: str, x: str, y: str, where: str = "TRUE"):
    return ("cells", f"SELECT CAST({x} AS VARCHAR) AS x, CAST({y} AS VARCHAR) AS y, count(*) AS observed FROM {table} "
                     f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {where} GROUP BY 1, 2")


YATES = ("CASE WHEN dof = 1 THEN (observed - expected) - sign(observed - expected) * least(0.5, abs(observed - expected)) "
         "ELSE observed - expected END")


def _chi2_sql(views, table, x, y, where="TRUE"):
    return sql(views, rep(f"SELECT sum(({YATES}) * ({YATES}) / expected) AS chi2, CAST(max(dof) AS BIGINT) AS dof, "
                          f"CAST(sum(observed) AS BIGINT) AS n FROM g", ["chi2"], ["dof", "n"]),
               [_cells_cte(table, x, y, where), ("g", _chi2_cells_sql(table, x, y))])


@register("chi2_test", _chi2_sql(["fx_application"], "fx_application", "TARGET", "CODE_GENDER", "CODE_GENDER IN ('F', 'M')"))
def q_chi2_test(spark, d):
    a = fx(spark, d, "fx_application").where(F.col("CODE_GENDER").isin("F", "M"))
    return report(C.chi2_table(a, "TARGET", "CODE_GENDER"))


@register("chi2_test_rxc", _chi2_sql(["fx_bureau"], "fx_bureau", "CREDIT_ACTIVE", "CREDIT_TYPE"))
def q_chi2_test_rxc(spark, d):
    return report(C.chi2_table(fx(spark, d, "fx_bureau"), "CREDIT_ACTIVE", "CREDIT_TYPE"))


@register("chi2_contributions", sql(["fx_bureau"], rep(
    "SELECT x AS CREDIT_ACTIVE, y AS CREDIT_TYPE, observed, expected, "
    "((observed - expected) * (observed - expected) / expected) / sum((observed - expected) * (observed - expected) / expected) OVER () "
    "AS share FROM g", ["expected", "share"], ["CREDIT_ACTIVE", "CREDIT_TYPE", "observed"]),
    [_cells_cte("fx_bureau", "CREDIT_ACTIVE", "CREDIT_TYPE"), ("g", _chi2_cells_sql("fx_bureau", "CREDIT_ACTIVE", "CREDIT_TYPE"))]))
def q_chi2_contributions(spark, d):
    return report(C.chi2_grid(fx(spark, d, "fx_bureau"), "CREDIT_ACTIVE", "CREDIT_TYPE"))


# two keys that meet in few of their pairs, so that most cells are empty
_SPARSE_X, _SPARSE_Y = "CAST(o_custkey % 101 AS VARCHAR)", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 997 AS VARCHAR)"


@register("chi2_contributions_sparse", rep(
    "SELECT x, y, observed, expected, (observed - expected) * (observed - expected) / expected / total AS share, empty_cells, "
    "CASE WHEN empty_cells > 0 THEN (n - e) / total ELSE 0 END AS empty_share FROM ("
    "SELECT *, sum(expected) OVER () AS e, sum((observed - expected) * (observed - expected) / expected) OVER () + "
    "CASE WHEN empty_cells > 0 THEN n - sum(expected) OVER () ELSE 0 END AS total FROM ("
    "SELECT x, y, observed, CAST(r AS DOUBLE) * CAST(c AS DOUBLE) / CAST(n AS DOUBLE) AS expected, CAST(n AS DOUBLE) AS n, "
    "CAST(nr * nc - count(*) OVER () AS BIGINT) AS empty_cells FROM ("
    "SELECT x, y, observed, sum(observed) OVER (PARTITION BY x) AS r, sum(observed) OVER (PARTITION BY y) AS c, sum(observed) OVER () AS n "
    f"FROM (SELECT {_SPARSE_X} AS x, {_SPARSE_Y} AS y, count(*) AS observed FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2)), "
    f"(SELECT count(DISTINCT {_SPARSE_X}) AS nr, count(DISTINCT {_SPARSE_Y}) AS nc FROM orders WHERE o_totalprice IS NOT NULL)))",
    ["expected", "share", "empty_share"], ["x", "y", "observed", "empty_cells"]))
def q_chi2_contributions_sparse(spark, d):
    """C5 on two vocabularies whose grid is mostly empty: observed cells, and the empty ones in sum."""
    t = load_table(spark, d, "orders").where("o_totalprice IS NOT NULL").selectExpr(
        "CAST(o_custkey % 101 AS STRING) AS x", "CAST(floor(o_totalprice) % 997 AS STRING) AS y")
    return report(C.chi2_contributions(t, "x", "y"))


_HALF = "CAST(dof / 2 AS BIGINT)"


@register("chi2_p_value", sql(["fx_bureau"], rep(
    f"SELECT chi2, dof, n, exp(-chi2 / 2) * list_sum(list_transform(range(0, {_HALF}), lambda k: pow(chi2 / 2, k) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE))) AS p "
    f"FROM (SELECT sum(({YATES}) * ({YATES}) / expected) AS chi2, CAST(max(dof) AS BIGINT) AS dof, CAST(sum(observed) AS BIGINT) AS n FROM g)",
    ["chi2", "p"], ["dof", "n"]),
    [_cells_cte("fx_bureau", "CREDIT_ACTIVE", "CREDIT_TYPE"), ("g", _chi2_cells_sql("fx_bureau", "CREDIT_ACTIVE", "CREDIT_TYPE"))]))
def q_chi2_p_value(spark, d):
    """C4 with its p-value; for an even number of degrees of freedom SQL has the tail as a finite sum."""
    return report(C.with_chi2_p(C.chi2_table(fx(spark, d, "fx_bureau"), "CREDIT_ACTIVE", "CREDIT_TYPE")))


# ---- 2.9 sampling and splits ---------------------------------------------------------------------------


@register("sample_fraction", sql(["fx_application"], ids_sample_sql(0.2, 0)))
def q_sample_fraction(spark, d):
    return ids_sample(spark, d, 0.2, 0)


@register("sample_n", sql(["fx_application"],
          f"SELECT SK_ID_CURR, TARGET FROM fx_application ORDER BY {parity_hash_sql('SK_ID_CURR', 0)}, SK_ID_CURR LIMIT 100"))
def q_sample_n(spark, d):
    return G.sample_n(fx(spark, d, "fx_application").select("SK_ID_CURR", "TARGET"), 100, "SK_ID_CURR", 0)


@register("random_split", sql(["fx_application"],
          f"SELECT SK_ID_CURR, {parity_hash_sql('SK_ID_CURR', 4)} < {int(0.25 * HASH_MOD)} AS is_test FROM fx_application"))
def q_random_split(spark, d):
    return G.random_split(fx(spark, d, "fx_application").select("SK_ID_CURR"), 0.25, "SK_ID_CURR", 4)


@register("stratified_split", sql(["fx_application"],
          f"SELECT SK_ID_CURR, TARGET, SK_ID_CURR IN ({_test_ids_sql()}) AS is_test FROM fx_application"))
def q_stratified_split(spark, d):
    return G.stratified_split(fx(spark, d, "fx_application").select("SK_ID_CURR", "TARGET"), "TARGET", 0.25, "SK_ID_CURR", 7)


@register("kfold", sql(["fx_application"],
          f"SELECT SK_ID_CURR, CAST({parity_hash_sql('SK_ID_CURR', 1001)} % 10 AS INTEGER) AS fold FROM fx_application"))
def q_kfold(spark, d):
    return G.kfold(fx(spark, d, "fx_application").select("SK_ID_CURR"), 10, "SK_ID_CURR", 1001)


@register("stratified_kfold", sql(["fx_application"],
          f"SELECT SK_ID_CURR, TARGET, CAST((row_number() OVER (PARTITION BY TARGET ORDER BY {parity_hash_sql('SK_ID_CURR', 1001)}, "
          "SK_ID_CURR) - 1) % 5 AS INTEGER) AS fold FROM fx_application"))
def q_stratified_kfold(spark, d):
    return G.kfold(fx(spark, d, "fx_application").select("SK_ID_CURR", "TARGET"), 5, "SK_ID_CURR", 1001, label="TARGET")


@register("stratified_split_null_label", sql(["fx_application"], f"""
SELECT SK_ID_CURR, TARGET, rk <= floor(CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS is_test FROM (SELECT SK_ID_CURR, TARGET,
  row_number() OVER (PARTITION BY TARGET ORDER BY {parity_hash_sql('SK_ID_CURR', 7)}, SK_ID_CURR) AS rk, count(*) OVER (PARTITION BY TARGET) AS n FROM ul)""",
    UNLABELLED_CTE))
def q_stratified_split_null_label(spark, d):
    """Rows without a label are split as a class of their own."""
    return G.stratified_split(unlabelled(spark, d), "TARGET", 0.25, "SK_ID_CURR", 7)


@register("stratified_kfold_null_label", sql(["fx_application"],
          f"SELECT SK_ID_CURR, TARGET, CAST((row_number() OVER (PARTITION BY TARGET ORDER BY {parity_hash_sql('SK_ID_CURR', 1001)}, "
          "SK_ID_CURR) - 1) % 5 AS INTEGER) AS fold FROM ul", UNLABELLED_CTE))
def q_stratified_kfold_null_label(spark, d):
    """Rows without a label get folds as a class of their own."""
    return G.kfold(unlabelled(spark, d), 5, "SK_ID_CURR", 1001, label="TARGET")


# ---- 2.10 imputation ---------------------------------------------------------------------------------------

IMPUTE_COLS = ["DAYS_EMPLOYED", "CNT_FAM_MEMBERS"]


@register("impute_simple", sql(["fx_application"], rep(
    "SELECT SK_ID_CURR, " + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in IMPUTE_COLS) + " FROM app",
    IMPUTE_COLS, ["SK_ID_CURR"]), APP_CTE))
def q_impute_simple(spark, d):
    return report(I.impute_simple(app(spark, d).select("SK_ID_CURR", *IMPUTE_COLS), IMPUTE_COLS, "mean"))


@register("impute_most_frequent", sql(["fx_bureau"], rep(
    "SELECT SK_ID_BUREAU, coalesce(AMT_CREDIT_SUM_DEBT, (SELECT AMT_CREDIT_SUM_DEBT FROM fx_bureau WHERE AMT_CREDIT_SUM_DEBT IS NOT NULL "
    "GROUP BY AMT_CREDIT_SUM_DEBT ORDER BY count(*) DESC, AMT_CREDIT_SUM_DEBT ASC LIMIT 1)) AS AMT_CREDIT_SUM_DEBT FROM fx_bureau",
    ["AMT_CREDIT_SUM_DEBT"], ["SK_ID_BUREAU"])))
def q_impute_most_frequent(spark, d):
    t = fx(spark, d, "fx_bureau").select("SK_ID_BUREAU", "AMT_CREDIT_SUM_DEBT")
    return report(I.impute_simple(t, ["AMT_CREDIT_SUM_DEBT"], "most_frequent"))


def _impute_nan_sql(fill) -> str:
    return sql(["fx_bureau"], rep(f"SELECT SK_ID_BUREAU, {', '.join(f'CAST(coalesce({c}, {fill(c)}) AS DOUBLE) AS {c}' for c in NAN_COLS)} FROM nb",
                                  NAN_COLS, ["SK_ID_BUREAU"]), NAN_CTE)


@register("impute_simple_nan", _impute_nan_sql(lambda c: f"(SELECT avg({c}) FROM nb)"))
def q_impute_simple_nan(spark, d):
    """I1, mean: NaN is filled like NULL, and a whole number's mean isn't truncated."""
    return report(I.impute_simple(nan_bureau(spark, d).select("SK_ID_BUREAU", *NAN_COLS), NAN_COLS, "mean"))


@register("impute_median", _impute_nan_sql(lambda c: f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM nb)"))
def q_impute_median(spark, d):
    """I1, median: exact."""
    return report(I.impute_simple(nan_bureau(spark, d).select("SK_ID_BUREAU", *NAN_COLS), NAN_COLS, "median"))


@register("impute_constant", _impute_nan_sql(lambda c: "-1"))
def q_impute_constant(spark, d):
    """I1, constant."""
    out = I.impute_simple(nan_bureau(spark, d).select("SK_ID_BUREAU", *NAN_COLS), NAN_COLS, "constant", -1.0)
    return report(out.withColumn("CNT_PROLONG", F.col("CNT_PROLONG").cast("double")))


@register("cleanup", sql(ALL_FX, rep("SELECT u.SK_ID_CURR, u.feature, u.value FROM u JOIN kept USING (feature) JOIN whole USING (SK_ID_CURR)", ["value"],
                                     ["SK_ID_CURR", "feature"]),
    FEAT_CTE + [("u", "SELECT SK_ID_CURR, feature, value FROM (SELECT SK_ID_CURR, " + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in FEAT_OUT)
                 + " FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(q(c) for c in FEAT_OUT) + "))"),
                ("kept", "SELECT feature FROM u GROUP BY feature HAVING count(value) >= 0.6 * count(*)"),
                ("whole", "SELECT SK_ID_CURR FROM u JOIN kept USING (feature) GROUP BY SK_ID_CURR HAVING count(value) = count(*)")]))
def q_cleanup(spark, d):
    """I3 on the feature row, in long form: columns filled below 60% dropped, then incomplete rows dropped."""
    return report(P.transpose_client(I.cleanup(features(spark, d), 0.6, impute=False), "SK_ID_CURR"))


# ---- 2.11 evaluation ---------------------------------------------------------------------------------------

HIST_SQL = "SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY p"


@register("auc_roc", sql([], rep(
    "SELECT sum(pos * (coalesce(nb, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, "
    "CAST(sum(neg) AS BIGINT) AS n_neg FROM (SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb "
    "FROM h)", ["auc"], ["n_pos", "n_neg"]), SCORES_CTE + [("h", HIST_SQL)]))
def q_auc_roc(spark, d):
    return report(M.auc_roc(scores(spark, d), "y", "p"))


@register("roc_points", sql([], rep(
    "SELECT p AS threshold, CAST(sum(pos) OVER (ORDER BY p DESC) AS DOUBLE) / CAST(sum(pos) OVER () AS DOUBLE) AS tpr, "
    "CAST(sum(neg) OVER (ORDER BY p DESC) AS DOUBLE) / CAST(sum(neg) OVER () AS DOUBLE) AS fpr FROM h",
    ["threshold", "tpr", "fpr"]), SCORES_CTE + [("h", HIST_SQL)]))
def q_roc_points(spark, d):
    return report(M.roc_points(scores(spark, d), "y", "p"))


@register("confusion_matrix", sql([], "SELECT count(CASE WHEN y = 1 AND p >= 0.5 THEN 1 END) AS tp, "
                                      "count(CASE WHEN y = 0 AND p >= 0.5 THEN 1 END) AS fp, count(CASE WHEN y = 0 AND p < 0.5 THEN 1 END) AS tn, "
                                      "count(CASE WHEN y = 1 AND p < 0.5 THEN 1 END) AS fn FROM scores", SCORES_CTE))
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(scores(spark, d), "y", "p", 0.5)


REPORT_SQL = """
WITH t AS (SELECT coalesce(a.cls, b.cls) AS cls, coalesce(a.support, 0) AS support, coalesce(a.tp, 0) AS tp,
                  coalesce(b.predicted, 0) AS predicted
           FROM (SELECT CAST(y AS VARCHAR) AS cls, count(*) AS support, count(CASE WHEN y = pred THEN 1 END) AS tp FROM scores GROUP BY 1) a
           FULL JOIN (SELECT CAST(pred AS VARCHAR) AS cls, count(*) AS predicted FROM scores GROUP BY 1) b ON a.cls = b.cls),
r AS (SELECT cls, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall, support FROM t),
f AS (SELECT cls, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
             support FROM r)
SELECT * FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM f"""


@register("classification_report", sql([], rep(f"SELECT cls, precision, recall, f1, CAST(support AS BIGINT) AS support FROM ({REPORT_SQL})",
                                                ["precision", "recall", "f1"], ["cls", "support"]), SCORES_CTE))
def q_classification_report(spark, d):
    return report(M.classification_report(scores(spark, d), "y", "pred"))


@register("accuracy", sql([], rep("SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM scores",
                                  ["accuracy"]), SCORES_CTE))
def q_accuracy(spark, d):
    return report(M.accuracy(scores(spark, d), "y", "pred"))


SWEEP_SQL = ("SELECT CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) AS threshold, "
             "count(CASE WHEN y = 1 AND p >= CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) THEN 1 END) AS tp, "
             "count(CASE WHEN y = 0 AND p >= CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) THEN 1 END) AS fp, "
             "count(CASE WHEN y = 0 AND p < CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) THEN 1 END) AS tn, "
             "count(CASE WHEN y = 1 AND p < CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) THEN 1 END) AS fn "
             "FROM range(0, 101) AS g(k), scores GROUP BY k")
GAIN = ("(CAST(5 AS DOUBLE) * tn - CAST(100 AS DOUBLE) * fn - CAST(5 AS DOUBLE) * fp) / CAST(tp + fp + tn + fn AS DOUBLE) "
        "* CAST(100 AS DOUBLE)")


@register("threshold_gain_sweep", sql([], rep(f"SELECT threshold, tp, fp, tn, fn, {GAIN} AS gain FROM sw", ["threshold", "gain"],
                                              ["tp", "fp", "tn", "fn"]), SCORES_CTE + [("sw", SWEEP_SQL)]))
def q_threshold_gain_sweep(spark, d):
    return report(M.threshold_gain_sweep(scores(spark, d), "y", "p"))


@register("best_thresholds", sql([], rep(
    f"SELECT threshold AS best_threshold, gain AS best_gain, (SELECT max(threshold) FROM g WHERE gain >= 0) AS break_even_threshold "
    "FROM g ORDER BY gain DESC, threshold ASC LIMIT 1", ["best_threshold", "best_gain", "break_even_threshold"]),
    SCORES_CTE + [("sw", SWEEP_SQL), ("g", f"SELECT threshold, {GAIN} AS gain FROM sw")]))
def q_best_thresholds(spark, d):
    return report(M.best_thresholds(M.threshold_gain_sweep(scores(spark, d), "y", "p")))


# ---- 2.12 explanation ------------------------------------------------------------------------------------


@register("attribution_base_value", sql([], rep(
    f"SELECT avg(p) AS base_value, count(*) AS n_background FROM (SELECT p FROM scores ORDER BY {parity_hash_sql('SK_ID_CURR', 0)}, "
    "SK_ID_CURR LIMIT 100)", ["base_value"], ["n_background"]), SCORES_CTE))
def q_attribution_base_value(spark, d):
    return report(X.attribution_base_value(scores(spark, d), "p", 100))


@register("global_attribution", sql(["fx_application"], rep(
    "SELECT feature, avg(abs(phi)) AS mean_abs_phi, count(phi) AS n FROM zl GROUP BY feature", ["mean_abs_phi"], ["feature", "n"]),
    ZL_CTE))
def q_global_attribution(spark, d):
    return report(X.global_attribution(z_long(spark, d)))


# ---- 2.13 client profile and distributions ----------------------------------------------------------------


@register("client_history", sql(["fx_application", "fx_installments"], rep(
    "SELECT SK_ID_CURR AS client, NUM_INSTALMENT_VERSION, AMT_INSTALMENT, AMT_PAYMENT, DAYS_INSTALMENT, DAYS_ENTRY_PAYMENT "
    f"FROM fx_installments WHERE SK_ID_CURR IN ({ids_sample_sql(0.05, 3)})",
    ["AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"], ["client", "NUM_INSTALMENT_VERSION"])))
def q_client_history(spark, d):
    return report(V.client_history(fx(spark, d, "fx_installments"), ids_sample(spark, d, 0.05, 3)))


@register("client_balance_history", sql(["fx_application", "fx_bureau", "fx_bureau_balance"],
          "SELECT b.SK_ID_CURR AS client, bb.MONTHS_BALANCE, bb.STATUS FROM fx_bureau_balance bb JOIN fx_bureau b USING (SK_ID_BUREAU) "
          f"WHERE b.SK_ID_CURR IN ({ids_sample_sql(0.05, 3)})"))
def q_client_balance_history(spark, d):
    return V.client_balance_history(fx(spark, d, "fx_bureau_balance"), fx(spark, d, "fx_bureau"), ids_sample(spark, d, 0.05, 3))


@register("grouped_histogram", sql(["fx_bureau"], rep(
    "SELECT bin, hue, n, CAST(-2600 AS DOUBLE) + bin * CAST(100 AS DOUBLE) AS bin_lo FROM ("
    "SELECT CAST(floor((DAYS_CREDIT - CAST(-2600 AS DOUBLE)) / CAST(100 AS DOUBLE)) AS BIGINT) AS bin, CREDIT_ACTIVE AS hue, count(*) AS n "
    "FROM fx_bureau WHERE DAYS_CREDIT IS NOT NULL GROUP BY 1, 2)", ["bin_lo"], ["bin", "hue", "n"])))
def q_grouped_histogram(spark, d):
    return report(V.grouped_histogram(fx(spark, d, "fx_bureau"), "DAYS_CREDIT", 100.0, -2600.0, "CREDIT_ACTIVE"))


@register("box_stats", sql(["fx_bureau"], rep(
    "SELECT CREDIT_ACTIVE, count(*) AS n, min(AMT_CREDIT_SUM) AS \"min\", quantile_cont(AMT_CREDIT_SUM, 0.25) AS q1, "
    "quantile_cont(AMT_CREDIT_SUM, 0.5) AS median, quantile_cont(AMT_CREDIT_SUM, 0.75) AS q3, max(AMT_CREDIT_SUM) AS \"max\" "
    "FROM fx_bureau WHERE AMT_CREDIT_SUM IS NOT NULL GROUP BY CREDIT_ACTIVE", ["min", "q1", "median", "q3", "max"],
    ["CREDIT_ACTIVE", "n"])))
def q_box_stats(spark, d):
    return report(V.box_stats(fx(spark, d, "fx_bureau"), "AMT_CREDIT_SUM", ["CREDIT_ACTIVE"]))


@register("box_stats_null_group", sql(["fx_bureau"], rep(
    "SELECT CREDIT_TYPE, count(*) AS n, min(AMT_CREDIT_SUM) AS \"min\", quantile_cont(AMT_CREDIT_SUM, 0.25) AS q1, "
    "quantile_cont(AMT_CREDIT_SUM, 0.5) AS median, quantile_cont(AMT_CREDIT_SUM, 0.75) AS q3, max(AMT_CREDIT_SUM) AS \"max\" "
    "FROM nb WHERE AMT_CREDIT_SUM IS NOT NULL GROUP BY CREDIT_TYPE", ["min", "q1", "median", "q3", "max"], ["CREDIT_TYPE", "n"]), NAN_CTE))
def q_box_stats_null_group(spark, d):
    """V3: the NULL group is a group; NaN values are missing."""
    return report(V.box_stats(nan_bureau(spark, d), "AMT_CREDIT_SUM", ["CREDIT_TYPE"]))


SCATTER = ["AMT_CREDIT", "AMT_ANNUITY", "CODE_GENDER"]


@register("scatter_sample", sql(["fx_application"], rep(
    f"SELECT SK_ID_CURR, {', '.join(SCATTER)} FROM app ORDER BY {parity_hash_sql('SK_ID_CURR', 0)}, SK_ID_CURR LIMIT 200",
    ["AMT_CREDIT", "AMT_ANNUITY"], ["SK_ID_CURR", "CODE_GENDER"]), APP_CTE))
def q_scatter_sample(spark, d):
    return report(V.scatter_sample(app(spark, d), 200, SCATTER))


@register("client_vs_population", sql(["fx_application"], rep(f"""
SELECT c.SK_ID_CURR, c.CODE_GENDER, c.AMT_CREDIT,
  CAST((SELECT count(*) FROM app p WHERE p.CODE_GENDER = c.CODE_GENDER AND p.AMT_CREDIT < c.AMT_CREDIT) AS DOUBLE) / s.n AS share_below,
  s.q1, s.median, s.q3
FROM app c JOIN (SELECT CODE_GENDER, count(AMT_CREDIT) AS n, quantile_cont(AMT_CREDIT, 0.25) AS q1, quantile_cont(AMT_CREDIT, 0.5) AS median,
                 quantile_cont(AMT_CREDIT, 0.75) AS q3 FROM app WHERE AMT_CREDIT IS NOT NULL GROUP BY CODE_GENDER) s USING (CODE_GENDER)
WHERE c.AMT_CREDIT IS NOT NULL AND c.SK_ID_CURR IN ({ids_sample_sql(0.05, 3)})""",
    ["AMT_CREDIT", "share_below", "q1", "median", "q3"], ["SK_ID_CURR", "CODE_GENDER"]), APP_CTE))
def q_client_vs_population(spark, d):
    return report(V.client_vs_population(app(spark, d), ids_sample(spark, d, 0.05, 3), "AMT_CREDIT", ["CODE_GENDER"]))


@register("allowed_pairings", sql(["fx_application"], """
SELECT x."column", x.kind, string_agg(y."column", ',' ORDER BY y."column") AS y_options, count(y."column") AS n_options
FROM k x LEFT JOIN k y ON y."column" <> x."column" AND (x.kind <> 'categorical' OR y.kind = 'numeric') GROUP BY x."column", x.kind""",
    APP_CTE + [("k", _distinct_sql("app", APP_OUT))]))
def q_allowed_pairings(spark, d):
    return V.allowed_pairings(P.split_columns_by_cardinality(app(spark, d), APP_OUT))


@register("client_top_values", sql(["fx_application"], rep(
    f"SELECT r.SK_ID_CURR, r.rank, r.feature, r.phi, v.value FROM ({RANK_SQL}) r LEFT JOIN vl v USING (SK_ID_CURR, feature) "
    f"WHERE r.rank <= {TOPK}", ["phi", "value"], ["SK_ID_CURR", "rank", "feature"]), ZL_CTE))
def q_client_top_values(spark, d):
    return report(V.client_top_values(z_long(spark, d), values_long(spark, d), TOPK))
