"""Per-table feature blocks (A2-A10) and the application block, each one row per client.

The specifications below are fixed values: they decide which aggregates exist in the wide row.
Columns a table does not have are skipped, so the same specs run on any table of the same shape.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.naming import agg_name, dummy_name
from riskloom.functions.scalar import clip_at_zero, nonfinite_to_null, safe_ratio, sentinel_to_null
from riskloom.operators.aggregate import (
    Feature,
    Parts,
    Subset,
    aggregate_block,
    aggregate_parts,
    by_key,
    category_features,
    discover_vocabulary,
    spec_features,
    sql_ref,
    sql_str,
    string_columns,
    value_sql,
)

CLIENT = "SK_ID_CURR"
BUREAU_ID = "SK_ID_BUREAU"
PREV_ID = "SK_ID_PREV"

# ---- Fixed values: aggregation specifications -------------------------------------------------

BUREAU_BALANCE_SPEC = {"MONTHS_BALANCE": ["min", "max", "size"]}

BUREAU_NUM_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}

PREVIOUS_NUM_SPEC = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}

PREVIOUS_SENTINEL_COLUMNS = (
    "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION",
)

POS_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}

INSTALMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}

CREDIT_CARD_FUNCS = ["min", "max", "mean", "sum", "var"]

APPLICATION_BINARY = ("CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY")
APPLICATION_DROP_VALUE = ("CODE_GENDER", "XNA")

BLOCK_PREFIX = {
    "bureau": "BURO_", "active": "ACTIVE_", "closed": "CLOSED_", "previous": "PREV_", "approved": "APPROVED_",
    "refused": "REFUSED_", "pos": "POS_", "installments": "INSTAL_", "credit_card": "CC_",
}
SUBSET_VALUES = {
    "active": ("CREDIT_ACTIVE", "Active"), "closed": ("CREDIT_ACTIVE", "Closed"),
    "approved": ("NAME_CONTRACT_STATUS", "Approved"), "refused": ("NAME_CONTRACT_STATUS", "Refused"),
}

APPLICATION_RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}

Vocab = Mapping[str, Sequence[str]]

# -----------------------------------------------------------------------------------------------


def vocabulary_of(df: DataFrame, columns: Sequence[str], vocab: Vocab | None) -> dict[str, list[str]]:
    """Given vocabularies win; missing ones are discovered in one job."""
    given = dict(vocab or {})
    missing = [c for c in columns if c not in given]
    if missing:
        given.update(discover_vocabulary(df, missing))
    return {c: list(given[c]) for c in columns}


def _shares(df: DataFrame, exclude: Sequence[str], vocab: Vocab | None, null_category: bool,
            funcs: Sequence[str] = ("mean",)) -> list[Feature]:
    cats = string_columns(df, exclude)
    voc = vocabulary_of(df, cats, vocab)
    feats: list[Feature] = []
    for c in cats:
        feats += category_features(c, voc[c], null_category, funcs)
    return feats


def _cond(column: str, value: str) -> str:
    return f"{sql_ref(column)} <=> {sql_str(value)}"


# ---- application -------------------------------------------------------------------------------


def application_features(app: DataFrame, vocab: Vocab | None = None, null_category: bool = False) -> DataFrame:
    """Application row per client: XNA rows out (NULL kept), binary codes, one-hot, sentinel, ratios."""
    col, bad = APPLICATION_DROP_VALUE
    df = app.where(~F.col(col).eqNullSafe(F.lit(bad))) if col in app.columns else app
    binaries = [c for c in APPLICATION_BINARY if c in df.columns]
    others = [c for c in string_columns(df) if c not in binaries]
    voc = vocabulary_of(df, binaries + others, vocab)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in binaries:
            out.append(factorize_expr(f.name, voc[f.name]).alias(f.name))
        elif f.name in others:
            continue
        elif f.name == "DAYS_EMPLOYED":
            out.append(sentinel_to_null(c).alias(f.name))
        else:
            out.append(c)
    for c in others:
        for feat in category_features(c, voc[c], null_category):
            out.append(F.expr(feat.expr).alias(feat.name))
    df = df.select(*out)
    ratios = APPLICATION_RATIOS
    extra = [nonfinite_to_null(safe_ratio(n, d)).alias(name) for name, (n, d) in ratios.items()
             if n in df.columns and d in df.columns]
    return df.select("*", *extra)


def factorize_expr(column: str, values: Sequence[str]):
    """code = position in the sorted vocabulary, NULL (or unseen) = -1."""
    if not values:
        return F.lit(-1)
    m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
    c = F.col(f"`{column}`")
    return F.when(c.isNull(), F.lit(-1)).otherwise(F.coalesce(m[c], F.lit(-1))).cast("int")


# ---- bureau and balance ---------------------------------------------------------------------------


def bureau_balance_block(bb: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> DataFrame:
    """A2: per bureau credit, months min/max/size and status shares (names without prefix)."""
    feats = spec_features(bb, BUREAU_BALANCE_SPEC) + _shares(bb, [BUREAU_ID], vocab, null_category)
    return aggregate_block(by_key(bb, BUREAU_ID), BUREAU_ID, feats, "")


def bureau_with_balance(bureau: DataFrame, bb: DataFrame, vocab: Vocab | None = None,
                        null_category: bool = True) -> tuple[DataFrame, list[str]]:
    """Bureau rows with their balance aggregate (left join on the credit id), credit id dropped.
    ``vocab`` is the balance table's vocabulary."""
    bb_agg = bureau_balance_block(bb, vocab, null_category)
    bb_share_cols = [c for c in bb_agg.columns if c.endswith("_MEAN")]
    joined = bureau.join(bb_agg, BUREAU_ID, "left").drop(BUREAU_ID)
    return joined, bb_share_cols


def bureau_parts(bureau: DataFrame, bb: DataFrame, vocab: Vocab | None = None, null_category: bool = True,
                 subsets: bool = True, balance_vocab: Vocab | None = None) -> Parts:
    """A3 + A4 + A5: client aggregates of bureau credits and of their monthly balances.
    ``vocab`` is the bureau table's vocabulary, ``balance_vocab`` the balance table's."""
    joined, bb_share_cols = bureau_with_balance(bureau, bb, balance_vocab, null_category)
    num = spec_features(joined, BUREAU_NUM_SPEC)
    shares = _shares(bureau, [CLIENT, BUREAU_ID], vocab, null_category)
    feats = num + shares + [Feature(c, value_sql(joined, c), ("mean",)) for c in bb_share_cols]
    subs = []
    if subsets:
        for name in ("active", "closed"):
            col, val = SUBSET_VALUES[name]
            subs.append(Subset(BLOCK_PREFIX[name], _cond(col, val), tuple(num)))
    return aggregate_parts(by_key(joined, CLIENT), CLIENT, feats, BLOCK_PREFIX["bureau"], subs)


def bureau_block(bureau: DataFrame, bb: DataFrame, vocab: Vocab | None = None, null_category: bool = True,
                 subsets: bool = True, balance_vocab: Vocab | None = None) -> DataFrame:
    """A3 + A4 + A5: client aggregates of bureau credits and of their monthly balances."""
    return bureau_parts(bureau, bb, vocab, null_category, subsets, balance_vocab).finished()


# ---- previous applications ---------------------------------------------------------------------


def previous_prepared(prev: DataFrame) -> DataFrame:
    """P3 + P5: sentinel days to NULL and the asked / granted ratio."""
    cols = []
    for f in prev.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(sentinel_to_null(c).alias(f.name) if f.name in PREVIOUS_SENTINEL_COLUMNS else c)
    out = prev.select(*cols)
    if "AMT_APPLICATION" in prev.columns and "AMT_CREDIT" in prev.columns:
        out = out.withColumn("APP_CREDIT_PERC", safe_ratio("AMT_APPLICATION", "AMT_CREDIT"))
    return out


def previous_parts(prev: DataFrame, vocab: Vocab | None = None, null_category: bool = True,
                   subsets: bool = True) -> Parts:
    """A6 + A7."""
    df = previous_prepared(by_key(prev, CLIENT))
    num = spec_features(df, PREVIOUS_NUM_SPEC)
    feats = num + _shares(df, [CLIENT, PREV_ID], vocab, null_category)
    subs = []
    if subsets:
        for name in ("approved", "refused"):
            col, val = SUBSET_VALUES[name]
            subs.append(Subset(BLOCK_PREFIX[name], _cond(col, val), tuple(num)))
    return aggregate_parts(df, CLIENT, feats, BLOCK_PREFIX["previous"], subs)


def previous_block(prev: DataFrame, vocab: Vocab | None = None, null_category: bool = True,
                   subsets: bool = True) -> DataFrame:
    """A6 + A7."""
    return previous_parts(prev, vocab, null_category, subsets).finished()


# ---- POS cash, installments, credit card -------------------------------------------------------


def pos_parts(pos: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> Parts:
    """A8 (+ A11 POS_COUNT)."""
    feats = spec_features(pos, POS_SPEC) + _shares(pos, [CLIENT, PREV_ID], vocab, null_category)
    return aggregate_parts(by_key(pos, CLIENT), CLIENT, feats, BLOCK_PREFIX["pos"], count_name="POS_COUNT")


def pos_block(pos: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> DataFrame:
    """A8 (+ A11 POS_COUNT)."""
    return pos_parts(pos, vocab, null_category).finished()


def installments_prepared(ins: DataFrame) -> DataFrame:
    """P5 + P6 + P7c: payment ratio and difference, days past / before due clipped at zero."""
    return ins.select(
        "*",
        safe_ratio("AMT_PAYMENT", "AMT_INSTALMENT").alias("PAYMENT_PERC"),
        (F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")).alias("PAYMENT_DIFF"),
        clip_at_zero(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("DPD"),
        clip_at_zero(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("DBD"),
    )


def installments_parts(ins: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> Parts:
    """A9 (+ A11 INSTAL_COUNT)."""
    df = installments_prepared(by_key(ins, CLIENT))
    feats = spec_features(df, INSTALMENT_SPEC) + _shares(df, [CLIENT, PREV_ID], vocab, null_category)
    return aggregate_parts(df, CLIENT, feats, BLOCK_PREFIX["installments"], count_name="INSTAL_COUNT")


def installments_block(ins: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> DataFrame:
    """A9 (+ A11 INSTAL_COUNT)."""
    return installments_parts(ins, vocab, null_category).finished()


def credit_card_parts(cc: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> Parts:
    """A10: min max mean sum var of every column, category indicators included (+ CC_COUNT)."""
    df = cc.drop(PREV_ID)
    cats = string_columns(df, [CLIENT])
    num = [Feature(c, value_sql(df, c), tuple(CREDIT_CARD_FUNCS)) for c in df.columns if c != CLIENT and c not in cats]
    feats = num + _shares(df, [CLIENT], vocab, null_category, CREDIT_CARD_FUNCS)
    return aggregate_parts(by_key(df, CLIENT), CLIENT, feats, BLOCK_PREFIX["credit_card"], count_name="CC_COUNT")


def credit_card_block(cc: DataFrame, vocab: Vocab | None = None, null_category: bool = True) -> DataFrame:
    """A10: min max mean sum var of every column, category indicators included (+ CC_COUNT)."""
    return credit_card_parts(cc, vocab, null_category).finished()
