"""DuckDB SQL text for the oracle check of the feature blocks.

The SQL is written the plain way: every conditional subset is a filtered ``GROUP BY`` left-joined back,
ratios use the SQL engine's own IEEE division (x/0 = inf, 0/0 = NaN, NaN then dropped before aggregating),
so it checks the Spark plan (one-pass conditional aggregates, guarded division) rather than restating it.
Category vocabularies are fixed here; the Spark side discovers them from the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from riskloom.functions.report import round_sig_sql
from riskloom.operators import blocks as B

# Category vocabularies of the fixture tables.
VOCAB = {
    "CREDIT_ACTIVE": ["Active", "Closed", "Sold"],
    "CREDIT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "STATUS": ["0", "C", "X"],
    "PREV_NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused"],
    "POS_NAME_CONTRACT_STATUS": ["click", "error", "purchase", "signup", "view"],
    "CC_NAME_CONTRACT_STATUS": ["error", "purchase"],
    "NAME_INCOME_TYPE": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "CODE_GENDER": ["F", "M"],
}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


@dataclass(frozen=True)
class SqlFeature:
    name: str
    expr: str
    funcs: tuple[str, ...]
    integer: bool = False


def finite(expr: str) -> str:
    return f"CASE WHEN isfinite({expr}) THEN {expr} END"


def nan_to_null(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"


def dummies(column: str, values: Sequence[str], null_category: bool = True,
            funcs: tuple[str, ...] = ("mean",)) -> list[SqlFeature]:
    out = [SqlFeature(f"{column}_{v}", f"CASE WHEN {q(column)} = {lit(v)} THEN 1 ELSE 0 END", funcs, True) for v in values]
    if null_category:
        out.append(SqlFeature(f"{column}_nan", f"CASE WHEN {q(column)} IS NULL THEN 1 ELSE 0 END", funcs, True))
    return out


def _agg_sql(func: str, x: str, integer: bool) -> tuple[str, str]:
    """(sql, kind) with kind 'd' double or 'i' bigint/int."""
    if func == "min":
        return f"min({x})", "i" if integer else "d"
    if func == "max":
        return f"max({x})", "i" if integer else "d"
    if func == "mean":
        return f"avg({x})", "d"
    if func == "var":
        return f"var_samp({x})", "d"
    if func == "sum":
        return (f"CAST(coalesce(sum({x}), 0) AS BIGINT)", "i") if integer else (f"coalesce(sum({x}), 0)", "d")
    if func == "size":
        return "count(*)", "i"
    if func == "nunique":
        return f"count(DISTINCT {x})", "i"
    raise ValueError(func)


def spec(columns: dict[str, tuple[str, bool]], spec_map: dict) -> list[SqlFeature]:
    """SqlFeatures for the spec entries whose column exists; ``columns`` maps name -> (expr, integer)."""
    return [SqlFeature(c, columns[c][0], tuple(f), columns[c][1]) for c, f in spec_map.items() if c in columns]


def group_sql(source: str, key: str, feats: Sequence[SqlFeature], prefix: str, where: str | None = None,
              count_name: str | None = None) -> tuple[str, list[tuple[str, str]]]:
    items, cols = [], []
    for f in feats:
        for fn in f.funcs:
            s, kind = _agg_sql(fn, f.expr, f.integer)
            name = f"{prefix}{f.name}_{fn.upper()}"
            items.append(f"{s} AS {q(name)}")
            cols.append((name, kind))
    if count_name:
        items.append(f"count(*) AS {q(count_name)}")
        cols.append((count_name, "i"))
    w = f" WHERE {where}" if where else ""
    return f"SELECT {key}, {', '.join(items)} FROM {source}{w} GROUP BY {key}", cols


def block_sql(source: str, key: str, feats: Sequence[SqlFeature], prefix: str,
              subsets: Sequence[tuple[str, str, Sequence[SqlFeature]]] = (), count_name: str | None = None,
              ) -> tuple[str, list[tuple[str, str]]]:
    """Main aggregate left-joined with each filtered subset aggregate; doubles made finite-or-NULL."""
    main, cols = group_sql(source, key, feats, prefix, count_name=count_name)
    parts = [f"({main}) AS m"]
    all_cols = list(cols)
    for i, (pfx, where, sfeats) in enumerate(subsets):
        s, scols = group_sql(source, key, sfeats, pfx, where=where)
        parts.append(f"LEFT JOIN ({s}) AS s{i} USING ({key})")
        all_cols += scols
    sel = [key] + [finite(q(n)) + f" AS {q(n)}" if k == "d" else q(n) for n, k in all_cols]
    return f"SELECT {', '.join(sel)} FROM {' '.join(parts)}", all_cols


def report_wrap(body: str, cols: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> str:
    """Apply the report rounding to the double columns of ``body``."""
    items = [q(k) for k in keys] + [(round_sig_sql(q(n)) + f" AS {q(n)}") if kind == "d" else q(n) for n, kind in cols]
    return f"SELECT {', '.join(items)} FROM ({body}) AS r"


# ---- block SQL -----------------------------------------------------------------------------------


def bureau_balance_sql() -> tuple[str, list[tuple[str, str]]]:
    cols = {"MONTHS_BALANCE": ("MONTHS_BALANCE", True)}
    feats = spec(cols, B.BUREAU_BALANCE_SPEC) + dummies("STATUS", VOCAB["STATUS"])
    return block_sql("fx_bureau_balance", "SK_ID_BUREAU", feats, "")


def bureau_sql(subsets: bool = True) -> tuple[str, list[tuple[str, str]]]:
    bb, bb_cols = bureau_balance_sql()
    share_cols = [n for n, _ in bb_cols if n.endswith("_MEAN")]
    joined = (f"(SELECT b.*, a.* EXCLUDE (SK_ID_BUREAU) FROM fx_bureau b "
              f"LEFT JOIN ({bb}) AS a USING (SK_ID_BUREAU))")
    numeric = {
        "DAYS_CREDIT": ("DAYS_CREDIT", False), "AMT_CREDIT_SUM": ("AMT_CREDIT_SUM", False),
        "AMT_CREDIT_SUM_DEBT": ("AMT_CREDIT_SUM_DEBT", False), "MONTHS_BALANCE_MIN": (q("MONTHS_BALANCE_MIN"), True),
        "MONTHS_BALANCE_MAX": (q("MONTHS_BALANCE_MAX"), True), "MONTHS_BALANCE_SIZE": (q("MONTHS_BALANCE_SIZE"), True),
    }
    num = spec(numeric, B.BUREAU_NUM_SPEC)
    feats = (num + dummies("CREDIT_ACTIVE", VOCAB["CREDIT_ACTIVE"]) + dummies("CREDIT_TYPE", VOCAB["CREDIT_TYPE"])
             + [SqlFeature(c, q(c), ("mean",)) for c in share_cols])
    subs = []
    if subsets:
        subs = [("ACTIVE_", "CREDIT_ACTIVE = 'Active'", num), ("CLOSED_", "CREDIT_ACTIVE = 'Closed'", num)]
    return block_sql(joined, "SK_ID_CURR", feats, "BURO_", subs)


def previous_sql(subsets: bool = True) -> tuple[str, list[tuple[str, str]]]:
    src = (f"(SELECT *, {nan_to_null('AMT_APPLICATION / AMT_CREDIT')} AS APP_CREDIT_PERC "
           f"FROM fx_previous_application)")
    numeric = {c: (c, False) for c in ("AMT_APPLICATION", "AMT_CREDIT", "APP_CREDIT_PERC", "RATE_DOWN_PAYMENT",
                                        "DAYS_DECISION", "CNT_PAYMENT")}
    num = spec(numeric, B.PREVIOUS_NUM_SPEC)
    feats = num + dummies("NAME_CONTRACT_STATUS", VOCAB["PREV_NAME_CONTRACT_STATUS"])
    subs = []
    if subsets:
        subs = [("APPROVED_", "NAME_CONTRACT_STATUS = 'Approved'", num),
                ("REFUSED_", "NAME_CONTRACT_STATUS = 'Refused'", num)]
    return block_sql(src, "SK_ID_CURR", feats, "PREV_", subs)


def pos_sql() -> tuple[str, list[tuple[str, str]]]:
    numeric = {"MONTHS_BALANCE": ("MONTHS_BALANCE", True), "SK_DPD": ("SK_DPD", True), "SK_DPD_DEF": ("SK_DPD_DEF", True)}
    feats = spec(numeric, B.POS_SPEC) + dummies("NAME_CONTRACT_STATUS", VOCAB["POS_NAME_CONTRACT_STATUS"])
    return block_sql("fx_pos_cash", "SK_ID_CURR", feats, "POS_", count_name="POS_COUNT")


def installments_source() -> str:
    return ("(SELECT *, " + nan_to_null("AMT_PAYMENT / AMT_INSTALMENT") + " AS PAYMENT_PERC, "
            "AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF, "
            "CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0 END AS DPD, "
            "CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT > 0 THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0 END AS DBD "
            "FROM fx_installments)")


def installments_sql() -> tuple[str, list[tuple[str, str]]]:
    numeric = {c: (c, False) for c in ("DPD", "DBD", "PAYMENT_PERC", "PAYMENT_DIFF", "AMT_INSTALMENT", "AMT_PAYMENT",
                                        "DAYS_ENTRY_PAYMENT")}
    numeric["NUM_INSTALMENT_VERSION"] = ("NUM_INSTALMENT_VERSION", True)
    feats = spec(numeric, B.INSTALMENT_SPEC)
    return block_sql(installments_source(), "SK_ID_CURR", feats, "INSTAL_", count_name="INSTAL_COUNT")


def credit_card_sql() -> tuple[str, list[tuple[str, str]]]:
    funcs = tuple(B.CREDIT_CARD_FUNCS)
    feats = [SqlFeature("MONTHS_BALANCE", "MONTHS_BALANCE", funcs, True), SqlFeature("AMT_BALANCE", "AMT_BALANCE", funcs),
             SqlFeature("CNT_DRAWINGS_CURRENT", "CNT_DRAWINGS_CURRENT", funcs, True)]
    feats += dummies("NAME_CONTRACT_STATUS", VOCAB["CC_NAME_CONTRACT_STATUS"], funcs=funcs)
    return block_sql("fx_credit_card", "SK_ID_CURR", feats, "CC_", count_name="CC_COUNT")


def application_sql() -> tuple[str, list[tuple[str, str]]]:
    gender = "CASE CODE_GENDER " + " ".join(f"WHEN {lit(v)} THEN {i}" for i, v in enumerate(VOCAB["CODE_GENDER"])) + " ELSE -1 END"
    income = ", ".join(f"CASE WHEN NAME_INCOME_TYPE = {lit(v)} THEN 1 ELSE 0 END AS {q('NAME_INCOME_TYPE_' + v)}"
                       for v in VOCAB["NAME_INCOME_TYPE"])
    inner = (f"SELECT SK_ID_CURR, TARGET, {gender} AS CODE_GENDER, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, DAYS_BIRTH, "
             f"CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED END AS DAYS_EMPLOYED, CNT_FAM_MEMBERS, {income} "
             f"FROM fx_application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'")
    ratios = {
        "DAYS_EMPLOYED_PERC": "DAYS_EMPLOYED / DAYS_BIRTH", "INCOME_CREDIT_PERC": "AMT_INCOME_TOTAL / AMT_CREDIT",
        "INCOME_PER_PERSON": "AMT_INCOME_TOTAL / CNT_FAM_MEMBERS", "ANNUITY_INCOME_PERC": "AMT_ANNUITY / AMT_INCOME_TOTAL",
        "PAYMENT_RATE": "AMT_ANNUITY / AMT_CREDIT",
    }
    sql = f"SELECT *, {', '.join(finite(e) + ' AS ' + q(n) for n, e in ratios.items())} FROM ({inner}) AS a"
    cols = [("TARGET", "i"), ("CODE_GENDER", "i")] + [(c, "d") for c in (
        "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS")]
    cols += [("NAME_INCOME_TYPE_" + v, "i") for v in VOCAB["NAME_INCOME_TYPE"]] + [(n, "d") for n in ratios]
    return sql, cols


def features_sql() -> tuple[str, list[tuple[str, str]]]:
    app, cols = application_sql()
    parts = [f"({app}) AS app"]
    for i, (s, c) in enumerate([bureau_sql(), previous_sql(), pos_sql(), installments_sql(), credit_card_sql()]):
        parts.append(f"LEFT JOIN ({s}) AS b{i} USING (SK_ID_CURR)")
        cols = cols + c
    return f"SELECT * FROM {' '.join(parts)}", cols
