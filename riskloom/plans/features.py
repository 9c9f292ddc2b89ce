"""The feature plan: application row plus five history blocks, one wide row per client (3.1)."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import nonfinite_to_null_all
from riskloom.operators import blocks as B
from riskloom.operators.aggregate import Parts, discover_vocabulary, sql_ref, string_columns
from riskloom.operators.joins import join_feature_blocks
from riskloom.sources.fixtures import load_fixtures

CLIENT = "SK_ID_CURR"
KEYS = ("SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV")

# vocabularies per table: {table name: {column: [values]}}
TableVocab = Mapping[str, Mapping[str, list[str]]]


def discover_vocabularies(tables: Mapping[str, DataFrame], given: TableVocab | None = None) -> dict:
    """Vocabulary of every string column of every table (given ones kept). One bounded job per table,
    submitted concurrently from driver threads so the small jobs share the cluster."""
    given = dict(given or {})
    todo = {n: t for n, t in tables.items() if n not in given and string_columns(t, KEYS)}
    out = {n: dict(v) for n, v in given.items()}
    if todo:
        with ThreadPoolExecutor(max_workers=len(todo)) as ex:
            futs = {n: ex.submit(discover_vocabulary, t, string_columns(t, KEYS)) for n, t in todo.items()}
        out.update({n: f.result() for n, f in futs.items()})
    return out


def build_parts(tables: Mapping[str, DataFrame], vocab: TableVocab | None = None) -> list[Parts]:
    """The five per-client history blocks before their last projection; a missing table is simply left out."""
    v = discover_vocabularies(tables, vocab)
    out = []
    if "bureau" in tables and "bureau_balance" in tables:
        out.append(B.bureau_parts(tables["bureau"], tables["bureau_balance"], v.get("bureau", {}),
                                  balance_vocab=v.get("bureau_balance", {})))
    if "previous_application" in tables:
        out.append(B.previous_parts(tables["previous_application"], v.get("previous_application", {})))
    if "pos_cash" in tables:
        out.append(B.pos_parts(tables["pos_cash"], v.get("pos_cash", {})))
    if "installments" in tables:
        out.append(B.installments_parts(tables["installments"], v.get("installments", {})))
    if "credit_card" in tables:
        out.append(B.credit_card_parts(tables["credit_card"], v.get("credit_card", {})))
    return out


def build_blocks(tables: Mapping[str, DataFrame], vocab: TableVocab | None = None) -> list[DataFrame]:
    """The five per-client history blocks; a missing table is simply left out."""
    return [p.finished() for p in build_parts(tables, vocab)]


def build_features(tables: Mapping[str, DataFrame], vocab: TableVocab | None = None) -> DataFrame:
    """Application features left-joined with every block; non-finite values to NULL.

    ``vocab`` maps table name to {column: values}; missing vocabularies are discovered (concurrently). The blocks are joined as plain aggregates; one
    projection above the joins makes their columns.
    """
    # the application's categories are those left after its row filter (XNA rows out), as in its encoding
    col, bad = B.APPLICATION_DROP_VALUE
    app_src = tables["application"]
    filtered = app_src.where(~F.col(col).eqNullSafe(F.lit(bad))) if col in app_src.columns else app_src
    v = discover_vocabularies({**tables, "application": filtered}, vocab)
    app = B.application_features(app_src, v.get("application", {}))
    parts = build_parts(tables, v)
    wide = join_feature_blocks(app, [p.rows for p in parts], CLIENT).selectExpr(*map(sql_ref, app.columns), *[c for p in parts for c in p.columns])
    return nonfinite_to_null_all(wide, exclude=[CLIENT])


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    fx = load_fixtures(spark, sf_dir)
    return {
        "application": fx["fx_application"],
        "bureau": fx["fx_bureau"],
        "bureau_balance": fx["fx_bureau_balance"],
        "previous_application": fx["fx_previous_application"],
        "pos_cash": fx["fx_pos_cash"],
        "installments": fx["fx_installments"],
        "credit_card": fx["fx_credit_card"],
    }


