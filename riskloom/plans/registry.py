"""Registered queries (one per operator of the inventory) and their DuckDB oracle SQL.

Every query reads the driver's tables through the fixture views, runs the operator over the whole
tables and ends in ``report`` (doubles rounded to 30 significant bits, same rule in the SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.report import report
from riskloom.operators import blocks as B
from riskloom.plans import oracle as O
from riskloom.plans.features import build_features, fixture_tables
from riskloom.sources.fixtures import load_fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def _sql(views: list[str], body_cols: tuple[str, list[tuple[str, str]]], keys: list[str]) -> str:
    body, cols = body_cols
    return with_fixtures(views, O.report_wrap(body, cols, keys))


# ---- flagship: the wide feature row (J1) ------------------------------------------------------

_ALL_FX = ["fx_application", "fx_bureau", "fx_bureau_balance", "fx_previous_application", "fx_pos_cash",
           "fx_installments", "fx_credit_card"]


@register("join_feature_blocks", _sql(_ALL_FX, O.features_sql(), ["SK_ID_CURR"]))
def q_join_feature_blocks(spark: SparkSession, d: str) -> DataFrame:
    return report(build_features(fixture_tables(spark, d)))


# ---- application row (P1, P3, P5, E1 without NULL column, E2) ---------------------------------


@register("application_features", _sql(["fx_application"], O.application_sql(), ["SK_ID_CURR"]))
def q_application_features(spark: SparkSession, d: str) -> DataFrame:
    return report(B.application_features(load_fixture(spark, d, "fx_application")))


# ---- blocks (A2-A10) ---------------------------------------------------------------------------------


@register("bureau_balance_block", _sql(["fx_bureau_balance"], O.bureau_balance_sql(), ["SK_ID_BUREAU"]))
def q_bureau_balance_block(spark: SparkSession, d: str) -> DataFrame:
    return report(B.bureau_balance_block(load_fixture(spark, d, "fx_bureau_balance")))


@register("bureau_block", _sql(["fx_bureau", "fx_bureau_balance"], O.bureau_sql(), ["SK_ID_CURR"]))
def q_bureau_block(spark: SparkSession, d: str) -> DataFrame:
    return report(B.bureau_block(load_fixture(spark, d, "fx_bureau"), load_fixture(spark, d, "fx_bureau_balance")))


@register("previous_block", _sql(["fx_previous_application"], O.previous_sql(), ["SK_ID_CURR"]))
def q_previous_block(spark: SparkSession, d: str) -> DataFrame:
    return report(B.previous_block(load_fixture(spark, d, "fx_previous_application")))


@register("pos_block", _sql(["fx_pos_cash"], O.pos_sql(), ["SK_ID_CURR"]))
def q_pos_block(spark: SparkSession, d: str) -> DataFrame:
    return report(B.pos_block(load_fixture(spark, d, "fx_pos_cash")))


@register("installments_block", _sql(["fx_installments"], O.installments_sql(), ["SK_ID_CURR"]))
def q_installments_block(spark: SparkSession, d: str) -> DataFrame:
    return report(B.installments_block(load_fixture(spark, d, "fx_installments")))


@register("credit_card_block", _sql(["fx_credit_card"], O.credit_card_sql(), ["SK_ID_CURR"]))
def q_credit_card_block(spark: SparkSession, d: str) -> DataFrame:
    return report(B.credit_card_block(load_fixture(spark, d, "fx_credit_card")))
