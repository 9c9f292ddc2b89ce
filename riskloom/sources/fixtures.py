"""Source-table shapes built from the driver's tables (FIXTURES.md sec. 3).

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL text for the oracle. Day offsets
are doubles in both engines, counts and keys are bigint.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import load_table

# Fixed value: origin of the day offsets.
DAY_ORIGIN = "2002-01-01"


def _days(c: str) -> Column:
    return F.datediff(F.to_date(F.col(c)), F.lit(DAY_ORIGIN).cast("date")).cast("double")


def _days_sql(c: str) -> str:
    return f"CAST(date_diff('day', DATE '{DAY_ORIGIN}', CAST({c} AS DATE)) AS DOUBLE)"


def fx_application(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load_table(spark, d, "customer").select(
        k.alias("SK_ID_CURR"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("TARGET"),
        F.col("c_mktsegment").alias("NAME_INCOME_TYPE"),
        F.when(k % 50 == 7, "XNA").when(k % 37 == 5, F.lit(None).cast("string"))
        .when(k % 3 == 0, "M").otherwise("F").alias("CODE_GENDER"),
        (20000 + (k * 37) % 9000).cast("double").alias("AMT_INCOME_TOTAL"),
        F.when(k % 53 == 0, 0).otherwise(1000 + (k * 101) % 50000).cast("double").alias("AMT_CREDIT"),
        F.when(k % 106 == 0, 0).otherwise(100 + (k * 17) % 4000).cast("double").alias("AMT_ANNUITY"),
        (-(7000 + (k * 13) % 18000)).cast("double").alias("DAYS_BIRTH"),
        F.when(k % 6 == 0, 365243).otherwise(-((k * 29) % 6000)).cast("double").alias("DAYS_EMPLOYED"),
        F.when(k % 11 == 3, F.lit(None)).otherwise(1 + k % 5).cast("double").alias("CNT_FAM_MEMBERS"),
    )


def fx_bureau(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return (
        load_table(spark, d, "orders")
        .where(F.col("o_custkey") % 10 != 9)
        .select(
            F.col("o_custkey").alias("SK_ID_CURR"),
            k.alias("SK_ID_BUREAU"),
            F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "Closed")
            .otherwise("Sold").alias("CREDIT_ACTIVE"),
            F.when(k % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("CREDIT_TYPE"),
            _days("o_orderdate").alias("DAYS_CREDIT"),
            F.col("o_totalprice").alias("AMT_CREDIT_SUM"),
            F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice") * 0.5).alias("AMT_CREDIT_SUM_DEBT"),
        )
    )


def fx_bureau_balance(spark: SparkSession, d: str) -> DataFrame:
    rf = F.col("l_returnflag")
    return load_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (-(F.col("l_partkey") % 24)).alias("MONTHS_BALANCE"),
        F.when(F.col("l_suppkey") % 25 == 0, F.lit(None).cast("string"))
        .when(rf == "A", "0").when(rf == "N", "C").otherwise("X").alias("STATUS"),
    )


def _with_orders(spark: SparkSession, d: str, lines: DataFrame, order_cols: list[Column]) -> DataFrame:
    """``lines`` (``l_orderkey`` and finished columns) with the columns of their orders. All expressions are below the join, so that a semi join on the client
    can be planned below it too, on the orders alone: Spark moves one through plain columns only."""
    od = load_table(spark, d, "orders").select("o_orderkey", *order_cols)
    return lines.join(od, lines["l_orderkey"] == od["o_orderkey"], "inner")


def fx_previous_application(spark: SparkSession, d: str) -> DataFrame:
    no_price = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
    rf = F.col("l_returnflag")
    lines = load_table(spark, d, "lineitem").select(
        "l_orderkey",
        F.when(rf == "A", "Approved").when(rf == "R", "Refused").otherwise("Canceled").alias("NAME_CONTRACT_STATUS"),
        F.when(no_price & (F.col("l_linenumber") < 3), F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("AMT_APPLICATION"),
        F.when(no_price, F.lit(0.0)).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_CREDIT"),
        F.col("l_discount").alias("RATE_DOWN_PAYMENT"),
        F.col("l_quantity").alias("CNT_PAYMENT"),
        _days("l_shipdate").alias("DAYS_DECISION"),
        F.when(F.col("l_quantity") == 50, F.lit(365243.0)).otherwise(-F.col("l_quantity")).alias("DAYS_FIRST_DRAWING"),
    )
    j = _with_orders(spark, d, lines, [F.col("o_custkey").alias("SK_ID_CURR")]).where(F.col("SK_ID_CURR") % 10 != 8)
    return j.select(F.col("l_orderkey").alias("SK_ID_PREV"), "SK_ID_CURR", *lines.columns[1:])


def fx_pos_cash(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    dpd = F.floor(F.col("value")).cast("long")
    return load_table(spark, d, "events").select(
        F.col("user_id").alias("SK_ID_CURR"),
        (-(e % 96)).alias("MONTHS_BALANCE"),
        dpd.alias("SK_DPD"),
        F.when(e % 3 == 0, dpd).otherwise(F.lit(0).cast("long")).alias("SK_DPD_DEF"),
        F.col("event_type").alias("NAME_CONTRACT_STATUS"),
    )


def fx_installments(spark: SparkSession, d: str) -> DataFrame:
    no_price = (F.col("l_tax") == 0) & (F.col("l_discount") == 0)
    lines = load_table(spark, d, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("NUM_INSTALMENT_VERSION"),
        F.when(no_price, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("AMT_INSTALMENT"),
        F.when(no_price & (F.col("l_linenumber") == 1), F.lit(0.0))
        .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("AMT_PAYMENT"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(_days("l_shipdate")).alias("DAYS_ENTRY_PAYMENT"),
    )
    j = _with_orders(spark, d, lines, [F.col("o_custkey").alias("SK_ID_CURR"), (_days("o_orderdate") + 60).alias("DAYS_INSTALMENT")])
    return j.select("SK_ID_CURR", "NUM_INSTALMENT_VERSION", "AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT")


def fx_credit_card(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return (
        load_table(spark, d, "events")
        .where(F.col("event_type").isin("purchase", "error") & (F.col("user_id") % 2 == 0))
        .select(
            F.col("user_id").alias("SK_ID_CURR"),
            e.alias("SK_ID_PREV"),
            (-(e % 96)).alias("MONTHS_BALANCE"),
            F.col("value").alias("AMT_BALANCE"),
            F.when(e % 9 == 0, F.lit(None).cast("long")).otherwise(e % 5).alias("CNT_DRAWINGS_CURRENT"),
            F.col("event_type").alias("NAME_CONTRACT_STATUS"),
        )
    )


BUILDERS = {
    "fx_application": fx_application,
    "fx_bureau": fx_bureau,
    "fx_bureau_balance": fx_bureau_balance,
    "fx_previous_application": fx_previous_application,
    "fx_pos_cash": fx_pos_cash,
    "fx_installments": fx_installments,
    "fx_credit_card": fx_credit_card,
}


def load_fixture(spark: SparkSession, d: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, d)


def load_fixtures(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: b(spark, d) for n, b in BUILDERS.items()}


# ---------------------------------------------------------------------------------------------
# DuckDB text of the same views, for the oracle.

FIXTURE_SQL = {
    "fx_application": """
SELECT c_custkey AS SK_ID_CURR, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET,
  c_mktsegment AS NAME_INCOME_TYPE,
  CASE WHEN c_custkey % 50 = 7 THEN 'XNA' WHEN c_custkey % 37 = 5 THEN NULL WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
  CAST(20000 + (c_custkey * 37) % 9000 AS DOUBLE) AS AMT_INCOME_TOTAL,
  CAST(CASE WHEN c_custkey % 53 = 0 THEN 0 ELSE 1000 + (c_custkey * 101) % 50000 END AS DOUBLE) AS AMT_CREDIT,
  CAST(CASE WHEN c_custkey % 106 = 0 THEN 0 ELSE 100 + (c_custkey * 17) % 4000 END AS DOUBLE) AS AMT_ANNUITY,
  CAST(-(7000 + (c_custkey * 13) % 18000) AS DOUBLE) AS DAYS_BIRTH,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 29) % 6000) END AS DOUBLE) AS DAYS_EMPLOYED,
  CAST(CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE 1 + c_custkey % 5 END AS DOUBLE) AS CNT_FAM_MEMBERS
FROM customer""",
    "fx_bureau": f"""
SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
  CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderpriority END AS CREDIT_TYPE,
  {_days_sql('o_orderdate')} AS DAYS_CREDIT, o_totalprice AS AMT_CREDIT_SUM,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * CAST(0.5 AS DOUBLE) END AS AMT_CREDIT_SUM_DEBT
FROM orders WHERE o_custkey % 10 <> 9""",
    "fx_bureau_balance": """
SELECT l_orderkey AS SK_ID_BUREAU, -(l_partkey % 24) AS MONTHS_BALANCE,
  CASE WHEN l_suppkey % 25 = 0 THEN NULL WHEN l_returnflag = 'A' THEN '0' WHEN l_returnflag = 'N' THEN 'C' ELSE 'X' END AS STATUS
FROM lineitem""",
    "fx_previous_application": f"""
SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
  CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
  CASE WHEN l_discount = 0 AND l_tax = 0 AND l_linenumber < 3 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS AMT_APPLICATION,
  CASE WHEN l_discount = 0 AND l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) END AS AMT_CREDIT,
  l_discount AS RATE_DOWN_PAYMENT, l_quantity AS CNT_PAYMENT, {_days_sql('l_shipdate')} AS DAYS_DECISION,
  CASE WHEN l_quantity = 50 THEN CAST(365243 AS DOUBLE) ELSE -l_quantity END AS DAYS_FIRST_DRAWING
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 8""",
    "fx_pos_cash": """
SELECT user_id AS SK_ID_CURR, -(event_id % 96) AS MONTHS_BALANCE, CAST(floor(value) AS BIGINT) AS SK_DPD,
  CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS SK_DPD_DEF,
  event_type AS NAME_CONTRACT_STATUS
FROM events""",
    "fx_installments": f"""
SELECT o_custkey AS SK_ID_CURR, l_linenumber AS NUM_INSTALMENT_VERSION,
  CASE WHEN l_tax = 0 AND l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS AMT_INSTALMENT,
  CASE WHEN l_tax = 0 AND l_discount = 0 AND l_linenumber = 1 THEN CAST(0 AS DOUBLE)
       ELSE l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) END AS AMT_PAYMENT,
  {_days_sql('o_orderdate')} + 60 AS DAYS_INSTALMENT,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE {_days_sql('l_shipdate')} END AS DAYS_ENTRY_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_credit_card": """
SELECT user_id AS SK_ID_CURR, event_id AS SK_ID_PREV, -(event_id % 96) AS MONTHS_BALANCE, value AS AMT_BALANCE,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 5 END AS CNT_DRAWINGS_CURRENT, event_type AS NAME_CONTRACT_STATUS
FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 2 = 0""",
}


def with_fixtures(names: Iterable[str], body: str, extra_ctes: Iterable[tuple[str, str]] = ()) -> str:
    """``WITH <fixture views>, <extra ctes> <body>`` for the oracle SQL."""
    ctes = [f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in dict.fromkeys(names)]
    ctes += [f"{n} AS ({q})" for n, q in extra_ctes]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


# Column dictionary of the fixture tables (feature root -> description), the
# stand-in for the source's column-description file.
COLUMN_DICTIONARY = (
    ("SK_ID_CURR", "Client id (customer key)"),
    ("SK_ID_BUREAU", "Credit bureau record id (order key)"),
    ("SK_ID_PREV", "Previous application id"),
    ("TARGET", "1 when the client defaulted (negative account balance)"),
    ("NAME_INCOME_TYPE", "Income type of the client (market segment)"),
    ("CODE_GENDER", "Gender of the client"),
    ("AMT_INCOME_TOTAL", "Income of the client"),
    ("AMT_CREDIT", "Credit amount of the loan"),
    ("AMT_ANNUITY", "Loan annuity"),
    ("DAYS_BIRTH", "Client's age in days at the time of application"),
    ("DAYS_EMPLOYED", "Days before the application the person started current employment"),
    ("CNT_FAM_MEMBERS", "Number of family members of the client"),
    ("CREDIT_ACTIVE", "Status of the credit bureau reported credit"),
    ("CREDIT_TYPE", "Type of credit bureau credit"),
    ("DAYS_CREDIT", "Days before the application the client applied for the bureau credit"),
    ("AMT_CREDIT_SUM", "Current credit amount for the bureau credit"),
    ("AMT_CREDIT_SUM_DEBT", "Current debt on the bureau credit"),
    ("MONTHS_BALANCE", "Month of balance relative to the application date"),
    ("STATUS", "Status of the bureau loan during the month"),
    ("NAME_CONTRACT_STATUS", "Contract status during the month or of the previous application"),
    ("AMT_APPLICATION", "Amount the client asked for on the previous application"),
    ("RATE_DOWN_PAYMENT", "Down payment rate normalized on the previous credit"),
    ("CNT_PAYMENT", "Term of the previous credit at application"),
    ("DAYS_DECISION", "Days before the current application the previous decision was made"),
    ("DAYS_FIRST_DRAWING", "Days before the application the first disbursement was made"),
    ("SK_DPD", "Days past due during the month of the previous credit"),
    ("SK_DPD_DEF", "Days past due with tolerance during the month"),
    ("NUM_INSTALMENT_VERSION", "Version of the installment calendar"),
    ("AMT_INSTALMENT", "Prescribed installment amount"),
    ("AMT_PAYMENT", "What the client actually paid on the installment"),
    ("DAYS_INSTALMENT", "When the installment was supposed to be paid"),
    ("DAYS_ENTRY_PAYMENT", "When the installment was actually paid"),
    ("AMT_BALANCE", "Balance during the month of the previous credit"),
    ("CNT_DRAWINGS_CURRENT", "Number of drawings during the month"),
)

# Descriptions of derived features (formula text).
DERIVED_DEFINITIONS = (
    ("DAYS_EMPLOYED_PERC", "DAYS_EMPLOYED / DAYS_BIRTH"),
    ("INCOME_CREDIT_PERC", "AMT_INCOME_TOTAL / AMT_CREDIT"),
    ("INCOME_PER_PERSON", "AMT_INCOME_TOTAL / CNT_FAM_MEMBERS"),
    ("ANNUITY_INCOME_PERC", "AMT_ANNUITY / AMT_INCOME_TOTAL"),
    ("PAYMENT_RATE", "AMT_ANNUITY / AMT_CREDIT"),
    ("APP_CREDIT_PERC", "AMT_APPLICATION / AMT_CREDIT"),
    ("PAYMENT_PERC", "AMT_PAYMENT / AMT_INSTALMENT"),
    ("PAYMENT_DIFF", "AMT_INSTALMENT - AMT_PAYMENT"),
    ("DPD", "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT"),
    ("DBD", "DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT"),
    ("INSTAL_COUNT", "Number of installments accounts"),
    ("POS_COUNT", "Number of point-of-sale and cash loan months"),
    ("CC_COUNT", "Number of credit card months"),
)


def dictionary_frame(spark: SparkSession) -> DataFrame:
    """The column dictionary as a two-column table (Row, Description)."""
    return spark.createDataFrame(list(COLUMN_DICTIONARY), "Row string, Description string")


def dictionary_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(r, d.replace("'", "''")) for r, d in COLUMN_DICTIONARY)
    return f"SELECT * FROM (VALUES {rows}) AS t(Row, Description)"


def derived_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DERIVED_DEFINITIONS), "Row string, Description string")


def derived_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(r, d) for r, d in DERIVED_DEFINITIONS)
    return f"SELECT * FROM (VALUES {rows}) AS t(Row, Description)"
