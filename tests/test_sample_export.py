"""S6 on small tables of its own rows: which rows are exported, and that the semi join on clients is planned below the join of order lines and orders."""

import datetime

import pytest

from riskloom.plans.features import fixture_tables
from riskloom.sources.sinks import client_sample_tables

DAY = datetime.datetime(1998, 5, 4)


@pytest.fixture
def folder(spark, tmp_path):
    customers = [(k, -1.0 if k % 2 else 5.0, "BUILDING") for k in range(1, 21)]
    orders = [(10 * k + j, k, "OFP"[j], 100.0 * k, DAY, "1-URGENT") for k in range(1, 21) for j in range(3)] + [(999, None, "O", 1.0, DAY, None)]
    lines = [(o[0], 5, 25 + n, n, 50.0 if n == 2 else 3.0, 200.0, 0.0 if n == 1 else 0.1, 0.0, "ARN"[n - 1], DAY) for o in orders for n in (1, 2, 3)]
    lines += [(None, 1, 1, 1, 1.0, 1.0, 0.1, 0.1, "A", DAY), lines[0]]
    events = [(k, 1 + k % 20, "purchase", 1.5) for k in range(40)]
    tables = {
        "customer": (customers, "c_custkey long, c_acctbal double, c_mktsegment string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                            "l_tax double, l_returnflag string, l_shipdate timestamp"),
        "events": (events, "event_id long, user_id long, event_type string, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["previous_application", "installments"])
def test_clients_are_picked_before_lines_and_orders_are_joined(spark, folder, name):
    ids = spark.range(1, 21).where("id % 4 = 0").selectExpr("id AS SK_ID_CURR")
    sample = client_sample_tables(fixture_tables(spark, folder), ids)[name]
    plan = sample._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {kind: [line.index("Join") for line in plan if f"Join {kind}" in line] for kind in ("Inner", "LeftSemi")}
    assert len(depth["Inner"]) == len(depth["LeftSemi"]) == 1
    assert depth["LeftSemi"][0] > depth["Inner"][0]


def test_exported_rows_are_those_of_the_sampled_clients(spark, folder):
    t = fixture_tables(spark, folder)
    ids = spark.createDataFrame([(4,), (8,), (8,), (None,), (77,)], "SK_ID_CURR long")
    got = client_sample_tables(t, ids)
    assert got["installments"].count() == 18
    rows = sorted(tuple(r) for r in got["previous_application"].where("SK_ID_PREV = 40").select(
        "SK_ID_CURR", "NAME_CONTRACT_STATUS", "AMT_APPLICATION", "AMT_CREDIT", "RATE_DOWN_PAYMENT", "CNT_PAYMENT", "DAYS_FIRST_DRAWING").collect())
    assert rows == [(4, "Approved", 0.0, 0.0, 0.0, 3.0, -3.0), (4, "Canceled", 200.0, 180.0, 0.1, 3.0, -3.0), (4, "Refused", 200.0, 180.0, 0.1, 50.0, 365243.0)]
    assert {r[0] for r in got["previous_application"].select("SK_ID_CURR").collect()} == {4}  # 8 has no previous application
    assert t["previous_application"].where("SK_ID_PREV = 10").count() == 4 and t["installments"].where("SK_ID_CURR IS NULL").count() == 3
