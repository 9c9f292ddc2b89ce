"""What the wide feature row costs: one shuffle of each table's rows, and no table computed twice."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators import blocks as B
from riskloom.operators.impute import cleanup
from riskloom.plans.features import build_features, fixture_tables
from riskloom.sources.fixtures import load_fixture


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_aggregate_where_their_rows_lie(spark):
    """No aggregation buffers of a block are shuffled, however the input is dealt, nunique included."""
    for block, fixture in ((B.previous_block, "fx_previous_application"), (B.installments_block, "fx_installments"), (B.pos_block, "fx_pos_cash"),
                           (B.credit_card_block, "fx_credit_card")):
        after = plan(block(load_fixture(spark, SF_SMALL, fixture))).split("Exchange hashpartitioning(SK_ID_CURR")
        assert len(after) == 2 and "Aggregate" in after[0] and "Exchange" not in after[0] and "Aggregate" not in after[1]


def test_blocks_are_joined_without_another_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = plan(build_features(fixture_tables(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\((?:SK_ID_CURR|c_custkey|o_custkey|user_id)", told)
    assert len(dealt) == 6  # the application and five blocks


def test_output_of_the_blocks_is_short_enough_to_be_compiled(spark):
    """The JVM compiles no method above 8000 bytes of code; a block's output of one row was 20,000."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for n, value in zip(names, ("false", "-1"), strict=True):
        spark.conf.set(n, value)
    out = io.StringIO()
    try:
        with contextlib.redirect_stdout(out):
            build_features(fixture_tables(spark, SF_SMALL)).explain("codegen")
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    sizes = [int(re.search(r"maxMethodCodeSize:(\d+)", part).group(1)) for part in out.getvalue().split("== Subtree")[1:] if "HashAggregate(" in part]
    assert len(sizes) >= 6 and max(sizes) < 8000


def test_blocks_with_null_keys_and_one_large_client(spark):
    """The placing changes no group: a null key is one group, a client with most of the rows another."""
    rows = [(None, 1, 5, 5, "a"), (None, 2, 7, 0, None)] + [(7, k, k % 3, 1, "b") for k in range(500)] + [(k, 1, 1, 0, "a") for k in range(20, 30)]
    pos = spark.createDataFrame(rows, "SK_ID_CURR long, MONTHS_BALANCE long, SK_DPD long, SK_DPD_DEF long, NAME_CONTRACT_STATUS string").repartition(7)
    got = {r["SK_ID_CURR"]: r for r in B.pos_block(pos).collect()}
    assert len(got) == 12 and got[None]["POS_COUNT"] == 2 and got[7]["POS_COUNT"] == 500
    assert got[7]["POS_SK_DPD_MEAN"] == sum(k % 3 for k in range(500)) / 500 and got[None]["POS_NAME_CONTRACT_STATUS_nan_MEAN"] == 0.5


def test_cleanup_computes_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    df = spark.range(40).select(F.col("id").alias("SK_ID_CURR"), counted("id").alias("a"), F.when(F.col("id") < 4, 1.0).alias("sparse"),
                                F.when(F.col("id") != 5, 2.0).alias("b"))
    got = cleanup(df, 0.6)
    assert got.columns == ["SK_ID_CURR", "a", "b"] and sorted(r.a for r in got.collect()) == [float(k) for k in range(40) if k != 5]
    assert seen.value == 40
