"""S5 with a manifest of the inputs, and the order-free checksum."""

import os
import shutil
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from riskloom.functions.checksum import checksum_sql, table_checksum
from riskloom.plans import pipeline as PL
from riskloom.plans.features import fixture_tables
from riskloom.session import scratch_path
from riskloom.sources.manifest import FOLDER, manifest, stored_manifest
from riskloom.sources.sinks import build_or_load


def told(spark, path, settings=None):
    return manifest(spark, {"t": spark.read.parquet(path).where("id >= 0")}, settings)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "in %41 a")  # a name that an URL writes otherwise
    spark.range(20).repartition(2).write.parquet(path)
    return path


def test_manifest_follows_files_and_settings(spark, folder, tmp_path):
    first = told(spark, folder)
    assert told(spark, folder) == first and first.inputs["t"]["files"] == 2 and first.inputs["t"]["bytes"] > 0
    assert told(spark, folder, {"a": 1}) != first
    other = str(tmp_path / "other")
    shutil.copytree(folder, other)
    assert told(spark, other) != first  # the same rows in another folder
    one = next(os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".parquet"))
    os.utime(one, (1, 1))
    touched = told(spark, folder)
    assert touched != first
    spark.range(5).write.mode("append").parquet(folder)
    assert told(spark, folder) not in (first, touched)
    assert manifest(spark, {"t": spark.read.parquet(folder).where("id > 3")}) != manifest(spark, {"t": spark.read.parquet(folder).where("id > 4")})


def test_rows_without_files_count_by_content(spark):
    a, b, c = ({"t": spark.createDataFrame(rows, "a int, b string")} for rows in ([(1, "x"), (2, None)], [(2, None), (1, "x")], [(1, "x"), (2, "")]))
    assert manifest(spark, a).inputs == manifest(spark, b).inputs != manifest(spark, c).inputs


def test_tables_are_rebuilt_when_the_files_change(spark, folder):
    path, calls = scratch_path(spark, f"m-{uuid.uuid4().hex}"), []

    def load(settings=None):
        made = told(spark, folder, settings)
        return build_or_load(spark, path, lambda: calls.append(1) or spark.read.parquet(folder).withColumn("twice", F.col("id") * 2), made=made), made

    df, made = load()
    assert df.count() == 20 and load()[0].count() == 20 and len(calls) == 1
    spark.range(20, 30).write.mode("append").parquet(folder)
    assert load()[0].count() == 30 and len(calls) == 2
    load({"x": 1})
    assert len(calls) == 3
    at = f"{path}-{made.digest[:16]}"
    assert stored_manifest(spark, at) == made and stored_manifest(spark, at + "-none") is None
    assert df.columns == ["id", "twice"]  # the manifest's folder isn't read as data


def test_a_broken_build_is_done_again(spark, folder):
    path, made = scratch_path(spark, f"m-{uuid.uuid4().hex}"), told(spark, folder)
    build_or_load(spark, path, lambda: spark.range(3), made=made)
    at = f"{path}-{made.digest[:16]}".removeprefix("file:")
    for f in os.listdir(os.path.join(at, FOLDER)):
        if f.startswith("part"):
            with open(os.path.join(at, FOLDER, f), "w") as out:
                out.write('{"inputs": {}')  # cut off
        elif f.endswith(".crc") and "part" in f:
            os.remove(os.path.join(at, FOLDER, f))
    assert stored_manifest(spark, at) is None
    assert build_or_load(spark, path, lambda: spark.range(7), made=made).count() == 7


def test_two_data_folders_never_share_a_table(spark):
    name = f"t-{uuid.uuid4().hex}"
    sizes = {}
    for d in (SF_SMALL, SF_MID, SF_SMALL):
        data, _ = PL.create_datasets(spark, fixture_tables(spark, d), name=name, sample_fraction=None)
        sizes.setdefault(d, set()).add(data.count())
    assert all(len(s) == 1 for s in sizes.values()) and sizes[SF_MID].pop() > 5 * sizes[SF_SMALL].pop()


def test_checksum_is_that_of_sql_in_any_order(spark):
    rows = [(1, "a", 0.1, True), (2, None, -2.5, None), (2, None, -2.5, None), (None, "", float("nan"), False), (4, "ü\x1d", 1e300, True), (5, "x", None, True)]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean")
    got = table_checksum(df, portable=True).first()
    assert got == table_checksum(df.repartition(3).orderBy(F.desc("i")), portable=True).first()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, s VARCHAR, d DOUBLE, b BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    assert con.sql(checksum_sql("t", ["i", "s", "b"], ["d"])).fetchall() == [(got.n_rows, got.checksum)]
    assert table_checksum(df.limit(0)).first().checksum == "0"
    assert table_checksum(df).first().checksum != table_checksum(df.withColumn("d", F.col("d") + 1e-12)).first().checksum
