"""Sinks (S4-S8): table writes, build-or-load, client sample export, model and score persistence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.joins import semi_join_ids, semi_join_two_hops
from riskloom.sources.manifest import Manifest, store_manifest, stored_manifest

CLIENT = "SK_ID_CURR"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), header: bool = True) -> None:
    """Write without any index column; CSV gets a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", str(header).lower()).csv(path)
    else:
        w.format(fmt).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop FileSystem check, driver side
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False,
                  made: Manifest | None = None) -> DataFrame:
    """Read the materialised table when a complete one exists, else build, write and read it back.

    The written table also cuts the lineage of the build, so later stages restart from it after an
    executor loss instead of recomputing the whole feature plan.

    With a manifest of the inputs (``manifest(spark, tables, settings)``) the table lies under ``path`` in a folder named by the manifest's digest, and
    is loaded only if the manifest stored with it, as the last step of its build, is the same: other files, changed files or other settings
    never read an old table, and a build that broke off is done again.
    """
    if made is not None:
        path = f"{path}-{made.digest[:16]}"
    if rebuild or not _exists(spark, path) or (made is not None and stored_manifest(spark, path) != made):
        write_table(build(), path)
        if made is not None:
            store_manifest(spark, path, made)
    return spark.read.parquet(path)


def client_sample_tables(tables: Mapping[str, DataFrame], ids: DataFrame, key: str = CLIENT,
                         bureau_key: str = "SK_ID_BUREAU") -> dict[str, DataFrame]:
    """Each client table restricted to the sampled clients; bureau balance through bureau ids."""
    out = {name: semi_join_ids(t, ids, key) for name, t in tables.items() if key in t.columns}
    if "bureau_balance" in tables and "bureau" in tables:
        out["bureau_balance"] = semi_join_two_hops(tables["bureau_balance"], tables["bureau"], ids, key, bureau_key)
    return out


def export_client_sample(tables: Mapping[str, DataFrame], ids: DataFrame, out_dir: str, fmt: str = "parquet") -> list[str]:
    """Write each restricted table under ``out_dir/<name>``; returns the paths."""
    paths = []
    for name, t in client_sample_tables(tables, ids).items():
        p = f"{out_dir.rstrip('/')}/{name}"
        write_table(t, p, fmt)
        paths.append(p)
    return paths


def persist_model(model, path: str) -> None:
    """Save a fitted ``PipelineModel`` (Spark ML persistence, readable on any cluster)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def persist_attributions(long_df: DataFrame, base_value: float, path: str) -> None:
    """Attributions as parquet keyed by client id, with the base value as a column."""
    write_table(long_df.withColumn("base_value", F.lit(float(base_value))), path)


def write_scores(scores: DataFrame, path: str, id_col: str = CLIENT, prob: str = "probability_1",
                 name: str = "TARGET", fmt: str = "csv") -> None:
    """The submission table (id, score)."""
    write_table(scores.select(id_col, F.col(prob).alias(name)), path, fmt)
