"""Table sources (S1-S3): parquet by default, CSV with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(base_dir: str, name: str, fmt: str = "parquet") -> str:
    return f"{base_dir.rstrip('/')}/{name}.{fmt}"


def load_table(
    spark: SparkSession,
    base_dir: str,
    name: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    header: bool = True,
) -> DataFrame:
    """Read one table by name. CSV needs ``schema`` at scale (no inference pass over the data)."""
    path = table_path(base_dir, name, fmt)
    if fmt == "parquet":
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(path)
    if fmt == "csv":
        reader = spark.read.option("header", str(header).lower())
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
        return reader.csv(path)
    return spark.read.format(fmt).load(path)


def load_capped(spark: SparkSession, base_dir: str, name: str, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of the driving table by a key order (a top-k, no global sort)."""
    return load_table(spark, base_dir, name).orderBy(*[F.col(c).asc() for c in order_by]).limit(n)


def load_projected(spark: SparkSession, base_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """S3: read only the listed columns; the scan's ReadSchema carries just these."""
    return load_table(spark, base_dir, name).select(*columns)
