"""What a stored table was built from (S5): a manifest of the input files, the plans over them and the settings.

Files are listed by Spark's ``binaryFile`` source (path, length and modification time; contents aren't read), so any store that Spark reads will do. A table
that reads no files is known by an order-free checksum of its rows. The manifest's digest names the stored table's folder, and the manifest itself lies
in the folder: a table is loaded only if what is stored beside it is what the caller has now.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.checksum import table_checksum

FOLDER = "_manifest"


@dataclass(frozen=True)
class Manifest:
    """Per input table its files (number, bytes, digest) or rows (number, checksum), and a digest of plans and settings."""

    inputs: dict
    plans: str
    settings: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def listed_files(spark: SparkSession, df: DataFrame) -> DataFrame | None:
    """(path, modificationTime, length) of the files that ``df`` reads; None if it reads none."""
    paths = [re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(p)) for p in df.inputFiles()]
    return spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "length") if paths else None


def input_state(spark: SparkSession, df: DataFrame) -> dict:
    """One input's state: a rewritten, added, removed or grown file changes it, and so does the same file in another folder."""
    files = listed_files(spark, df)
    if files is None:
        told = table_checksum(df).first()
        return {"rows": told["n_rows"], "checksum": told["checksum"]}
    told = table_checksum(files.select("path", "length", F.unix_micros("modificationTime").alias("changed"))).first()
    return {"files": told["n_rows"], "checksum": told["checksum"], "bytes": files.agg(F.sum("length")).first()[0]}


def plan_text(df: DataFrame) -> str:
    """The analysed plan with normalised attribute numbers."""
    return df._jdf.queryExecution().analyzed().canonicalized().toString()  # noqa: SLF001


def manifest(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping | None = None) -> Manifest:
    """The state of the inputs now. Settings must be what ``json`` can write."""
    plans = hashlib.sha256("\n".join(f"{k}: {plan_text(t)}" for k, t in sorted(tables.items())).encode()).hexdigest()
    return Manifest({k: input_state(spark, t) for k, t in sorted(tables.items())}, plans, json.dumps(settings or {}, sort_keys=True))


def store_manifest(spark: SparkSession, path: str, made: Manifest) -> None:
    """Write it into the table's folder (a name that readers of the table skip), as the last step of a build."""
    row = json.dumps(asdict(made) | {"digest": made.digest}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{FOLDER}")


def stored_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest in a table's folder, None if there is none or it isn't whole."""
    try:
        rows = spark.read.text(f"{path}/{FOLDER}").collect()  # one line
        found = json.loads(rows[0]["value"])
        made = Manifest(found["inputs"], found["plans"], found["settings"])
        return made if made.digest == found["digest"] else None
    except (LookupError, ValueError, AnalysisException):
        return None
