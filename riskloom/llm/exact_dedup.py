"""Exact dedup by a tree merge of sorted digest runs (DataFrame operators only).

Every row belongs to one of ``runs`` runs by the hash of its id. Inside a run, rows are reduced to one entry per
digest; then the runs merge in binomial rounds: in each round the runs whose numbers differ in the lowest
``fan_in`` digits meet, are merged multiway in digest order, and only the best entry of each digest remains.
After the last round one run is left, with the row that stays and the size of every class.

An entry is verified at every level: it is merged only with entries of equal SHA-256 and equal check value (length in bytes and an
independent 64-bit hash of the normalised text), so a digest that collides would form two classes.

The answer goes back down the tree: classes -> first-level entries (at most ``runs`` per digest) -> rows by
(run, digest). No step brings the rows of one digest together, so a text held by a third of all rows is spread over
``runs`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, hash_filter, materialise, passing, text_or_empty, without_keys

WHITE = " \t\n\x0b\f\r"
KEY = ["digest", "bytes", "check"]


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = 64) -> DataFrame:
    """One row per document: id, digest and check value of the text without white space, code points, run."""
    text = text_or_empty(text_column)
    return (docs.select(F.col(id_column).alias("doc_id"), F.length(text).alias("points"),
                        F.translate(text, WHITE, "").alias("norm"))
            .select("doc_id", "points", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").alias("bytes"),
                    F.xxhash64("norm").alias("check"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(runs)).alias("run")))


def merge_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8) -> tuple[DataFrame, DataFrame]:
    """(first-level entries, classes): the leaves of the tree and what is left at its root.

    The best entry has the most code points, then the smallest id (a null id comes last).
    """
    best = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    leaves = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    level, left = leaves, runs
    while left > 1:
        left = -(-left // fan_in)
        level = (level.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run", *KEY)
                 .agg(F.min("best").alias("best"), F.sum("size").alias("size")))
    return leaves, level.select(*KEY, F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = 64,
                fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty; all empty texts are one class. Ties go to the smallest id; a null id is never smaller than another.
    Rows repeated with one id are all ``kept`` if that id stays. An empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    rows = materialise(digests(docs, id_column, text_column, runs), "digests")
    leaves, classes = merge_runs(rows, runs, fan_in)
    told = leaves.select("run", *KEY).join(classes, KEY)
    return (rows.join(told, ["run", *KEY])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; of rows repeated with one id and text (white space apart) one stays.

    The pairs of id and digest that go, and those that occur twice, are joined only with the rows that may be among them; other rows never move.
    """
    digest = F.sha2(F.translate(text_or_empty(text_column), WHITE, ""), 256)
    id_text = F.coalesce(F.concat(F.lit("+"), F.col(id_column).cast("string")), F.lit("-"))
    pair = F.concat_ws("\x00", id_text, digest)
    found = materialise(exact_dedup(docs, id_column, text_column).select(
        F.concat_ws("\x00", F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("-")), "text_sha256").alias("key"), "kept"), "exact")
    gone = materialise(found.where("NOT kept").select("key").distinct(), "gone")
    twice = materialise(found.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "twice")
    kept = without_keys(docs, pair, gone)
    if twice.isEmpty():
        return kept
    name = fresh(docs, "key")
    again = passing(kept, pair, hash_filter(twice, F.col("key"))).withColumn(name, pair).join(twice.select(F.col("key").alias(name)), name)
    return without_keys(kept, pair, twice).unionByName(again.dropDuplicates([name]).drop(name))


SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT text_sha256, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN w USING (text_sha256)
"""
