"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import partial, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.textbytes import SCORED_BYTES, row_groups, string_buffers
from riskloom.session import scratch_path

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def text_or_empty(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives executor loss."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that this worker's pools hold but no longer use goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others do so themselves
    if trim:
        trim(0)


def lean(task: Callable) -> Callable:
    """A generator over batches that gives back memory at the end of its task: Spark keeps a worker for the stages after it, and the executor would hold the
    leavings of all of them."""
    @wraps(task)
    def run(*args, **kwargs) -> Iterator:
        try:
            yield from task(*args, **kwargs)
        finally:
            give_back()

    return run


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_lean(df: DataFrame, name: str) -> DataFrame:
    """As ``materialise``; the shuffle files of this write go as soon as the table is whole, so that the disk holds one phase at a time."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """16 bytes that tell rows of another id or text apart; null ids and texts are values of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(id_column), F.lit("\x00"), part(text_column))))


#: Rows of a filter table; each stands for 64 bits.
FILTER_ROWS = 1 << 18


def hash_filter(keys: DataFrame, key: Column) -> DataFrame:
    """(slot, word): a bitmap of the keys' hashes, at most ``FILTER_ROWS`` rows whatever the number of keys, to be broadcast."""
    h = F.xxhash64(key)
    bit = F.shiftrightunsigned(h, 58).cast("int")
    marks = keys.select(F.pmod(h, F.lit(FILTER_ROWS)).alias("slot"), F.expr("1L").alias("one"), bit.alias("bit"))
    return marks.select("slot", F.expr("shiftleft(one, bit)").alias("word")).groupBy("slot").agg(F.bit_or("word").alias("word"))


def passing(df: DataFrame, key: Column, bits: DataFrame, passes: bool = True) -> DataFrame:
    """The rows whose key's hash is in the bitmap (all rows of its keys and few others), or, not ``passes``, those whose hash isn't; no shuffle of ``df``."""
    slot, own, word = fresh(df, "slot"), fresh(df, "slot_of"), fresh(df, "word")
    h = F.xxhash64(key)
    right = F.broadcast(bits.select(F.col("slot").alias(own), F.col("word").alias(word)))
    found = df.withColumn(slot, F.pmod(h, F.lit(FILTER_ROWS))).join(right, F.col(slot) == F.col(own), "inner" if passes else "left")
    hit = F.getbit(F.col(word), F.shiftrightunsigned(h, 58).cast("int")) == 1
    return found.where(hit if passes else ~F.coalesce(hit, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns])


def without_keys(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``gone`` (column key), all columns unchanged. Only rows that may be gone are joined; the others never move."""
    name, mark = fresh(docs, "key"), fresh(docs, "mark")
    bits = hash_filter(gone, F.col("key"))
    maybe = passing(docs, key, bits).withColumn(name, key)
    # an outer join, as a semi or anti join would be moved below the bitmap's, and so meet all rows
    right = gone.select(F.col("key").alias(name)).distinct().withColumn(mark, F.lit(True))
    kept = maybe.join(right, name, "left").where(F.col(mark).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    return passing(docs, key, bits, passes=False).unionByName(kept)


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(parts))


def labelled_sample(labels: DataFrame, docs: DataFrame, label: str, held_out: Column, bound: int,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(h, text, y) of at most ``bound`` labelled documents outside the held-out fold, chosen by the id's hash h.

    The hash threshold, from the number of ids, keeps the ordered cut small at any size; the sample (``bound`` small rows) is broadcast.
    Rows with a null id or label are not used; repeated label rows of one id count once (largest label), and so do its texts (that of the
    smallest digest), so that no id has more than one row.
    """
    rows = (labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out)
            .withColumn("h", F.xxhash64("doc_id")))
    n = rows.select("doc_id").distinct().count()
    if n > 2 * bound:
        rows = rows.where(F.col("h") < int(1.3 * bound / n * 2**64) - 2**63)
    ids = rows.groupBy("doc_id", "h").agg(F.max("y").alias("y")).orderBy("h", "doc_id").limit(bound)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "h", text_or_empty().alias("text"), "y")
    return found.groupBy("doc_id", "h", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("h", "text", "y")


def plain_sample(docs: DataFrame, held_out: Column, bound: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(h, text, y) of at most ``bound`` documents outside the held-out fold, chosen by the id's hash h; y is 0. Rows with a null id aren't used, and an id has
    one row (the text of the smallest digest)."""
    rows = docs.where(F.col(id_column).isNotNull() & ~held_out).select(F.xxhash64(F.lit("plain"), id_column).alias("h"), text_or_empty(text_column).alias("text"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    if n > 2 * bound:
        rows = rows.where(F.col("h") < int(1.3 * bound / n * 2**64) - 2**63)
    few = rows.select("h").distinct().orderBy("h").limit(bound)
    found = rows.join(F.broadcast(few), "h").groupBy("h").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    return found.select("h", "text", F.lit(0).alias("y"))


@lean
def _feature_lists(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        for low, high in row_groups(offsets, SCORED_BYTES):
            rows, found = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            cuts = np.searchsorted(rows, np.arange(high - low + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, *[c.slice(low, high - low) for c in batch.columns[1:]]], ["found", "y", "h"])


def gather(sample: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, y) arrays of a bounded sample (h, text, y) on the driver, in the order of h: the same however the rows were dealt. Rows and features
    take 4 bytes each, as the sample's pairs are what fills the driver."""
    got = sample.select("text", "y", "h").mapInArrow(partial(_feature_lists, features=features), "found array<int>, y int, h long")
    got = got.repartition(1).sortWithinPartitions("h").toArrow()  # a bounded sample; sorted here, the driver would hold it twice
    if not got.num_rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    chunks = got["found"].chunks
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks])
    found = np.concatenate([c.flatten().to_numpy() for c in chunks])
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), found, got["y"].to_numpy().astype(np.int64)
