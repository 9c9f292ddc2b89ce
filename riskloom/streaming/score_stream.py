"""Scoring on a stream (M12): feature rows arrive as files, scores leave as files, each batch once.

Every micro-batch is scored by the fitted pipeline and written as a folder of its own, ``scores/batch_id=N``, which a replay of the batch replaces as a whole;
then the batch is entered in the ledger, ``ledger/batch_id=N``. The checkpoint location (in the shared checkpoint folder) records processed files, so a
query that stopped at any point, also between the scores and the ledger or between the ledger and the checkpoint's commit, replays that batch and leaves one
copy of its scores. Readers take the batches of the ledger only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.model import batch_score

LEDGER = "batch_id long, rows long"


def enter(spark: SparkSession, output_dir: str, batch_id: int, rows: int) -> None:
    """The ledger's entry of a batch; written again by a replay, with the same content."""
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{output_dir}/ledger/batch_id={batch_id}")


def batch_sink(model: PipelineModel, output_dir: str, id_col: str = "SK_ID_CURR") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: scores of the batch, then its entry in the ledger."""

    def write(rows: DataFrame, batch_id: int) -> None:
        path = f"{output_dir}/scores/batch_id={batch_id}"
        scored = batch_score(model, rows, id_col)
        scored.write.mode("overwrite").parquet(path)
        enter(rows.sparkSession, output_dir, batch_id, rows.sparkSession.read.schema(scored.schema).parquet(path).count())

    return write


def start_stream_score(spark: SparkSession, model: PipelineModel, input_dir: str, output_dir: str,
                       checkpoint: str, schema: T.StructType, id_col: str = "SK_ID_CURR",
                       available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the scoring stream; ``available_now`` processes what is there and stops (batch-like runs)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.parquet(input_dir).writeStream.foreachBatch(batch_sink(model, output_dir, id_col)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_ledger(spark: SparkSession, output_dir: str) -> DataFrame:
    """(batch_id, rows) of the batches that are whole."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{output_dir}/ledger")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], LEDGER)


def read_scores(spark: SparkSession, output_dir: str, id_type: str = "long", id_col: str = "SK_ID_CURR") -> DataFrame:
    """(id, prediction, probability_1, batch_id) of the batches in the ledger."""
    schema = f"`{id_col}` {id_type}, prediction int, probability_1 double, batch_id long"
    try:
        found = spark.read.schema(schema).parquet(f"{output_dir}/scores")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return found.join(read_ledger(spark, output_dir).select("batch_id"), "batch_id", "left_semi").select(id_col, "prediction", "probability_1", "batch_id")


def newest_scores(scores: DataFrame, id_col: str = "SK_ID_CURR") -> DataFrame:
    """Each client's score of the last batch that has it; of several in that batch, the largest."""
    best = F.max(F.struct("batch_id", "probability_1", "prediction")).alias("s")
    return scores.groupBy(id_col).agg(best).select(id_col, "s.prediction", "s.probability_1", "s.batch_id")


def stream_score(spark: SparkSession, model: PipelineModel, input_dir: str, output_dir: str, checkpoint: str,
                 schema: T.StructType, id_col: str = "SK_ID_CURR", timeout_s: float | None = None) -> DataFrame:
    """Run the stream over the files present, wait for it (without limit unless the caller gives one), return the scored table."""
    q = start_stream_score(spark, model, input_dir, output_dir, checkpoint, schema, id_col, available_now=True)
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("scoring stream did not finish")
    return read_scores(spark, output_dir, schema[id_col].dataType.simpleString(), id_col).drop("batch_id")
