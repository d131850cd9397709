"""ST1: answer arriving messages with Structured Streaming.

``readStream`` over a folder of message files -> ``foreachBatch`` that scores
each micro-batch with a static model (broadcast weights) and writes its JSON
answers under ``<out>/run=<r>/batch_id=<id>`` with mode overwrite, ``r`` named
by the checkpoint. The job is stateless (no watermark needed); a replayed batch
rewrites the same folder, and the checkpoint's source log stops a file from
being read twice. Another checkpoint is another run with its own folders, and a
run whose checkpoint is gone is refused, so old answers are never overwritten.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.answers import answer_json, answer_map
from ..operators.naive_bayes import NBModel, batch_scorer, score
from ..sinks.files import is_file, path_exists
from ..sources.tables import message_key

MESSAGE_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def message_stream(spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA,
                   max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Parquet files arriving in the folder ``path`` (``glob`` filters file names), or the one file ``path``."""
    reader = spark.readStream.schema(schema)
    path = path.rstrip("/")
    if is_file(spark, path):        # a stream reads a folder
        path, glob = path.rsplit("/", 1)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(path)
    return src.withColumn("msg_id", message_key())


def start_answering(model: NBModel, stream: DataFrame, out_path: str, checkpoint: str,
                    id_col: str = "msg_id", available_now: bool = True):
    """Start the query; returns the ``StreamingQuery``."""

    spark = stream.sparkSession
    run = "r" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    root = f"{out_path.rstrip('/')}/run={run}"
    if path_exists(spark, root) and not path_exists(spark, checkpoint):
        raise ValueError(f"{root} holds answers of a run whose checkpoint is gone; name another checkpoint")
    scorer = batch_scorer(model)   # weights read once for all micro-batches (None: join path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = scorer(batch, [id_col]) if scorer is not None else score(model, batch, id_col)
        answers = answer_json(answer_map(model, scored, id_col), id_col)
        (answers.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_answers(spark: SparkSession, out_path: str) -> DataFrame:
    """The answers of all runs; none where no batch has come yet."""
    if not path_exists(spark, out_path):
        return spark.createDataFrame([], "msg_id STRING, json STRING, run STRING, batch_id INT")
    return spark.read.parquet(out_path)
