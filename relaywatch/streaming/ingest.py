"""Streaming ingest of JSON-lines record files.

A file stream feeds ``foreachBatch``; each micro-batch runs the batch ingest
(:func:`relaywatch.plans.ingest.ingest_lines`): validate, quarantine,
first-arrival dedupe, anti join on stored ids, idempotent append.

Exactly-once under failure comes from three facts:

* the arrival time is ``current_timestamp()`` evaluated *in the stream*, which
  Structured Streaming pins to the micro-batch's timestamp recorded in the
  offset log, so a replayed batch gets the same ``ts`` (and ``ts_date``);
* the batch id written with the rows is the query id that its checkpoint keeps
  and the epoch, so a replay replaces its own rows and a new checkpoint, which
  counts its epochs from 0 again, never meets another query's;
* the anti join excludes the batch's own earlier output, so a replay
  recomputes the same rows instead of finding them "already stored".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaywatch.plans.ingest import ingest_lines

MAX_FILES_PER_TRIGGER = 1000


def record_stream(spark: SparkSession, source_dir: str,
                  max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Lines of new files in ``source_dir`` with arrival file, block and time."""
    return (spark.readStream.format("text")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(source_dir)
            .select(F.col("value"),
                    F.col("_metadata.file_modification_time").alias("_modified"),
                    F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.current_timestamp().alias("_arrival")))


def start(spark: SparkSession, source_dir: str, table_path: str, quarantine_path: str,
          checkpoint: str, stream_name: str = "ingest", trigger: dict | None = None,
          max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> StreamingQuery:
    """Start the ingest stream; ``trigger`` as for ``DataStreamWriter.trigger``
    (default: process what is available, then stop)."""

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        # position inside the file split; the micro-batch is a static frame here
        batch = batch.withColumn("_pos", F.monotonically_increasing_id())
        query = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        ingest_lines(spark, batch, table_path, quarantine_path, arrival_ts=F.col("_arrival"),
                     batch_id=f"{stream_name}-{query}-{epoch_id:012d}")

    lines = record_stream(spark, source_dir, max_files_per_trigger)
    writer = (lines.writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint)
              .queryName(stream_name))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
