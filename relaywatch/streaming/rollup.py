"""The 300 s rollup kept by a stream over the calls table.

Over a table with commits (what the ingest writes) every micro-batch adds a delta
with the rows of the commits the rollup does not hold yet, and reads nothing else
(:func:`relaywatch.plans.rollup.add_deltas`); the files of the stream only say when.

Over a table without commits every micro-batch recomputes the dates it touches, and
any other date whose files are not those last rolled up, from the calls table
(:func:`relaywatch.plans.rollup.refresh`). Nothing is added to what is stored,
so a replayed batch or a new checkpoint counts no call twice, and a row is never
too late: files that arrive out of order, in any number of triggers, only make
their date one to recompute. Buckets align to the epoch exactly as the bucket
floor X4 does.

There, buckets that end within ``watermark`` of the newest call are left out and the
mark stored beside the rollup says so; readers take them, and dates that have
changed since, from the raw table.

:func:`start_attempts` keeps the attempts rollup (provider health) the same
way, one row per (bucket, project, serving provider, attempted provider).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaywatch.plans import rollup as R
from relaywatch.schema import CALLS_SCHEMA
from relaywatch.sources import commits, sink

WATERMARK = "10 minutes"


def calls_stream(spark: SparkSession, table_path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New files of the calls table as a stream (declared schema, no inference)."""
    schema = CALLS_SCHEMA
    fields = [f for f in schema.fields if f.name != "ts_date"]
    from pyspark.sql.types import StructType
    return (spark.readStream.schema(StructType(fields))
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .option("recursiveFileLookup", "true")
            .parquet(table_path))


def start(spark: SparkSession, table_path: str, rollup_path: str, checkpoint: str,
          trigger: dict | None = None, watermark: str = WATERMARK,
          max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Keep the rollup of the calls table up to date."""
    return _keep(spark, table_path, rollup_path, checkpoint, "rollup", trigger, watermark, max_files_per_trigger)


def start_attempts(spark: SparkSession, table_path: str, rollup_path: str, checkpoint: str,
                   trigger: dict | None = None, watermark: str = WATERMARK,
                   max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Keep the attempts rollup of the calls table up to date."""
    return _keep(spark, table_path, rollup_path, checkpoint, "attempts_rollup", trigger, watermark, max_files_per_trigger)


def _keep(spark: SparkSession, table_path: str, path: str, checkpoint: str, name: str,
          trigger: dict | None, watermark: str, max_files_per_trigger: int) -> StreamingQuery:
    log, fs = sink._path(spark, f"{path}/_spark_metadata")
    if fs.exists(log):
        # Spark reads only the files in a file sink's log, so rewritten dates would not be seen
        raise ValueError(f"{path} was written by a file sink; name a new rollup folder")

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        if commits.current(spark, table_path) is not None:
            R.add_deltas(spark, table_path, path, attempts=name == "attempts_rollup")
            return
        days = batch.select(F.to_date("ts").alias("d")).distinct().collect()
        R.refresh(spark, table_path, path, attempts=name == "attempts_rollup",
                  touched=[r["d"].isoformat() for r in days], lag=watermark)

    writer = (calls_stream(spark, table_path, max_files_per_trigger).writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint)
              .queryName(name))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
