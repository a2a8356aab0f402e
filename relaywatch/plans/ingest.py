"""Batch ingest job (S2-S7) and its registered, write-free form.

``ingest_files`` is the production job: JSON-lines files in, the calls table
and a quarantine table out, idempotent per ``batch_id``. ``accepted_calls``
is the same logic as one DataFrame (parse, validate, first arrival per id)
for checks that write no table; it cuts the lineage after the parse with a
checkpoint in the shared checkpoint folder instead of staging files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.sources import records as Rec
from relaywatch.sources import sink
from relaywatch.sources.fixture import fixture_calls, record_lines


def write_quarantine(rejects: DataFrame, path: str, batch_id: str) -> None:
    """S6 sink: rejected lines, partitioned by batch so a replay overwrites."""
    (rejects.withColumn(sink.BATCH_COLUMN, F.lit(sink._name(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(sink.BATCH_COLUMN).parquet(path))


def ingest_lines(spark: SparkSession, lines: DataFrame, table_path: str, quarantine_path: str,
                 batch_id: str, order: list[str] = sink.ARRIVAL, explicit_ts: bool = False,
                 arrival_ts: Column | None = None) -> dict:
    """Parse, quarantine, deduplicate and append one batch of lines.

    The parsed lines are staged under the shared checkpoint folder, which cuts
    the lineage at a point every later step reuses, and removed at the end.
    """
    if arrival_ts is None:
        arrival_ts = sink.pinned_arrival(spark, table_path, batch_id)
    staged = sink.staging(spark, table_path, "parsed", batch_id)
    Rec.parse(lines, arrival_ts=arrival_ts, explicit_ts=explicit_ts).write.mode("overwrite").parquet(staged)
    parsed = spark.read.parquet(staged)
    write_quarantine(Rec.quarantine(parsed).drop(*[c for c in order if c in parsed.columns]),
                     quarantine_path, batch_id)
    fresh = sink.append(spark, Rec.accepted(parsed), table_path, batch_id, order=order)
    sink.drop_staging(spark, staged)
    return {"batch_id": batch_id, "written": fresh}


def ingest_files(spark: SparkSession, source: str, table_path: str, quarantine_path: str,
                 batch_id: str, explicit_ts: bool = False) -> dict:
    """S7 bulk load / batch ingest of a directory of JSON-lines files."""
    return ingest_lines(spark, Rec.read_lines(spark, source), table_path, quarantine_path,
                        batch_id, explicit_ts=explicit_ts)


def parsed_batch(spark: SparkSession, lines: DataFrame, explicit_ts: bool = True) -> DataFrame:
    """Parse a batch and cut the lineage, as ``ingest_lines`` does by staging.

    The split into accepted and rejected rows filters on ``reason``; left on
    an unmaterialized parse, Catalyst substitutes the whole parse expression
    into that filter and pushes it below the parse (and through a union
    feeding it), so each row is parsed twice and the fused stage can exceed
    the JVM's 64 KB method limit. A reliable checkpoint in the shared
    ``spark.checkpoint.dir`` stops that and survives a lost executor.
    """
    from relaywatch.session import checkpoint_dir

    checkpoint_dir(spark)
    return Rec.parse(lines, explicit_ts=explicit_ts).checkpoint(eager=True)


def accepted_calls(spark: SparkSession, lines: DataFrame, order: list[str]) -> DataFrame:
    """Accepted rows of one batch, first arrival per id (no stored table)."""
    return sink.dedupe_batch(Rec.accepted(parsed_batch(spark, lines)), order)


def flat(calls: DataFrame) -> DataFrame:
    """Scalar view of stored rows (money as DOUBLE, attempts summarized)."""
    return calls.select(
        "id", "project", F.col("ts").cast("timestamp_ntz").alias("ts"), "model", "winner", "ok",
        "failed_over", "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd"),
        F.col("baseline_usd").cast("double").alias("baseline_usd"),
        F.col("cached_saving_usd").cast("double").alias("cached_saving_usd"),
        "cached_input_tokens", F.size("attempts").alias("n_attempts"),
        F.col("attempts")[0]["provider"].alias("first_attempt"), "modality",
        F.col("media_usage.seconds").alias("media_seconds"), "baseline_kind",
        F.col("official_usd").cast("double").alias("official_usd"),
        F.col("est_cost_usd").cast("double").alias("est_cost_usd"), "provider_key", "model_key")


def fixture_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The F1 feed as it lands: lines spread over tasks by arrival order.

    In production the lines are files, so the parse starts a stage of its
    own. The exchange here stands in for that boundary; without it Catalyst
    pushes the parse projection through the feed's union into each branch,
    fusing the F1 derivation, ``to_json`` and the parse into one stage.
    """
    return record_lines(fixture_calls(spark, sf_dir)).repartition("_seq")


def fixture_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered check: the F1 feed with resends and junk, ingested."""
    return flat(accepted_calls(spark, fixture_feed(spark, sf_dir), ["_seq"]))


def fixture_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered check: rejected lines of the same feed, counted by reason."""
    parsed = parsed_batch(spark, fixture_feed(spark, sf_dir))
    return Rec.quarantine(parsed).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
