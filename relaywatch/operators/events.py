"""A12 failover events: the latest failed-over calls with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.functions import status as S

EVENT_LIMIT = 40

EVENT_COLUMNS = ["id", "project", "ts", "model", "winner", "ok", "latency_ms", "cost_usd",
                 "tokens", "reasons", "outcome"]


def failover_events(scoped_calls: DataFrame, limit: int | None = EVENT_LIMIT) -> DataFrame:
    """Failed-over calls, newest first (ties by id), ``limit`` rows.

    ``failed_over`` is pushed to the scan; the ordering with a limit plans as
    a top-k (TakeOrderedAndProject) that keeps ``limit`` rows per task.
    """
    rows = scoped_calls.where(F.col("failed_over"))
    out = rows.select(
        "id", "project", "ts", "model", "winner", "ok", "latency_ms",
        F.col("cost_usd").cast("double").alias("cost_usd"),
        (F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("tokens"),
        S.failure_reasons(F.col("attempts")).alias("reasons"),
        S.event_outcome(F.col("ok")).alias("outcome"),
        S.served_by(F.col("ok"), F.col("winner")).alias("served_by"),
        "attempts",
    ).orderBy(F.desc("ts"), F.desc("id"))
    return out.limit(limit) if limit is not None else out
