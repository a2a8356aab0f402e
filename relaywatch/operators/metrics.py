"""A1 stat-row metrics and A15 change against the previous window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.functions import status as S
from relaywatch.functions import windows as W
from relaywatch.operators import partials as P
from relaywatch.sources.calls import scope_filter

METRIC_COLUMNS = [
    "calls", "failovers", "caught", "failures", "failover_rate", "cost_usd", "saved_usd",
    "save_pct", "cached_saving_usd", "cached_input_tokens", "cache_hit_rate",
    "avg_latency_ms", "ttft_ms", "tokens", "input_tokens", "output_tokens",
]


def metrics(measures: DataFrame) -> DataFrame:
    """A1: one row over a scoped measures frame (a global aggregate).

    Zero rows in scope still give one row: zeros, and a null ttft.
    """
    return P.project(P.aggregate(measures), *METRIC_COLUMNS)


# The stat tiles that carry a change line, and the metric column each reads.
CHANGE_METRICS = [("saved", "saved_usd"), ("cached_saving", "cached_saving_usd"),
                  ("spent", "cost_usd"), ("calls", "calls")]


def metrics_change(calls: DataFrame, window: str, as_of: dt.datetime | str,
                   project: str | None = None, provider: str | None = None) -> DataFrame:
    """Current and previous window in one pass, long form.

    Instead of two queries and a join of their single rows, one scan covers
    ``(as_of - 2W, as_of]`` and every row is tagged with its period; the two
    periods are two groups of one aggregate. Output: metric, cur, prev,
    change (X12), direction.
    """
    cur, prev = W.current(window, as_of), W.previous(window, as_of)
    span = W.TimeRange(prev.start, cur.end, cur.bucket_seconds)
    rows = calls.where(span.predicate() & scope_filter(project, provider))
    period = F.when(F.col("ts") > F.lit(cur.start), F.lit("cur")).otherwise(F.lit("prev"))
    tagged = P.row_measures(rows.withColumn("period", period), extra=["period"])
    return change_table(tagged)


def change_table(tagged: DataFrame) -> DataFrame:
    """Aggregate a measures frame with a ``period`` column into the change table."""
    periods = P.aggregate(tagged.drop("t0"), "period")
    f = P.finish()
    per = periods.select("period", *[f[c].cast("double").alias(m) for m, c in CHANGE_METRICS])
    # two rows (cur, prev) -> one row per metric, without a join
    wide = per.agg(*[F.max(F.when(F.col("period") == p, F.col(m))).alias(f"{m}_{p}")
                     for m, _ in CHANGE_METRICS for p in ("cur", "prev")])
    stack = ", ".join(f"'{m}', coalesce({m}_cur, 0D), coalesce({m}_prev, 0D)" for m, _ in CHANGE_METRICS)
    long = wide.selectExpr(f"stack({len(CHANGE_METRICS)}, {stack}) AS (metric, cur, prev)")
    return long.select("metric", "cur", "prev",
                       S.change(F.col("cur"), F.col("prev")).alias("change"),
                       S.direction(F.col("cur"), F.col("prev")).alias("direction"))


def stat_flags(m: DataFrame) -> DataFrame:
    """X13 and X20 over an A1 row: caught share and tile tones."""
    return m.select(
        "*",
        S.caught_share(F.col("caught"), F.col("failovers")).alias("caught_share"),
        S.caught_good(S.caught_share(F.col("caught"), F.col("failovers"))).alias("caught_good"),
        S.failover_flag(F.col("failover_rate")).alias("failover_tone"),
        S.leaked_flag(F.col("failures")).alias("leaked_tone"),
        S.save_flag(F.col("save_pct")).alias("save_tone"))
