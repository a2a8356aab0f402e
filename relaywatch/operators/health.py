"""A11 provider health from every attempt (X3, X10) and A13 merged provider
table (J4, X18, X19).

Health counts *attempts*, not calls: a provider that failed and was routed
away from still shows up. A fail is ``ok`` equal to false exactly; an
attempt without ``ok`` is not a fail here (it is in the event log, X14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaywatch.functions import status as S
from relaywatch.functions import windows as W
from relaywatch.functions.keys import attempt_provider
from relaywatch.operators.breakdowns import provider_stats, relative_share
from relaywatch.operators.recency import newest
from relaywatch.operators.series import axis_array


def recent_sample(scoped_calls: DataFrame, sample_limit: int | None,
                  measures: DataFrame | None = None) -> DataFrame:
    """The ``sample_limit`` most recent calls (ties by id), or all.

    A limit is for a caller that asks for a recency sample; the default is all.
    With the window's ``measures`` the sampled span comes from their counts
    (:mod:`relaywatch.operators.recency`), and nothing runs at build time.
    Without, it runs in two exact phases so the heavy ``attempts`` column is read only
    for the sampled span, not for the whole window:

    1. a distributed top-k over ``(ts, id)`` alone finds the key of the k-th
       most recent call (one small row comes back to the driver);
    2. the window is filtered to keys at or after it, with the date bound it
       implies, so Parquet prunes to the last dates and row groups.

    Ids are unique in the table, so phase 2 returns exactly the top k.
    ``None`` (decision D4) explodes every call of the window instead.
    """
    rows = scoped_calls.select("ts", "id", "attempts")
    if sample_limit is None:
        return rows
    if measures is not None:
        return (newest(scoped_calls, measures, "calls", sample_limit).select("ts", "id", "attempts")
                .orderBy(F.desc("ts"), F.desc("id")).limit(sample_limit))
    kth = (scoped_calls.select("ts", "id").orderBy(F.desc("ts"), F.desc("id")).limit(sample_limit)
           .agg(F.min(F.struct(F.unix_micros("ts").alias("us"), "id")).alias("k")).first()["k"])
    if kth is None:
        return rows.limit(0)
    # the instant travels as epoch microseconds: no machine-zone round trip;
    # the literal below constant-folds, so it still reaches the Parquet scan
    ts_k = F.timestamp_micros(F.lit(kth["us"]))
    after = (F.col("ts") > ts_k) | ((F.col("ts") == ts_k) & (F.col("id") >= F.lit(kth["id"])))
    recent = scoped_calls
    if "ts_date" in scoped_calls.columns:
        recent = recent.where(F.col("ts_date") >= F.to_date(ts_k))
    return recent.where(after).select("ts", "id", "attempts")


def attempt_cells(scoped_calls: DataFrame, rng: W.TimeRange,
                  sample_limit: int | None = None, measures: DataFrame | None = None) -> DataFrame:
    """(provider, t) -> attempts, fails over the exploded attempts."""
    sample = recent_sample(scoped_calls, sample_limit, measures)
    att = sample.select(W.bucket_floor(F.col("ts"), rng.bucket_seconds).alias("t"),
                        F.explode("attempts").alias("a"))
    return (att.groupBy(attempt_provider(F.col("a.provider")).alias("provider"), "t")
            .agg(F.count(F.lit(1)).alias("attempts"),
                 F.count(F.when(F.col("a.ok") == F.lit(False), F.lit(1))).alias("fails")))


def provider_health(scoped_calls: DataFrame, rng: W.TimeRange,
                    sample_limit: int | None = None, sort: bool = True,
                    measures: DataFrame | None = None) -> DataFrame:
    """A11 (array form): provider, attempts, fail_rate, buckets; by attempts desc."""
    return health_from_cells(attempt_cells(scoped_calls, rng, sample_limit, measures), rng, sort)


def cells_from_attempt_measures(attempt_measures: DataFrame, rng: W.TimeRange) -> DataFrame:
    """(provider, t) -> attempts, fails from attempts-rollup rows and edges
    (:func:`relaywatch.plans.rollup.attempt_measures`). Every bucket width
    is a multiple of the rollup's 300 s, so flooring a bucket start is exact."""
    t0 = F.col("t0")
    t = t0 - F.pmod(t0, F.lit(rng.bucket_seconds).cast("bigint"))
    return (attempt_measures.groupBy(F.col("attempt_provider").alias("provider"), t.alias("t"))
            .agg(F.sum("attempts").alias("attempts"), F.sum("fails").alias("fails")))


def provider_health_measures(attempt_measures: DataFrame, rng: W.TimeRange,
                             sort: bool = True) -> DataFrame:
    """A11 over every call of the window (D4) from the attempts rollup."""
    return health_from_cells(cells_from_attempt_measures(attempt_measures, rng), rng, sort)


def health_from_cells(cells: DataFrame, rng: W.TimeRange, sort: bool = True) -> DataFrame:
    """Per provider: totals and the status strip over the axis.

    Each provider holds at most one cell per axis bucket (W/s + 1 <= 31), so
    the collected map is bounded whatever the call volume.
    """
    cells = cells.withColumn("status", S.attempt_status(F.col("attempts"), F.col("fails")))
    per = cells.groupBy("provider").agg(
        F.sum("attempts").alias("attempts"), F.sum("fails").alias("fails"),
        F.map_from_entries(F.collect_list(F.struct("t", "status"))).alias("cells"))
    strip = F.transform(axis_array(rng),
                        lambda t: F.coalesce(F.element_at(F.col("cells"), t), F.lit("none")))
    fail_rate = F.when(F.col("attempts") > 0,
                       F.col("fails").cast("double") / F.col("attempts").cast("double")).otherwise(0.0)
    out = per.select("provider", F.col("attempts").cast("bigint").alias("attempts"),
                     fail_rate.alias("fail_rate"), strip.alias("buckets"))
    return out.orderBy(F.desc("attempts"), "provider") if sort else out


def long_form(health: DataFrame, rng: W.TimeRange) -> DataFrame:
    """A11 in long form: provider, attempts, fail_rate, t, status."""
    z = F.arrays_zip(axis_array(rng).alias("t"), F.col("buckets").alias("status"))
    return health.select("provider", "attempts", "fail_rate", F.inline(z))


def provider_health_long(scoped_calls: DataFrame, rng: W.TimeRange,
                         sample_limit: int | None = None) -> DataFrame:
    """A11 in long form over the raw calls."""
    return long_form(provider_health(scoped_calls, rng, sample_limit, sort=False), rng)


PROVIDER_TABLE_COLUMNS = ["provider", "calls", "share", "rel_share", "tokens", "spent_usd",
                          "cost_per_call", "saved_usd", "cache_hit_rate", "attempts", "fail_rate",
                          "reliability"]


def provider_table(measures: DataFrame, scoped_calls: DataFrame | None, rng: W.TimeRange,
                   sample_limit: int | None = None,
                   health: DataFrame | None = None) -> DataFrame:
    """Provider stats (who served) full-outer-joined with attempt health.

    Both inputs are per-provider aggregates, so the join is between small
    results. A provider that only ever failed appears with calls 0; one
    without attempts has attempts 0 and an empty strip. ``health`` (array
    form, e.g. from the attempts rollup) replaces the raw health of
    ``scoped_calls`` when given.
    """
    stats = provider_stats(measures, sort=False)
    if health is None:
        health = provider_health(scoped_calls, rng, sample_limit, sort=False)
    j = stats.join(health, "provider", "full")
    zero = {"calls": "CAST(0 AS BIGINT)", "share": "0D", "tokens": "CAST(0 AS BIGINT)",
            "spent_usd": "0D", "cost_per_call": "0D", "saved_usd": "0D", "cache_hit_rate": "0D",
            "attempts": "CAST(0 AS BIGINT)", "fail_rate": "0D"}
    filled = j.select("provider", *[F.expr(f"coalesce({c}, {v}) AS {c}") for c, v in zero.items()],
                      F.expr("coalesce(buckets, CAST(array() AS ARRAY<STRING>)) AS buckets"))
    # X19 over the joined rows, one a provider
    rel_share = relative_share(F.max("share").over(Window.partitionBy()))
    attempts, fail_rate = F.col("attempts"), F.col("fail_rate")
    return (filled.select(
        *PROVIDER_TABLE_COLUMNS[:3], rel_share.alias("rel_share"),
        *PROVIDER_TABLE_COLUMNS[4:11],
        S.reliability(attempts, fail_rate).alias("reliability"),
        S.reliability_tone(attempts, fail_rate).alias("reliability_tone"),
        S.ok_count(attempts, fail_rate).alias("ok_attempts"), "buckets")
        .orderBy(F.desc("calls"), "provider"))
