"""Group-by breakdowns: A2/A3 pill lists, A6/A7 fleet, A8 provider stats,
A9/A14 model stats, A16 project table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaywatch.functions import status as S
from relaywatch.functions.keys import FAILED
from relaywatch.operators import partials as P
from relaywatch.operators.series import project_timeline
from relaywatch.functions import windows as W


def project_list(measures: DataFrame) -> DataFrame:
    """A2: projects in the window by call count (ties by name)."""
    return (P.project(P.aggregate(measures, F.col("project").alias("name")), "calls", keys=["name"])
            .withColumnRenamed("calls", "n").orderBy(F.desc("n"), "name"))


def provider_list(measures: DataFrame) -> DataFrame:
    """A3: serving providers by call count, without ``''`` and ``(failed)``."""
    agg = P.project(P.aggregate(measures, F.col("provider_key").alias("name")), "calls", keys=["name"])
    return (agg.where((F.col("name") != "") & (F.col("name") != FAILED))
            .withColumnRenamed("calls", "n").orderBy(F.desc("n"), "name"))


FLEET_COLUMNS = ["project", "calls", "cost_usd", "saved_usd", "save_pct", "failover_rate",
                 "failures", "fail_rate", "top_provider", "top_provider_pct"]


def provider_mix(measures: DataFrame) -> DataFrame:
    """Calls per (project, serving provider), with all other measures."""
    return P.aggregate(measures, "project", "provider_key")


def fleet(measures: DataFrame, sort: bool = True) -> DataFrame:
    """A6 with J2 folded in: per project totals and the top provider.

    The provider mix (A7) is aggregated first; the project totals are the sum
    of its rows, and the top provider is ``min_by`` over (-calls, name), i.e.
    the most calls with ties to the smaller name -- one more aggregation
    level over the small mix, no join.
    """
    mix = provider_mix(measures)
    per_project = mix.groupBy("project").agg(
        *P.sums(),
        F.min_by(F.col("provider_key"), F.struct(-F.col("calls"), F.col("provider_key"))).alias("top_provider"),
        F.max("calls").alias("top_calls"))
    out = P.project(per_project, "calls", "cost_usd", "saved_usd", "save_pct", "failover_rate",
                    "failures", "fail_rate", keys=["project", "top_provider", "top_calls"])
    out = out.select(
        *FLEET_COLUMNS[:-2], F.coalesce(F.col("top_provider"), F.lit("—")).alias("top_provider"),
        F.when(F.col("calls") > 0, F.col("top_calls").cast("double") / F.col("calls").cast("double"))
        .otherwise(F.lit(0.0)).alias("top_provider_pct"))
    return out.orderBy(F.desc("calls"), "project") if sort else out


def project_table(measures: DataFrame, rng: W.TimeRange) -> DataFrame:
    """A16 with J2 and J3: fleet rows, whole-window status (X9), strip counts (X17), tones.

    One pass over the measures instead of a fleet query, a timeline query and
    a join: a GROUPING SETS aggregate produces the (project, provider) mix and
    the (project, bucket) cells together (one scan, one shuffle), and a single
    per-project aggregate then takes the totals and the top provider from the
    mix rows and the status strip from the cell rows, told apart by
    ``grouping_id``.
    """
    from relaywatch.operators.series import axis_array

    cube = (measures.withColumn("t", P.bucket(rng.bucket_seconds))
            .groupingSets([["project", "provider_key"], ["project", "t"]], "project", "provider_key", "t")
            .agg(*P.sums(), F.grouping_id().alias("gid")))
    mix = F.col("gid") == 1      # t rolled up: one row per (project, provider)
    cell = F.col("gid") == 2     # provider rolled up: one row per (project, bucket)
    status = S.project_status(F.col("calls"), F.col("failures"), F.col("failovers"))
    per_project = cube.groupBy("project").agg(
        *[F.sum(F.when(mix, F.col(n))).alias(n) for n in P.MEASURES],
        F.max(F.when(mix, F.col("modality"))).alias("modality"),
        F.min_by(F.col("provider_key"),
                 F.when(mix, F.struct(-F.col("calls"), F.col("provider_key")))).alias("top_provider"),
        F.max(F.when(mix, F.col("calls"))).alias("top_calls"),
        F.map_from_entries(F.collect_list(F.when(cell, F.struct("t", status.alias("status")))))
        .alias("cells"))
    strip = F.transform(axis_array(rng),
                        lambda t: F.coalesce(F.element_at(F.col("cells"), t), F.lit("none")))
    base = P.project(per_project, "calls", "cost_usd", "saved_usd", "save_pct", "failover_rate",
                     "failures", "fail_rate", keys=["project", "top_provider", "top_calls", strip.alias("buckets")])
    down, warn = S.strip_counts(F.col("buckets"))
    whole = (F.when(F.col("fail_rate") > S.PROJECT_DOWN_FAIL_RATE, F.lit("down"))
              .when(F.col("failover_rate") > S.PROJECT_WARN_FAILOVER_RATE, F.lit("warn"))
              .otherwise(F.lit("ok")))
    top_pct = F.when(F.col("calls") > 0, F.col("top_calls").cast("double") / F.col("calls").cast("double")) \
        .otherwise(F.lit(0.0))
    return (base.select(*FLEET_COLUMNS[:-2], F.coalesce(F.col("top_provider"), F.lit("—")).alias("top_provider"),
                        top_pct.alias("top_provider_pct"), whole.alias("status"),
                        down.alias("down_buckets"), warn.alias("warn_buckets"), "buckets")
            .select("*", S.strip_summary(F.col("down_buckets"), F.col("warn_buckets")).alias("strip_summary"),
                    S.failover_flag(F.col("failover_rate")).alias("failover_tone"),
                    S.leaked_flag(F.col("failures")).alias("leaked_tone"), S.save_flag(F.col("save_pct")).alias("save_tone"))
            .orderBy(F.desc("calls"), "project"))


STAT_COLUMNS = ["calls", "spent_usd", "cost_per_call", "avg_latency_ms", "saved_usd",
                "cache_hit_rate", "tokens"]


def _with_share(df: DataFrame) -> DataFrame:
    """Calls over their total (at least 1), and that share over the largest.

    Both come from windows over the aggregated groups, so the calls are read once. The
    groups (one a provider or model) stand in one task there, as in the sort that follows.
    """
    every = Window.partitionBy()
    share = F.col("calls").cast("double") / F.greatest(F.sum("calls").over(every), F.lit(1)).cast("double")
    return df.select("*", share.alias("share")).select("*", relative_share(F.max("share").over(every)).alias("rel_share"))


def relative_share(largest: Column) -> Column:
    """The share relative to the largest one."""
    return F.col("share") / F.greatest(largest, F.lit(1e-9))


def provider_stats(measures: DataFrame, sort: bool = True) -> DataFrame:
    """Per serving provider, including ``(failed)``; by calls desc."""
    agg = P.aggregate(measures, F.col("provider_key").alias("provider"))
    f = P.finish()
    out = agg.select(
        "provider", f["calls"].alias("calls"), f["cost_usd"].alias("spent_usd"),
        f["cost_per_call"].alias("cost_per_call"), f["avg_latency_ms"].alias("avg_latency_ms"),
        f["saved_usd"].alias("saved_usd"), f["cache_hit_rate"].alias("cache_hit_rate"),
        f["tokens"].alias("tokens"))
    out = _with_share(out).select("provider", "calls", "share", *STAT_COLUMNS[1:])
    return out.orderBy(F.desc("calls"), "provider") if sort else out


MODEL_COLUMNS = ["model", "calls", "share", "rel_share", "tokens", "spent_usd", "cost_per_call", "avg_latency_ms",
                 "ttft_ms", "tokens_per_sec", "saved_usd", "cache_hit_rate", "modality", "seconds",
                 "outputs", "unit_cost", "unit_label"]


def model_stats(measures: DataFrame) -> DataFrame:
    """A9 + A14: per model key, with X19, decode rate (G8), modality (G7) and
    per-unit cost (X11); by spend desc, then calls desc."""
    agg = P.aggregate(measures, F.col("model_key").alias("model"))
    f = P.finish()
    out = agg.select(
        "model", f["calls"].alias("calls"), f["tokens"].alias("tokens"), f["cost_usd"].alias("spent_usd"),
        f["cost_per_call"].alias("cost_per_call"), f["avg_latency_ms"].alias("avg_latency_ms"),
        f["ttft_ms"].alias("ttft_ms"), f["tokens_per_sec"].alias("tokens_per_sec"),
        f["saved_usd"].alias("saved_usd"), f["cache_hit_rate"].alias("cache_hit_rate"),
        f["modality"].alias("modality"), f["seconds"].alias("seconds"), f["outputs"].alias("outputs"))
    usd, label = S.unit_cost(F.col("modality"), F.col("spent_usd"), F.col("seconds"), F.col("outputs"))
    out = _with_share(out).select(*MODEL_COLUMNS[:-2], usd.alias("unit_cost"), label.alias("unit_label"))
    return out.orderBy(F.desc("spent_usd"), F.desc("calls"), "model")
