"""A4 time series (J1) and A5 project timeline.

Both use the bucket axis of the window. The axis has at most ``W/s + 1``
entries (31 for the fixed windows), so it is either a broadcast side whose
size is bounded by construction, or a literal ``sequence`` array: the
timeline builds each project's status strip by looking the axis up in a
small per-project map, which needs neither a cross join nor a shuffle of the
axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.functions import status as S
from relaywatch.functions import windows as W
from relaywatch.operators import partials as P


def axis_array(rng: W.TimeRange) -> Column:
    """The axis as an ARRAY<BIGINT> literal expression."""
    vals = rng.axis_values()
    return F.sequence(F.lit(vals[0]).cast("bigint"), F.lit(vals[-1]).cast("bigint"),
                      F.lit(rng.bucket_seconds).cast("bigint"))


def timeseries(spark: SparkSession, measures: DataFrame, rng: W.TimeRange) -> DataFrame:
    """A4: per axis bucket cost, saved, cached saving and calls; gaps are 0.

    The aggregate is grouped by bucket of rows inside the window, so it has at
    most as many rows as the axis: broadcasting it is bounded by construction.
    """
    per_bucket = P.project(P.aggregate(measures, P.bucket(rng.bucket_seconds)),
                           "cost_usd", "saved_usd", "cached_saving_usd", "calls", keys=["t"])
    joined = W.axis(spark, rng).join(F.broadcast(per_bucket), "t", "left")
    return joined.select(
        F.col("t"),
        F.coalesce(F.col("cost_usd"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.col("saved_usd"), F.lit(0.0)).alias("saved"),
        F.coalesce(F.col("cached_saving_usd"), F.lit(0.0)).alias("cached_saving"),
        F.coalesce(F.col("calls"), F.lit(0)).cast("bigint").alias("calls"),
    ).orderBy("t")


def project_timeline(measures: DataFrame, rng: W.TimeRange, sort: bool = True) -> DataFrame:
    """A5 (array form): project, calls, buckets ARRAY<STRING> over the axis.

    Two aggregation levels, each with map-side partial aggregation: (project,
    bucket) counts, then per project a map bucket -> status of at most
    ``len(axis)`` entries. A project holding a third of all rows only costs
    its partial-aggregate rows, never a third of the data in one task.
    """
    cells = P.project(P.aggregate(measures, "project", P.bucket(rng.bucket_seconds)),
                      "calls", "failures", "failovers", keys=["project", "t"])
    cells = cells.withColumn("status", S.project_status(F.col("calls"), F.col("failures"),
                                                        F.col("failovers")))
    per_project = cells.groupBy("project").agg(
        F.sum("calls").cast("bigint").alias("calls"),
        F.map_from_entries(F.collect_list(F.struct("t", "status"))).alias("cells"))
    strip = F.transform(axis_array(rng),
                        lambda t: F.coalesce(F.element_at(F.col("cells"), t), F.lit("none")))
    out = per_project.select("project", "calls", strip.alias("buckets"))
    return out.orderBy(F.desc("calls"), "project") if sort else out


def project_timeline_long(measures: DataFrame, rng: W.TimeRange) -> DataFrame:
    """A5 in long form: project, calls, t, status (one row per axis bucket)."""
    tl = project_timeline(measures, rng, sort=False)
    z = F.arrays_zip(axis_array(rng).alias("t"), F.col("buckets").alias("status"))
    return (tl.select("project", "calls", F.inline(z))
            .select("project", "calls", "t", "status"))
