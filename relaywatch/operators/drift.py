"""A10 price drift: provider-reported bills against the price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaywatch.functions import status as S
from relaywatch.functions.keys import route_label

# Rows where the provider's bill differs from the predicted price.
DRIFT_EVIDENCE = "ok AND cost_usd > 0 AND est_cost_usd > 0 AND cost_usd <> est_cost_usd"


def drift_evidence() -> Column:
    """P7 as a filter; it reaches the Parquet scan as pushed predicates."""
    return F.expr(DRIFT_EVIDENCE)


def price_drift(scoped_calls: DataFrame, limit: int | None = None) -> DataFrame:
    """A10: per (model, provider) with evidence, ``|ratio - 1| > 0.2``,
    largest drift first; every group, or the first ``limit`` (the panel asks for 20).

    The row filter reaches the Parquet scan; the aggregate is partial then
    final; the limit runs as a top-k over the aggregated groups.
    """
    agg = (scoped_calls.where(drift_evidence())
           .groupBy(F.col("model_key").alias("model"), F.col("provider_key").alias("provider"))
           .agg(F.count(F.lit(1)).alias("calls"),
                F.sum("cost_usd").cast("double").alias("cost_usd"),
                F.sum("est_cost_usd").cast("double").alias("est_usd")))
    return _ranked(agg, limit)


def price_drift_measures(measures: DataFrame, limit: int | None = None) -> DataFrame:
    """A10 over a measures frame (the rollup plus its exact edges).

    The rollup keeps the evidence sums per (bucket, project, provider, model),
    so a 30-day drift reads buckets x key combinations instead of every call.
    Decimal sums make it equal to :func:`price_drift` on the raw rows.
    """
    agg = (measures.where(F.col("drift_calls") > 0)
           .groupBy(F.col("model_key").alias("model"), F.col("provider_key").alias("provider"))
           .agg(F.sum("drift_calls").cast("bigint").alias("calls"),
                F.sum("drift_cost").cast("double").alias("cost_usd"),
                F.sum("drift_est").cast("double").alias("est_usd")))
    return _ranked(agg, limit)


def _ranked(agg: DataFrame, limit: int | None) -> DataFrame:
    """P9 threshold, X16 severity, X22 row key and O3 order over the per-group sums."""
    ratio = F.when(F.col("est_usd") > 0, F.col("cost_usd") / F.col("est_usd")).otherwise(F.lit(0.0))
    out = (agg.withColumn("ratio", ratio)
           .where(F.abs(F.col("ratio") - 1) > S.DRIFT_THRESHOLD)
           .withColumn("severity", S.drift_severity(F.col("ratio")))
           .orderBy(F.abs(F.col("ratio") - 1).desc(), "model", "provider"))
    if limit is not None:
        out = out.limit(limit)
    return out.select(route_label(F.col("model"), F.col("provider")).alias("route"),
                      "model", "provider", "calls", "cost_usd", "est_usd", "ratio", "severity")
