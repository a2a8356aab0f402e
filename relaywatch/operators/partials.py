"""Additive measures: the common input of the aggregate operators.

Every aggregate the dashboard shows is a function of a few additive sums
(counts, decimal money sums, latency sums, ...). A *measures frame* holds
those sums for some grouping of calls, with the grouping keys
``project, provider_key, model_key`` and ``t0`` (an epoch second, or a bucket
start that is a multiple of 300 s). Two producers exist:

* :func:`row_measures` -- one row per call (the raw plan), and
* the stored rollup (:mod:`relaywatch.plans.rollup`) -- one row per
  (300 s bucket, project, provider, model).

Operators group a measures frame by their keys and ``sum`` every measure
(``max`` for modality), so they run unchanged on either producer, and Spark's
partial aggregation combines rows map-side before any shuffle. Means and
ratios are formed only in :func:`finish`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaywatch.operators.drift import DRIFT_EVIDENCE

KEYS = ["project", "provider_key", "model_key", "t0"]

# a generation span exists: the G8 evidence rows
_DECODE = "ttft_ms IS NOT NULL AND latency_ms > ttft_ms"

# measure name -> how a single call contributes, as SQL text (one JVM object
# per column keeps building a query's plan on the driver cheap)
_ROW = {
    "calls": "1",
    "failovers": "CAST(failed_over AS INT)",
    "caught": "CAST(failed_over AND ok AS INT)",
    "failures": "CAST(NOT ok AS INT)",
    "cost": "cost_usd",
    # save-rate denominator: the baseline of rows that carry one
    "baseline": "CASE WHEN baseline_usd > 0 THEN baseline_usd END",
    # Clamped per row, only for rows that carry a baseline
    "saved": "CASE WHEN baseline_usd > 0 THEN greatest(baseline_usd - cost_usd, 0) END",
    "cached_saving": "cached_saving_usd",
    "cached_input": "cached_input_tokens",
    "input_tok": "input_tokens",
    "output_tok": "output_tokens",
    "latency_sum": "latency_ms",
    "ttft_sum": "ttft_ms",
    "ttft_n": "CAST(ttft_ms IS NOT NULL AS INT)",
    # Output tokens and generation time (latency - ttft) of the same rows
    "decode_out": f"CASE WHEN {_DECODE} THEN output_tokens END",
    "decode_ms": f"CASE WHEN {_DECODE} THEN latency_ms - ttft_ms END",
    "seconds": "CAST(media_usage.seconds AS DECIMAL(18,6))",
    "outputs": "CAST(media_usage.outputs AS DECIMAL(18,6))",
    # A10 evidence (P7) summed per key, so price drift reads the rollup too
    "drift_calls": f"CASE WHEN {DRIFT_EVIDENCE} THEN 1 END",
    "drift_cost": f"CASE WHEN {DRIFT_EVIDENCE} THEN cost_usd END",
    "drift_est": f"CASE WHEN {DRIFT_EVIDENCE} THEN est_cost_usd END",
}
MEASURES = list(_ROW)


def row_measures(calls: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One measures row per call; ``t0`` is the call's epoch second."""
    return calls.select(
        "project", "provider_key", "model_key", *extra,
        F.unix_seconds(F.col("ts")).alias("t0"),
        *[F.expr(f"{text} AS `{name}`") for name, text in _ROW.items()],
        F.col("modality"))


def sums(names: list[str] | None = None) -> list[Column]:
    """Aggregate expressions that combine measures rows (re-aggregation).

    Written as SQL text: one JVM object per column instead of one per
    sub-expression keeps plan construction on the driver cheap.
    """
    names = names or MEASURES
    out = [F.expr(f"sum(`{n}`) AS `{n}`") for n in names]
    if "modality" not in names:
        out.append(F.expr("max(modality) AS modality"))
    return out


def bucket(seconds: int) -> Column:
    """Bucket start of ``t0`` for a width that is a multiple of 300 s."""
    t0 = F.col("t0")
    return (t0 - F.pmod(t0, F.lit(seconds).cast("bigint"))).alias("t")


def aggregate(measures: DataFrame, *keys: Column | str) -> DataFrame:
    """Group a measures frame and combine every measure."""
    if keys:
        return measures.groupBy(*keys).agg(*sums())
    return measures.agg(*sums())


class _Columns:
    """Result columns built on first use.

    A panel uses a few of the two dozen, and each one costs driver-to-JVM
    calls to construct, so only the ones asked for are built.
    """

    def __init__(self, texts: dict[str, str]):
        self._texts, self._built = texts, {}

    def __getitem__(self, name: str) -> Column:
        if name not in self._built:
            self._built[name] = F.expr(self._texts[name])
        return self._built[name]


def _bigint(n: str) -> str:
    """An already-summed integer measure: 0 when absent, BIGINT."""
    return f"CAST(coalesce(`{n}`, 0) AS BIGINT)"


def _double(n: str) -> str:
    """An already-summed decimal measure: 0 when absent, then DOUBLE."""
    return f"CAST(coalesce(`{n}`, 0) AS DOUBLE)"


def _ratio(num: str, den: str) -> str:
    """``num / den`` in DOUBLE, 0 when ``den`` is not positive."""
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0D END"


def finish() -> _Columns:
    """Result columns over combined measures (means and guarded ratios)."""
    calls = _bigint("calls")
    return _Columns({
        "calls": calls,
        "failovers": _bigint("failovers"),
        "caught": _bigint("caught"),
        "failures": _bigint("failures"),
        "failover_rate": _ratio(_bigint("failovers"), calls),
        "fail_rate": _ratio(_bigint("failures"), calls),
        "cost_usd": _double("cost"),
        "baseline_usd": _double("baseline"),
        "saved_usd": _double("saved"),
        "save_pct": _ratio(_double("saved"), _double("baseline")),
        "cached_saving_usd": _double("cached_saving"),
        "cached_input_tokens": _bigint("cached_input"),
        "cache_hit_rate": _ratio(_bigint("cached_input"), _bigint("input_tok")),
        "avg_latency_ms": _ratio(_bigint("latency_sum"), calls),
        "ttft_ms": "CASE WHEN ttft_n > 0 THEN CAST(ttft_sum AS DOUBLE) / CAST(ttft_n AS DOUBLE) END",
        "tokens": f"{_bigint('input_tok')} + {_bigint('output_tok')}",
        "input_tokens": _bigint("input_tok"),
        "output_tokens": _bigint("output_tok"),
        "cost_per_call": _ratio(_double("cost"), calls),
        # Output tokens per generation second, null without evidence
        "tokens_per_sec": "(CAST(decode_out AS DOUBLE) / CAST(nullif(decode_ms, 0) AS DOUBLE)) * 1000D",
        "seconds": "CAST(coalesce(seconds, 0D) AS DOUBLE)",
        "outputs": "CAST(coalesce(outputs, 0D) AS DOUBLE)",
        "modality": "modality",
    })


def project(df: DataFrame, *names: str, keys: list[Column | str] = ()) -> DataFrame:
    """Select ``keys`` and the named :func:`finish` columns."""
    f = finish()
    return df.select(*keys, *[f[n].alias(n) for n in names])
