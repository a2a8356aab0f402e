"""The overview and drill-down reports as a dict of DataFrames.

One call gives every panel of the dashboard for a window and a scope, all
anchored at the same ``as_of`` (one shared instant, unlike per-statement
clocks). Panels are lazy DataFrames; nothing is collected here.

Scope rules: the project and provider pill lists (A2, A3) ignore both
scopes; the fleet and project timeline (A5, A6) take the provider scope only;
everything else takes both.

A page is one read: :func:`stage` aggregates the current and the previous window once,
to one table of measures by (period, bucket, project, provider, model) and one of attempts
by (bucket, project, serving provider, attempted provider), from raw calls or from
stored rollups with their exact edges. :func:`overview` over such a :class:`Cube`
takes every panel from these two small tables but the latest events, which are rows.
Without a cube each panel reads the rollup (aggregates) or the raw table by itself.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.functions import windows as W
from relaywatch.operators import breakdowns as B
from relaywatch.operators import drift as D
from relaywatch.operators import events as E
from relaywatch.operators import health as H
from relaywatch.operators import metrics as Mt
from relaywatch.operators import partials as P
from relaywatch.operators import series as Se
from relaywatch.operators.recency import newest
from relaywatch.plans import rollup as R
from relaywatch.sources.calls import ALL, scope_filter, scoped


def _measures(calls: DataFrame, rollup: DataFrame | None, rng: W.TimeRange,
              project: str | None, provider: str | None) -> DataFrame:
    if rollup is not None:
        return R.measures(calls, rollup, rng, project, provider)
    return P.row_measures(scoped(calls, rng, project, provider))


class Cube(NamedTuple):
    """The staged aggregates of one page."""

    cells: DataFrame
    attempts: DataFrame


def stage(spark: SparkSession, calls: DataFrame, window: str, as_of: dt.datetime | str, root: str,
          rollup: DataFrame | None = None, attempts_rollup: DataFrame | None = None) -> Cube:
    """Aggregate a page's windows once and write them below ``root``.

    Both tables hold at most axis x key combinations, whatever the number of
    calls; the page's scopes are filters on them.
    """
    window = W.as_window(window)
    cur, prev = W.current(window, as_of), W.previous(window, as_of)
    if rollup is not None:
        tagged = [R.measures(calls, rollup, rng).withColumn("period", F.lit(p)) for rng, p in ((cur, "cur"), (prev, "prev"))]
        tagged = tagged[0].unionByName(tagged[1])
    else:
        both = W.TimeRange(prev.start, cur.end, cur.bucket_seconds)
        period = F.when(F.col("ts") > F.lit(cur.start), F.lit("cur")).otherwise(F.lit("prev"))
        tagged = P.row_measures(calls.where(both.predicate()).withColumn("period", period), extra=["period"])
    if attempts_rollup is not None:
        tries = R.attempt_measures(calls, attempts_rollup, cur)
    else:
        tries = R.attempt_rows(scoped(calls, cur))

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("t0", F.col("t0") - F.pmod("t0", F.lit(cur.bucket_seconds)))

    bucketed(tagged).groupBy("period", "t0", *R.GROUP).agg(*P.sums()).write.mode("overwrite").parquet(f"{root}/cells")
    bucketed(tries).groupBy("t0", *R.ATTEMPT_GROUP).agg(*[F.sum(c).alias(c) for c in R.ATTEMPT_MEASURES]).write.mode(
        "overwrite").parquet(f"{root}/attempts")
    return Cube(spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/attempts"))


def change_from_rollup(calls: DataFrame, rollup: DataFrame, cur: W.TimeRange, prev: W.TimeRange,
                       project: str | None, provider: str | None) -> DataFrame:
    """A15 from rollup-plus-edges measures of the two windows, tagged by period."""
    tagged = (R.measures(calls, rollup, cur, project, provider).withColumn("period", F.lit("cur"))
              .unionByName(R.measures(calls, rollup, prev, project, provider)
                           .withColumn("period", F.lit("prev"))))
    return Mt.change_table(tagged)


def overview(spark: SparkSession, calls: DataFrame, window: str, as_of: dt.datetime | str,
             project: str = ALL, provider: str = ALL, rollup: DataFrame | None = None,
             sample_limit: int | None = None, drift_limit: int | None = None,
             cube: Cube | None = None) -> dict[str, DataFrame]:
    """C1 (``project`` is ``all``) or C2 (one project): every panel."""
    window = W.as_window(window)
    cur, prev = W.current(window, as_of), W.previous(window, as_of)
    proj = None if project in (None, "", ALL) else project
    prov = None if provider in (None, "", ALL) else provider
    rows = scoped(calls, cur, proj, prov)

    if cube is not None:
        now, scope = cube.cells.where("period = 'cur'"), scope_filter(proj, prov)
        unscoped, provider_only, both = now, now.where(scope_filter(None, prov)), now.where(scope)
        before = cube.cells.where(F.expr("period = 'prev'") & scope)
        changes = Mt.change_table(cube.cells.where(scope))
        tries = cube.attempts.where(scope)
        health = H.provider_health_measures(tries, cur)
        table = H.provider_table(both, None, cur, health=H.provider_health_measures(tries, cur, sort=False))
        drift = D.price_drift_measures(both, drift_limit)
    else:
        unscoped = _measures(calls, rollup, cur, None, None)
        provider_only = _measures(calls, rollup, cur, None, prov)
        both = _measures(calls, rollup, cur, proj, prov)
        before = _measures(calls, rollup, prev, proj, prov)
        changes = (Mt.metrics_change(calls, window, as_of, proj, prov) if rollup is None
                   else change_from_rollup(calls, rollup, cur, prev, proj, prov))
        health = H.provider_health(rows, cur, sample_limit, measures=both if rollup is not None else None)
        table = H.provider_table(both, rows, cur, sample_limit)
        drift = D.price_drift(rows, drift_limit)

    out = {
        "projects": B.project_list(unscoped),
        "providers": B.provider_list(unscoped),
        "fleet": B.fleet(provider_only),
        "metrics": Mt.metrics(both),
        "metrics_prev": Mt.metrics(before),
        "stat_row": changes,
        "timeseries": Se.timeseries(spark, both, cur),
        "provider_stats": B.provider_stats(both),
        "provider_health": health,
        "provider_table": table,
        "model_stats": B.model_stats(both),
        "failover_events": E.failover_events(
            rows if rollup is None and cube is None else newest(rows, both, "failovers", E.EVENT_LIMIT)),
        "price_drift": drift,
    }
    out["stat_flags"] = Mt.stat_flags(out["metrics"])
    if proj is None:
        out["project_timeline"] = Se.project_timeline(provider_only, cur)
        out["project_table"] = B.project_table(provider_only, cur)
    return out


def is_empty(report: dict[str, DataFrame]) -> bool:
    """No calls in scope, an empty fleet and no projects.

    Three tiny actions on already-aggregated results.
    """
    return (report["metrics"].first()["calls"] == 0
            and report["fleet"].isEmpty()
            and report["projects"].isEmpty())
