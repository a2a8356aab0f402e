"""Named queries over a driver scale-factor directory, and their oracle SQL.

Each Spark query derives the ``calls`` table from the directory's ``events``
table (F1), anchors at the fixture instant ``AS_OF`` and runs one dashboard
operator over the whole window. The matching DuckDB statement lives in
:mod:`relaywatch.plans.oracle`. Column names agree one to one.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.functions import domains as Dom
from relaywatch.functions import windows as W
from relaywatch.operators import breakdowns as B
from relaywatch.operators import drift as D
from relaywatch.operators import events as E
from relaywatch.operators import health as H
from relaywatch.operators import metrics as Mt
from relaywatch.operators import partials as P
from relaywatch.operators import series as Se
from relaywatch.operators.recency import newest
from relaywatch.plans import ingest as I
from relaywatch.plans import oracle as O
from relaywatch.plans import report as Rep
from relaywatch.plans import rollup as R
from relaywatch.session import checkpoint_dir
from relaywatch.sources import commits, sink
from relaywatch.sources.calls import read_calls, scoped, window_scan
from relaywatch.sources.fixture import AS_OF, fixture_calls

WINDOWS = list(W.WINDOW_SECONDS)

# Scope used by the scoped metrics query: one project, one serving provider.
SCOPED_PROJECT = "borealis"
SCOPED_PROVIDER = "eastgate"

# The recency sample a dashboard panel may ask for; operators default to every call.
HEALTH_PANEL_SAMPLE = 8000

Query = Callable[[SparkSession, str], DataFrame]


def _scan(spark: SparkSession, sf_dir: str, window: str, project=None, provider=None):
    calls = fixture_calls(spark, sf_dir)
    return window_scan(calls, window, AS_OF, project, provider)


def _metrics(window, spark, sf_dir, project=None, provider=None):
    sc, _ = _scan(spark, sf_dir, window, project, provider)
    return Mt.metrics(P.row_measures(sc))


def _change(window, spark, sf_dir):
    return Mt.metrics_change(fixture_calls(spark, sf_dir), window, AS_OF)


def _measure_op(op, window, spark, sf_dir):
    sc, _ = _scan(spark, sf_dir, window)
    return op(P.row_measures(sc))


def _timeseries(window, spark, sf_dir):
    sc, rng = _scan(spark, sf_dir, window)
    return Se.timeseries(spark, P.row_measures(sc), rng)


def _timeline(window, spark, sf_dir):
    sc, rng = _scan(spark, sf_dir, window)
    return Se.project_timeline_long(P.row_measures(sc), rng)


def _project_table(window, spark, sf_dir):
    sc, rng = _scan(spark, sf_dir, window)
    return B.project_table(P.row_measures(sc), rng).drop("buckets")


def _drift(window, spark, sf_dir):
    sc, _ = _scan(spark, sf_dir, window)
    return D.price_drift(sc)


def _health(window, spark, sf_dir, sample=None):
    sc, rng = _scan(spark, sf_dir, window)
    return H.provider_health_long(sc, rng, sample)


def _provider_table(window, spark, sf_dir):
    sc, rng = _scan(spark, sf_dir, window)
    return H.provider_table(P.row_measures(sc), sc, rng).select(*H.PROVIDER_TABLE_COLUMNS)


def _events(window, spark, sf_dir):
    sc, _ = _scan(spark, sf_dir, window)
    # TIMESTAMP_NTZ under the UTC session: the same wall-clock value a
    # zone-less engine reports, independent of the reader's machine zone
    out = E.failover_events(sc).select(*E.EVENT_COLUMNS, "served_by")
    return out.withColumn("ts", out["ts"].cast("timestamp_ntz"))


# An instant off the 300 s grid, so both rollup edges hold partial buckets.
UNALIGNED_AS_OF = "2024-01-29 17:03:27"


def _rollup_measures(spark, sf_dir, window, as_of=AS_OF):
    """Measures for the window from the rollup plus raw edges.

    The rollup is aggregated from the same calls in the same job here; in
    production it is a stored table (:func:`relaywatch.plans.rollup.write`).
    """
    calls = fixture_calls(spark, sf_dir)
    rng = W.current(window, as_of)
    return R.measures(calls, R.build(calls), rng), rng


def _rollup_op(op, window, spark, sf_dir, as_of=AS_OF):
    m, rng = _rollup_measures(spark, sf_dir, window, as_of)
    if op is Se.timeseries:
        return op(spark, m, rng)
    if op is Se.project_timeline_long:
        return op(m, rng)
    return op(m)


def _rollup_drift(window, spark, sf_dir, as_of=AS_OF):
    m, _ = _rollup_measures(spark, sf_dir, window, as_of)
    return D.price_drift_measures(m)


def _attempt_measures(spark, sf_dir, window, as_of=AS_OF):
    """Attempt counts for the window from the attempts rollup plus raw edges."""
    calls = fixture_calls(spark, sf_dir)
    rng = W.current(window, as_of)
    return R.attempt_measures(calls, R.build_attempts(calls), rng), rng


def _rollup_health(window, spark, sf_dir, as_of=AS_OF):
    am, rng = _attempt_measures(spark, sf_dir, window, as_of)
    return H.long_form(H.provider_health_measures(am, rng, sort=False), rng)


def _rollup_provider_table(window, spark, sf_dir, as_of=AS_OF):
    m, rng = _rollup_measures(spark, sf_dir, window, as_of)
    am, _ = _attempt_measures(spark, sf_dir, window, as_of)
    health = H.provider_health_measures(am, rng, sort=False)
    return H.provider_table(m, None, rng, health=health).select(*H.PROVIDER_TABLE_COLUMNS)


def store_lagging(spark, sf_dir, root, attempts=False):
    """(calls, rollup) as stored below ``root``, the rollup behind the calls.

    The rollup is kept up to the day before ``AS_OF``; half of the calls of an
    earlier date and all calls after that day are stored later.
    """
    calls = fixture_calls(spark, sf_dir)
    day = W.to_utc(AS_OF).date()
    table, path = os.path.join(root, "calls"), os.path.join(root, "rollup")
    ahead = F.col("ts") >= F.lit(W.to_utc(AS_OF) - dt.timedelta(days=1))
    late = ~ahead & (F.col("ts_date") == F.lit(day - dt.timedelta(days=4))) & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    sink.write_batch(calls.where(~ahead & ~late), table, "0")
    R.refresh(spark, table, path, attempts)
    sink.write_batch(calls.where(ahead | late), table, "1")
    return read_calls(spark, table), R.read(spark, path)


def _stored_rollup(window, spark, sf_dir, attempts=False):
    root = os.path.join(checkpoint_dir(spark), "stored-rollup", uuid.uuid4().hex)
    calls, rollup = store_lagging(spark, sf_dir, root, attempts)
    rng = W.current(window, AS_OF)
    if attempts:
        health = H.provider_health_measures(R.attempt_measures(calls, rollup, rng), rng, sort=False)
        out = H.long_form(health, rng)
    else:
        out = Mt.metrics(R.measures(calls, rollup, rng))
    kept = out.checkpoint(eager=True)
    sink.drop_staging(spark, root)
    return kept


def store_committed(spark, sf_dir, root, attempts=False):
    """(calls, rollup) of a table of four commits below ``root``, the rollup kept by deltas and behind by one.

    Most calls, then half of an earlier date (late), then the last day, then a re-run of
    the late batch that replaces it. The rollup adds the first three, one at a time, and folds its oldest deltas.
    """
    calls = fixture_calls(spark, sf_dir)
    day = W.to_utc(AS_OF).date()
    table, path = os.path.join(root, "calls"), os.path.join(root, "rollup")
    ahead = F.col("ts") >= F.lit(W.to_utc(AS_OF) - dt.timedelta(days=1))
    late = ~ahead & (F.col("ts_date") == F.lit(day - dt.timedelta(days=4))) & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    for batch, rows in (("most", ~ahead & ~late), ("late", late), ("ahead", ahead)):
        commits.commit_batch(spark, calls.where(rows), table, batch)
        R.add_deltas(spark, table, path, attempts)
    R.merge_deltas(spark, path, [(day - dt.timedelta(days=k)).isoformat() for k in (3, 4, 5)])
    commits.commit_batch(spark, calls.where(late), table, "late")
    return read_calls(spark, table), R.read(spark, path)


def _kept(spark, name, make):
    """``make(root)`` over tables written below the checkpoint folder, which are removed afterwards."""
    root = os.path.join(checkpoint_dir(spark), name, uuid.uuid4().hex)
    try:
        return make(root).checkpoint(eager=True)
    finally:
        sink.drop_staging(spark, root)


def _delta_rollup(op, window, spark, sf_dir):
    def make(root):
        calls, rollup = store_committed(spark, sf_dir, root, attempts=op is None)
        rng = W.current(window, AS_OF)
        if op is None:
            health = H.provider_health_measures(R.attempt_measures(calls, rollup, rng), rng, sort=False)
            return H.long_form(health, rng)
        return op(R.measures(calls, rollup, rng))
    return _kept(spark, "delta-rollup", make)


def store_tiered(spark, sf_dir, root, attempts=False):
    """(calls, rollup) of a table in two commits: all dates but the last two folded to tiers, the last day added after."""
    calls = fixture_calls(spark, sf_dir)
    table, path = os.path.join(root, "calls"), os.path.join(root, "rollup")
    ahead = F.col("ts") >= F.lit(W.to_utc(AS_OF) - dt.timedelta(days=1))
    commits.commit_batch(spark, calls.where(~ahead), table, "most")
    R.add_deltas(spark, table, path, attempts)
    R.merge_deltas(spark, path, sorted({f["date"] for f in commits.current(spark, table)["folders"]})[:-1])
    commits.commit_batch(spark, calls.where(ahead), table, "ahead")
    R.add_deltas(spark, table, path, attempts)
    return read_calls(spark, table), R.read(spark, path)


def _tiers(op, window, spark, sf_dir, as_of=AS_OF):
    """Panels over the hour and day tiers of a stored rollup."""
    def make(root):
        calls, rollup = store_tiered(spark, sf_dir, root, attempts=op is None)
        rng = W.current(window, as_of)
        if op is None:
            health = H.provider_health_measures(R.attempt_measures(calls, rollup, rng), rng, sort=False)
            return H.long_form(health, rng)
        m = R.measures(calls, rollup, rng)
        return op(spark, m, rng) if op is Se.timeseries else op(m)
    return _kept(spark, "tiers", make)


def _compacted(window, spark, sf_dir):
    """A1 over a table of many small batches whose dates were compacted but for the last."""
    def make(root):
        calls, table = fixture_calls(spark, sf_dir), os.path.join(root, "calls")
        for k in range(4):
            commits.commit_batch(spark, calls.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k), table, f"batch {k}")
        dates = sorted({f["date"] for f in commits.current(spark, table)["folders"]})
        commits.compact(spark, table, dates[:-1])
        return Mt.metrics(P.row_measures(scoped(read_calls(spark, table), W.current(window, AS_OF))))
    return _kept(spark, "compacted", make)


def _newest(panel, window, spark, sf_dir, **scope):
    """O5 and O6 over a stored table, the span to scan found in the counts of its rollup."""
    def make(root):
        calls, rollup = store_committed(spark, sf_dir, root)
        rng = W.current(window, AS_OF)
        sc, m = scoped(calls, rng, **scope), R.measures(calls, rollup, rng, **scope)
        if panel == "health":
            return H.long_form(H.provider_health(sc, rng, HEALTH_PANEL_SAMPLE, sort=False, measures=m), rng)
        out = E.failover_events(newest(sc, m, "failovers", E.EVENT_LIMIT)).select(*E.EVENT_COLUMNS, "served_by")
        return out.withColumn("ts", out["ts"].cast("timestamp_ntz"))
    return _kept(spark, "newest", make)


def _ingest_against_stored(spark, sf_dir):
    """Half of the calls are stored when the whole feed, with resends and junk, arrives."""
    def make(root):
        table = os.path.join(root, "calls")
        half = fixture_calls(spark, sf_dir).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
        commits.commit_batch(spark, half, table, "stored")
        I.ingest_lines(spark, I.fixture_feed(spark, sf_dir), table, os.path.join(root, "quarantine"), "feed",
                       order=["_seq"], explicit_ts=True)
        return I.flat(read_calls(spark, table))
    return _kept(spark, "against-stored", make)


OVERVIEW_PANELS = ["projects", "providers", "fleet", "metrics", "stat_row", "timeseries", "provider_stats", "provider_health",
                   "provider_table", "model_stats", "price_drift", "project_table"]
DRILLDOWN_PANELS = ["metrics", "timeseries", "provider_stats", "provider_health", "provider_table", "model_stats", "price_drift"]


def _page(panel, spark, sf_dir, **scope):
    """One panel of a page whose two staged aggregates every panel shares."""
    def make(root):
        calls, rng = fixture_calls(spark, sf_dir), W.current("7d", AS_OF)
        cube = Rep.stage(spark, calls, "7d", AS_OF, root)
        out = Rep.overview(spark, calls, "7d", AS_OF, cube=cube, **scope)[panel]
        if panel == "provider_health":
            return H.long_form(out, rng)
        if panel == "provider_table":
            return out.select(*H.PROVIDER_TABLE_COLUMNS)
        return out.drop("buckets")
    return _kept(spark, "page", make)


def _project_domains(window, spark, sf_dir):
    sc, _ = _scan(spark, sf_dir, window)
    fleet = B.fleet(P.row_measures(sc)).select("project", "calls")
    return Dom.project_domains(fleet)


def _provider_domains(window, spark, sf_dir):
    sc, _ = _scan(spark, sf_dir, window)
    stats = B.provider_stats(P.row_measures(sc)).select("provider", "calls")
    return Dom.provider_domains(stats)


def _stat_flags(window, spark, sf_dir):
    sc, _ = _scan(spark, sf_dir, window)
    return Mt.stat_flags(Mt.metrics(P.row_measures(sc))).select(
        "calls", "failovers", "caught", "failures", "caught_share", "caught_good",
        "failover_tone", "leaked_tone", "save_tone")


def _rollup_change(window, spark, sf_dir, as_of=AS_OF):
    from relaywatch.plans.report import change_from_rollup

    calls = fixture_calls(spark, sf_dir)
    return change_from_rollup(calls, R.build(calls), W.current(window, as_of), W.previous(window, as_of),
                              None, None)


def spark_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for w in WINDOWS:
        q[f"metrics_{w}"] = partial(_metrics, w)
    q["metrics_scoped"] = partial(_metrics, "7d", project=SCOPED_PROJECT, provider=SCOPED_PROVIDER)
    q["metrics_change_7d"] = partial(_change, "7d")
    for w in WINDOWS:
        q[f"projects_{w}"] = partial(_measure_op, B.project_list, w)
        q[f"providers_{w}"] = partial(_measure_op, B.provider_list, w)
        q[f"timeseries_{w}"] = partial(_timeseries, w)
        q[f"project_timeline_{w}"] = partial(_timeline, w)
        q[f"fleet_{w}"] = partial(_measure_op, B.fleet, w)
        q[f"provider_stats_{w}"] = partial(_measure_op, B.provider_stats, w)
        q[f"model_stats_{w}"] = partial(_measure_op, B.model_stats, w)
        q[f"price_drift_{w}"] = partial(_drift, w)
        q[f"provider_health_{w}"] = partial(_health, w)
        q[f"provider_health_full_{w}"] = partial(_health, w)
        q[f"provider_health_sample_{w}"] = partial(_health, w, sample=HEALTH_PANEL_SAMPLE)
    q["project_table_7d"] = partial(_project_table, "7d")
    q["provider_table_7d"] = partial(_provider_table, "7d")
    q["failover_events_7d"] = partial(_events, "7d")
    q["rollup_metrics_7d"] = partial(_rollup_op, Mt.metrics, "7d")
    q["rollup_metrics_30d"] = partial(_rollup_op, Mt.metrics, "30d")
    q["rollup_metrics_24h_unaligned"] = partial(_rollup_op, Mt.metrics, "24h", as_of=UNALIGNED_AS_OF)
    q["rollup_timeseries_30d"] = partial(_rollup_op, Se.timeseries, "30d")
    q["rollup_project_timeline_24h"] = partial(_rollup_op, Se.project_timeline_long, "24h")
    q["rollup_fleet_7d"] = partial(_rollup_op, B.fleet, "7d")
    q["rollup_provider_stats_30d"] = partial(_rollup_op, B.provider_stats, "30d")
    q["rollup_model_stats_7d"] = partial(_rollup_op, B.model_stats, "7d")
    q["rollup_model_stats_24h_unaligned"] = partial(_rollup_op, B.model_stats, "24h",
                                                    as_of=UNALIGNED_AS_OF)
    q["rollup_metrics_change_7d"] = partial(_rollup_change, "7d")
    q["rollup_price_drift_7d"] = partial(_rollup_drift, "7d")
    q["rollup_price_drift_30d"] = partial(_rollup_drift, "30d")
    q["rollup_price_drift_24h_unaligned"] = partial(_rollup_drift, "24h", as_of=UNALIGNED_AS_OF)
    q["rollup_provider_health_full_7d"] = partial(_rollup_health, "7d")
    q["rollup_provider_health_full_30d"] = partial(_rollup_health, "30d")
    q["rollup_provider_health_full_24h_unaligned"] = partial(_rollup_health, "24h",
                                                             as_of=UNALIGNED_AS_OF)
    q["rollup_provider_table_full_7d"] = partial(_rollup_provider_table, "7d")
    q["rollup_stored_metrics_7d"] = partial(_stored_rollup, "7d")
    q["rollup_stored_provider_health_7d"] = partial(_stored_rollup, "7d", attempts=True)
    q["rollup_deltas_metrics_7d"] = partial(_delta_rollup, Mt.metrics, "7d")
    q["rollup_deltas_model_stats_7d"] = partial(_delta_rollup, B.model_stats, "7d")
    q["rollup_deltas_provider_health_7d"] = partial(_delta_rollup, None, "7d")
    q["rollup_tiers_metrics_30d"] = partial(_tiers, Mt.metrics, "30d")
    q["rollup_tiers_timeseries_30d"] = partial(_tiers, Se.timeseries, "30d")
    q["rollup_tiers_timeseries_7d"] = partial(_tiers, Se.timeseries, "7d")
    q["rollup_tiers_provider_health_30d"] = partial(_tiers, None, "30d")
    q["rollup_tiers_model_stats_24h_unaligned"] = partial(_tiers, B.model_stats, "24h", as_of=UNALIGNED_AS_OF)
    for w in ("7d", "30d"):
        q[f"newest_failover_events_{w}"] = partial(_newest, "events", w)
    q["newest_failover_events_scoped_30d"] = partial(_newest, "events", "30d", project=SCOPED_PROJECT)
    q["newest_provider_health_sample_30d"] = partial(_newest, "health", "30d")
    q["compacted_metrics_7d"] = partial(_compacted, "7d")
    q["ingest_against_stored"] = _ingest_against_stored
    for panel in OVERVIEW_PANELS:
        q[f"overview_{panel}_7d"] = partial(_page, panel)
    for panel in DRILLDOWN_PANELS:
        q[f"drilldown_{panel}_7d"] = partial(_page, panel, project=SCOPED_PROJECT, provider=SCOPED_PROVIDER)
    q["project_domains_7d"] = partial(_project_domains, "7d")
    q["provider_domains_7d"] = partial(_provider_domains, "7d")
    q["stat_flags_7d"] = partial(_stat_flags, "7d")
    q["ingest_dedupe"] = I.fixture_ingest
    q["ingest_quarantine"] = I.fixture_quarantine
    return q


def _page_sql(panel: str, **scope) -> str:
    return getattr(O, "metrics_change" if panel == "stat_row" else panel)("7d", **scope)


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    for w in WINDOWS:
        o[f"metrics_{w}"] = O.metrics(w)
    o["metrics_scoped"] = O.metrics("7d", project=SCOPED_PROJECT, provider=SCOPED_PROVIDER)
    o["metrics_change_7d"] = O.metrics_change("7d")
    for w in WINDOWS:
        o[f"projects_{w}"] = O.projects(w)
        o[f"providers_{w}"] = O.providers(w)
        o[f"timeseries_{w}"] = O.timeseries(w)
        o[f"project_timeline_{w}"] = O.project_timeline(w)
        o[f"fleet_{w}"] = O.fleet(w)
        o[f"provider_stats_{w}"] = O.provider_stats(w)
        o[f"model_stats_{w}"] = O.model_stats(w)
        o[f"price_drift_{w}"] = O.price_drift(w)
        o[f"provider_health_{w}"] = O.provider_health(w)
        o[f"provider_health_full_{w}"] = O.provider_health(w)
        o[f"provider_health_sample_{w}"] = O.provider_health(w, sample=HEALTH_PANEL_SAMPLE)
    o["project_table_7d"] = O.project_table("7d")
    o["provider_table_7d"] = O.provider_table("7d")
    o["failover_events_7d"] = O.failover_events("7d")
    o["rollup_metrics_7d"] = O.metrics("7d")
    o["rollup_metrics_30d"] = O.metrics("30d")
    o["rollup_metrics_24h_unaligned"] = O.metrics("24h", as_of=UNALIGNED_AS_OF)
    o["rollup_timeseries_30d"] = O.timeseries("30d")
    o["rollup_project_timeline_24h"] = O.project_timeline("24h")
    o["rollup_fleet_7d"] = O.fleet("7d")
    o["rollup_provider_stats_30d"] = O.provider_stats("30d")
    o["rollup_model_stats_7d"] = O.model_stats("7d")
    o["rollup_model_stats_24h_unaligned"] = O.model_stats("24h", as_of=UNALIGNED_AS_OF)
    o["rollup_metrics_change_7d"] = O.metrics_change("7d")
    o["rollup_price_drift_7d"] = O.price_drift("7d")
    o["rollup_price_drift_30d"] = O.price_drift("30d")
    o["rollup_price_drift_24h_unaligned"] = O.price_drift("24h", as_of=UNALIGNED_AS_OF)
    o["rollup_provider_health_full_7d"] = O.provider_health("7d", sample=None)
    o["rollup_provider_health_full_30d"] = O.provider_health("30d", sample=None)
    o["rollup_provider_health_full_24h_unaligned"] = O.provider_health("24h", as_of=UNALIGNED_AS_OF,
                                                                       sample=None)
    o["rollup_provider_table_full_7d"] = O.provider_table("7d", sample=None)
    o["rollup_stored_metrics_7d"] = O.metrics("7d")
    o["rollup_stored_provider_health_7d"] = O.provider_health("7d", sample=None)
    o["rollup_deltas_metrics_7d"] = O.metrics("7d")
    o["rollup_deltas_model_stats_7d"] = O.model_stats("7d")
    o["rollup_deltas_provider_health_7d"] = O.provider_health("7d", sample=None)
    o["rollup_tiers_metrics_30d"] = O.metrics("30d")
    o["rollup_tiers_timeseries_30d"] = O.timeseries("30d")
    o["rollup_tiers_timeseries_7d"] = O.timeseries("7d")
    o["rollup_tiers_provider_health_30d"] = O.provider_health("30d", sample=None)
    o["rollup_tiers_model_stats_24h_unaligned"] = O.model_stats("24h", as_of=UNALIGNED_AS_OF)
    for w in ("7d", "30d"):
        o[f"newest_failover_events_{w}"] = O.failover_events(w)
    o["newest_failover_events_scoped_30d"] = O.failover_events("30d", project=SCOPED_PROJECT)
    o["newest_provider_health_sample_30d"] = O.provider_health("30d", sample=HEALTH_PANEL_SAMPLE)
    o["compacted_metrics_7d"] = O.metrics("7d")
    o["ingest_against_stored"] = O.stored_calls()
    for panel in OVERVIEW_PANELS:
        o[f"overview_{panel}_7d"] = _page_sql(panel)
    for panel in DRILLDOWN_PANELS:
        o[f"drilldown_{panel}_7d"] = _page_sql(panel, project=SCOPED_PROJECT, provider=SCOPED_PROVIDER)
    o["project_domains_7d"] = O.project_domains("7d")
    o["provider_domains_7d"] = O.provider_domains("7d")
    o["stat_flags_7d"] = O.stat_flags("7d")
    o["ingest_dedupe"] = O.stored_calls()
    o["ingest_quarantine"] = O.ingest_rejects()
    return o
