"""Benchmark: load, roll up and query the calls table at one scale factor.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1) and prints
one JSON line. Steps:

* ``load_calls``   derive the calls from ``events`` and write the partitioned
                   table (the bulk-load path: key columns, date partitions,
                   rows sorted by project and time inside files);
* ``ingest_json``  the JSON-lines file ingest of the same records with resends
                   and junk lines (parse, quarantine, dedupe, anti join, append);
                   the feed files are written beforehand, untimed;
* ``build_rollup`` the 300 s rollup from the stored table;
* ``build_attempts_rollup`` the 300 s attempts rollup (provider health);
* one timing per dashboard query over the stored table (the 7d and 30d
  windows), and the rollup-backed reads of the aggregate panels, price
  drift, full-window provider health and the merged provider table.

Each query is run once to warm up, then timed ``$BENCH_REPEAT`` times
(default 3); the median is reported. ``value`` is the sum of the medians of
the ``HEADLINE`` queries (one dashboard refresh for both windows; the same
set in every round, so rounds compare); ``value_all`` sums every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from relaywatch.functions import windows as W  # noqa: E402
from relaywatch.operators import breakdowns as B  # noqa: E402
from relaywatch.operators import drift as D  # noqa: E402
from relaywatch.operators import events as E  # noqa: E402
from relaywatch.operators import health as H  # noqa: E402
from relaywatch.operators import metrics as Mt  # noqa: E402
from relaywatch.operators import partials as P  # noqa: E402
from relaywatch.operators import series as Se  # noqa: E402
from relaywatch.plans import ingest as I  # noqa: E402
from relaywatch.plans import rollup as R  # noqa: E402
from relaywatch.session import build_session, checkpoint_dir  # noqa: E402
from relaywatch.sources import sink  # noqa: E402
from relaywatch.sources.calls import read_calls, window_scan  # noqa: E402
from relaywatch.sources.fixture import AS_OF, fixture_calls, record_lines  # noqa: E402


HEADLINE = [f"{q}_{w}" for w in ("7d", "30d") for q in (
    "metrics", "metrics_change", "timeseries", "project_table", "provider_table", "model_stats",
    "price_drift", "failover_events", "provider_health_full", "rollup_metrics", "rollup_fleet",
    "rollup_model_stats", "rollup_timeseries")]


def timed(fn, repeat: int = 1, warm: bool = False) -> float:
    if warm:
        fn()
    runs = []
    for _ in range(repeat):
        t = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t)
    return round(statistics.median(runs), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), app_name="relaywatch-bench")
    work = os.path.join(checkpoint_dir(spark), "bench")
    table, rollup_path, attempts_path = f"{work}/calls", f"{work}/rollup", f"{work}/attempts"
    steps: dict[str, float] = {}
    # untimed warm-up: JVM start, class loading, first code generation
    fixture_calls(spark, sf_dir).where("ok").count()

    steps["load_calls"] = timed(lambda: sink.write_batch(fixture_calls(spark, sf_dir), table, "bulk-0"))
    # untimed setup: the JSON-lines feed lands as files (8 of them, in arrival order)
    feed = f"{work}/feed"
    record_lines(fixture_calls(spark, sf_dir)).repartitionByRange(8, "_seq") \
        .sortWithinPartitions("_seq").select("value").write.mode("overwrite").text(feed)
    steps["ingest_json"] = timed(lambda: I.ingest_files(
        spark, feed, f"{work}/ingested", f"{work}/quarantine", "bench-0", explicit_ts=True))
    calls = read_calls(spark, table)
    steps["build_rollup"] = timed(lambda: R.write(R.build(calls), rollup_path))
    steps["build_attempts_rollup"] = timed(
        lambda: R.write_attempts(R.build_attempts(calls), attempts_path))
    rollup = R.read(spark, rollup_path)
    attempts = R.read(spark, attempts_path)

    def q(window: str):
        sc, rng = window_scan(calls, window, AS_OF)
        m = P.row_measures(sc)
        rm = R.measures(calls, rollup, rng)
        am = R.attempt_measures(calls, attempts, rng)
        return {
            f"metrics_{window}": lambda: Mt.metrics(m).collect(),
            f"metrics_change_{window}": lambda: Mt.metrics_change(calls, window, AS_OF).collect(),
            f"timeseries_{window}": lambda: Se.timeseries(spark, m, rng).collect(),
            f"project_table_{window}": lambda: B.project_table(m, rng).collect(),
            f"provider_table_{window}": lambda: H.provider_table(m, sc, rng).collect(),
            f"model_stats_{window}": lambda: B.model_stats(m).collect(),
            f"price_drift_{window}": lambda: D.price_drift(sc).collect(),
            f"failover_events_{window}": lambda: E.failover_events(sc).collect(),
            f"provider_health_full_{window}": lambda: H.provider_health(sc, rng, None).collect(),
            f"rollup_metrics_{window}": lambda: Mt.metrics(rm).collect(),
            f"rollup_fleet_{window}": lambda: B.fleet(rm).collect(),
            f"rollup_model_stats_{window}": lambda: B.model_stats(rm).collect(),
            f"rollup_timeseries_{window}": lambda: Se.timeseries(spark, rm, rng).collect(),
            f"rollup_price_drift_{window}": lambda: D.price_drift_measures(rm).collect(),
            f"rollup_provider_health_full_{window}": lambda: H.provider_health_measures(am, rng).collect(),
            f"rollup_provider_table_full_{window}": lambda: H.provider_table(
                rm, None, rng, health=H.provider_health_measures(am, rng, sort=False)).collect(),
        }

    queries: dict[str, float] = {}
    for window in ("7d", "30d"):
        for name, fn in q(window).items():
            queries[name] = timed(fn, repeat=repeat, warm=True)

    total = round(sum(queries[n] for n in HEADLINE), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "dashboard_refresh_sec", "value": total, "unit": "sec",
        "value_all": round(sum(queries.values()), 4),
        "queries": {**queries, **steps}, "sf": sf,
        "rows": {"calls": calls.count(), "rollup": rollup.count(), "attempts_rollup": attempts.count()},
        "config": {"master": f"local[{cpus}]", "shuffle_partitions": int(cpus),
                   "spark": spark.version, "repeat": repeat},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
