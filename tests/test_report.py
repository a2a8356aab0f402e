"""C1-C3 reports and cross-panel properties on the fixture."""

from __future__ import annotations

import datetime as dt

from conftest import SF_SMALL
from relaywatch.plans import report
from relaywatch.plans import rollup as R
from relaywatch.sources.fixture import AS_OF, fixture_calls


def test_overview_panels_agree(spark):
    calls = fixture_calls(spark, SF_SMALL)
    rep = report.overview(spark, calls, "30d", AS_OF)
    m = rep["metrics"].first()
    assert {"project_timeline", "project_table", "provider_table", "stat_row"} <= set(rep)
    # the breakdowns partition the calls of the metrics row
    assert sum(r["calls"] for r in rep["provider_stats"].collect()) == m["calls"]
    assert sum(r["calls"] for r in rep["model_stats"].collect()) == m["calls"]
    assert sum(r["calls"] for r in rep["timeseries"].collect()) == m["calls"]
    assert sum(r["n"] for r in rep["projects"].collect()) == m["calls"]
    assert m["caught"] + (m["failures"] - 0) >= m["failovers"] >= m["caught"]
    assert not report.is_empty(rep)


def test_drilldown_and_rollup_give_the_same_panels(spark):
    calls = fixture_calls(spark, SF_SMALL)
    rollup = R.build(calls)
    raw = report.overview(spark, calls, "7d", AS_OF, project="cobalt", provider="eastgate")
    via = report.overview(spark, calls, "7d", AS_OF, project="cobalt", provider="eastgate", rollup=rollup)
    assert "project_timeline" not in raw
    for panel in ("metrics", "timeseries", "provider_stats", "model_stats", "fleet", "projects"):
        assert sorted(raw[panel].collect()) == sorted(via[panel].collect()), panel


def test_empty_scope(spark):
    calls = fixture_calls(spark, SF_SMALL)
    rep = report.overview(spark, calls, "1h", dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc))
    assert report.is_empty(rep)


def test_stat_row_from_rollup_equals_raw(spark):
    calls = fixture_calls(spark, SF_SMALL)
    rollup = R.build(calls)
    for as_of in (AS_OF, "2024-01-21 09:17:33"):
        raw = report.overview(spark, calls, "24h", as_of)["stat_row"]
        via = report.overview(spark, calls, "24h", as_of, rollup=rollup)["stat_row"]
        assert sorted(raw.collect()) == sorted(via.collect()), as_of


def _same(a, b, panels):
    for panel in panels:
        order = lambda df: sorted(map(str, df.collect()))
        assert order(a[panel]) == order(b[panel]), panel


def test_panels_of_a_staged_page_equal_those_read_alone(spark, scratch):
    calls = fixture_calls(spark, SF_SMALL)
    cubes = [report.stage(spark, calls, "24h", AS_OF, f"{scratch}/raw"),
             report.stage(spark, calls, "24h", AS_OF, f"{scratch}/rolled", R.build(calls), R.build_attempts(calls))]
    for scope in ({}, {"project": "cobalt", "provider": "eastgate"}, {"provider": "summit"}):
        alone = report.overview(spark, calls, "24h", AS_OF, **scope)
        for cube in cubes:
            page = report.overview(spark, calls, "24h", AS_OF, cube=cube, **scope)
            assert set(page) == set(alone)
            _same(page, alone, page)


def test_a_staged_page_reads_the_calls_once_and_keeps_row_order(spark, scratch):
    import re

    calls = fixture_calls(spark, SF_SMALL)
    page = report.overview(spark, calls, "7d", AS_OF, cube=report.stage(spark, calls, "7d", AS_OF, scratch))
    for panel, df in page.items():
        read = re.findall(r"InMemoryFileIndex[^\n]*?/(cells|attempts|events\.parquet)", df._jdf.queryExecution().executedPlan().toString())
        assert panel == "failover_events" or set(read) <= {"cells", "attempts"}, panel
    # Each panel's order, ties by name
    key = {"projects": lambda r: (-r["n"], r["name"]), "providers": lambda r: (-r["n"], r["name"]),
           "fleet": lambda r: (-r["calls"], r["project"]), "project_table": lambda r: (-r["calls"], r["project"]),
           "project_timeline": lambda r: (-r["calls"], r["project"]), "timeseries": lambda r: r["t"],
           "provider_stats": lambda r: (-r["calls"], r["provider"]), "provider_table": lambda r: (-r["calls"], r["provider"]),
           "provider_health": lambda r: (-r["attempts"], r["provider"]),
           "model_stats": lambda r: (-r["spent_usd"], -r["calls"], r["model"]),
           "price_drift": lambda r: (-abs(r["ratio"] - 1), r["model"], r["provider"])}
    for panel, by in key.items():
        rows = page[panel].collect()
        assert rows == sorted(rows, key=by) and rows, panel
    events = [(r["ts"], r["id"]) for r in page["failover_events"].collect()]
    assert events == sorted(events, reverse=True)
