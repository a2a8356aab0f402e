"""Plan checks: pruning and pushdown reach the scan, nothing runs in Python."""

from __future__ import annotations

from conftest import SF_SMALL
from relaywatch.operators import breakdowns as B
from relaywatch.operators import health as H
from relaywatch.operators import metrics as Mt
from relaywatch.operators import partials as P
from relaywatch.plans import rollup as R
from relaywatch.sources.calls import read_calls, window_scan
from relaywatch.sources.fixture import AS_OF, fixture_calls


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, scratch):
    path = f"{scratch}/calls"
    fixture_calls(spark, SF_SMALL).write.partitionBy("ts_date").parquet(path)
    return read_calls(spark, path)


def test_scan_prunes_dates_and_pushes_scope(spark, scratch):
    calls = stored(spark, scratch)
    sc, _ = window_scan(calls, "7d", AS_OF, project="atlas", provider="eastgate")
    p = plan(Mt.metrics(P.row_measures(sc)))
    assert "PartitionFilters: [isnotnull(ts_date" in p and "ts_date#" in p
    assert "PushedFilters:" in p and "EqualTo(provider_key,eastgate)" in p
    assert "EqualTo(project,atlas)" in p and "GreaterThan(ts," in p


def test_scan_reads_only_needed_columns(spark, scratch):
    calls = stored(spark, scratch)
    sc, _ = window_scan(calls, "30d", AS_OF)
    p = plan(B.provider_list(P.row_measures(sc)))
    read_schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "attempts" not in read_schema and "media_usage" not in read_schema
    assert "provider_key" in read_schema


def test_no_python_in_any_registered_query(spark):
    import __spark_entry__ as entry
    from relaywatch.plans import catalog

    # the other windows differ from the 7d plans only in literals
    # the training-data operators may run Python; the dashboard's own queries may not
    # pages end in a checkpoint, which hides their plan; their panels' plans are those checked here
    names = [n for n in catalog.spark_queries() if not any(w in n for w in ("_1h", "_24h", "_30d", "overview_", "drilldown_"))]
    for name in names:
        p = plan(entry.queries()[name](spark, SF_SMALL))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
            assert node not in p, (name, node)
    assert len(names) >= 15


def test_aggregates_are_partial_then_final(spark, scratch):
    calls = stored(spark, scratch)
    sc, rng = window_scan(calls, "7d", AS_OF)
    p = plan(B.fleet(P.row_measures(sc)))
    assert "partial_sum" in p
    rollup = R.build(calls)
    p = plan(Mt.metrics(R.measures(calls, rollup, rng)))
    assert "Union" in p


def test_health_sample_reads_attempts_only_for_the_sampled_span(spark, scratch):
    import re

    calls = stored(spark, scratch)
    sc, rng = window_scan(calls, "30d", AS_OF)
    p = plan(H.recent_sample(sc, 200))
    bounds = re.findall(r"ts_date#\d+ >= (\d{4}-\d\d-\d\d)", p)
    assert max(bounds) > "2024-01-20"          # pruned far inside the 30-day window
    assert sc.count() > H.recent_sample(sc, 200).count() == 200


def test_shares_take_one_scan(spark, scratch):
    calls = stored(spark, scratch)
    sc, rng = window_scan(calls, "7d", AS_OF)
    for out, scans in ((B.provider_stats(P.row_measures(sc)), 1), (B.model_stats(P.row_measures(sc)), 1),
                       (H.provider_table(P.row_measures(sc), sc, rng), 2)):      # the calls, and their attempts
        p = plan(out)
        assert p.count("FileScan parquet") == scans and "NestedLoopJoin" not in p
