"""edge cases of the dashboard semantics, one assertion per case."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import AS_OF, attempt, call, make_calls
from relaywatch.functions import status as S
from relaywatch.functions import windows as W
from relaywatch.functions.keys import attempt_provider
from relaywatch.operators import breakdowns as B
from relaywatch.operators import drift as D
from relaywatch.operators import events as E
from relaywatch.operators import health as H
from relaywatch.operators import metrics as Mt
from relaywatch.operators import partials as P
from relaywatch.operators import series as Se
from relaywatch.sources.calls import window_scan


def scan(calls, window="24h", **kw):
    return window_scan(calls, window, AS_OF, **kw)


def keys_of(spark, winner, model="m"):
    df = make_calls(spark, [call("a", winner=winner, model=model)])
    r = df.select("provider_key", "model_key").first()
    return r["provider_key"], r["model_key"]


def test_route_keys(spark):
    assert keys_of(spark, "x@", "m") == ("", "x")
    assert keys_of(spark, "@p", "m") == ("p", "")
    assert keys_of(spark, "a@b@c") == ("b", "a")
    assert keys_of(spark, "", "") == ("", "")
    assert keys_of(spark, None, "") == ("(failed)", "(failed)")
    assert keys_of(spark, "bare", "") == ("bare", "bare")
    assert keys_of(spark, "bare", "m") == ("bare", "m")
    got = spark.range(1).select(attempt_provider(F.lit("a@b@c")).alias("p"),
                                attempt_provider(F.lit(None).cast("string")).alias("q")).first()
    assert (got["p"], got["q"]) == ("c", "(unknown)")


def test_blank_provider_not_in_list(spark):
    calls = make_calls(spark, [call("a", winner="x@"), call("b", winner=None, ok=False), call("c")])
    sc, _ = scan(calls)
    names = [r["name"] for r in B.provider_list(P.row_measures(sc)).collect()]
    assert names == ["prov"]


def test_window_bounds(spark):
    day = dt.timedelta(days=1)
    calls = make_calls(spark, [
        call("at_start", ts=AS_OF - day), call("in", ts=AS_OF - day + dt.timedelta(microseconds=1)),
        call("at_prev_start", ts=AS_OF - 2 * day), call("at_end", ts=AS_OF),
        call("after", ts=AS_OF + dt.timedelta(seconds=1))])
    cur, _ = scan(calls)
    prev, _ = window_scan(calls, "24h", AS_OF, previous=True)
    assert sorted(r["id"] for r in cur.collect()) == ["at_end", "in"]
    assert [r["id"] for r in prev.collect()] == ["at_start"]


def test_bucket_floor_before_1970(spark):
    ts = dt.datetime(1969, 12, 31, 23, 59, 59, 500000, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(ts,)], "ts timestamp")
    assert df.select(W.bucket_floor(F.col("ts"), 300).alias("t")).first()["t"] == -300


def test_axis_is_inclusive(spark):
    for w, n in (("1h", 13), ("24h", 25), ("7d", 29), ("30d", 31)):
        rng = W.current(w, AS_OF)
        assert W.axis(spark, rng).count() == len(rng.axis_values())
    assert len(W.current("7d", AS_OF + dt.timedelta(hours=1)).axis_values()) == 29


def test_zero_rows_metrics(spark):
    calls = make_calls(spark, [call("old", ts=AS_OF - dt.timedelta(days=90))])
    sc, _ = scan(calls)
    r = Mt.metrics(P.row_measures(sc)).first()
    assert r["calls"] == 0 and r["cost_usd"] == 0.0 and r["avg_latency_ms"] == 0.0
    assert r["ttft_ms"] is None and r["save_pct"] == 0.0 and r["failover_rate"] == 0.0


def test_ttft_and_decode_rate(spark):
    calls = make_calls(spark, [
        call("a", model="m1", winner="m1@p"),
        call("b", model="m2", winner="m2@p", ttft_ms=100, latency_ms=100, output_tokens=50),
        call("c", model="m3", winner="m3@p", ttft_ms=100, latency_ms=600, output_tokens=50)])
    sc, _ = scan(calls)
    rows = {r["model"]: r for r in B.model_stats(P.row_measures(sc)).collect()}
    assert rows["m1"]["ttft_ms"] is None and rows["m1"]["tokens_per_sec"] is None
    assert rows["m2"]["ttft_ms"] == 100.0 and rows["m2"]["tokens_per_sec"] is None
    assert rows["m3"]["tokens_per_sec"] == pytest.approx(100.0)


def test_saving_clamped_per_row(spark):
    calls = make_calls(spark, [call("a", cost_usd="2", baseline_usd="1"),
                               call("b", cost_usd="1", baseline_usd="3"),
                               call("c", cost_usd="5", baseline_usd="0")])
    sc, _ = scan(calls)
    r = Mt.metrics(P.row_measures(sc)).first()
    assert r["saved_usd"] == 2.0 and r["cost_usd"] == 8.0
    assert r["save_pct"] == pytest.approx(2.0 / 4.0)


def test_health_attempt_rules(spark):
    calls = make_calls(spark, [
        call("a", attempts=[]),
        call("b", attempts=[attempt(None, False), attempt("m@q", None)]),
        call("c", winner=None, ok=False, failed_over=True,
             attempts=[attempt("m@dead", False, error="500"), attempt("m@dead", False)])])
    sc, rng = scan(calls)
    h = {r["provider"]: r for r in H.provider_health(sc, rng).collect()}
    assert h["(unknown)"]["attempts"] == 1 and h["(unknown)"]["fail_rate"] == 1.0
    assert h["q"]["attempts"] == 1 and h["q"]["fail_rate"] == 0.0
    assert h["dead"]["attempts"] == 2 and "down" in h["dead"]["buckets"]
    table = {r["provider"]: r for r in H.provider_table(P.row_measures(sc), sc, rng).collect()}
    assert table["dead"]["calls"] == 0 and table["dead"]["reliability"] == 0.0
    assert table["(failed)"]["attempts"] == 0 and table["(failed)"]["reliability"] is None
    ev = E.failover_events(sc).first()
    assert ev["reasons"] == "m@dead 500, m@dead error" and ev["outcome"] == "leaked"
    assert ev["served_by"] == "all failed"


def test_event_log_counts_missing_ok_as_failed(spark):
    calls = make_calls(spark, [call("a", failed_over=True, attempts=[attempt("x@p", None)])])
    sc, _ = scan(calls)
    assert E.failover_events(sc).first()["reasons"] == "x@p error"


def test_status_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1000, 5, 30), (1000, 6, 0), (1000, 0, 31), (0, 0, 0)],
                               "c long, f long, fo long")
    got = [r[0] for r in df.select(S.project_status(F.col("c"), F.col("f"), F.col("fo"))).collect()]
    assert got == ["ok", "down", "warn", "none"]
    df = spark.createDataFrame([(100, 2), (100, 15), (100, 1), (0, 0)], "a long, f long")
    got = [r[0] for r in df.select(S.attempt_status(F.col("a"), F.col("f"))).collect()]
    assert got == ["warn", "down", "ok", "none"]


def test_drift_threshold_and_rounding(spark):
    media = dict(modality="image", winner="img@p", model="img")
    calls = make_calls(spark, [
        call("a", cost_usd="1.2", est_cost_usd="1", **media),
        call("b", model="x", winner="x@p", cost_usd="3", est_cost_usd="1"),
        call("c", model="y", winner="y@p", cost_usd="1.0000001", est_cost_usd="1"),
        call("d", model="z", winner="z@p", cost_usd="1", est_cost_usd="1.5", ok=False)])
    sc, _ = scan(calls)
    rows = D.price_drift(sc).collect()
    assert [(r["model"], r["severity"]) for r in rows] == [("x", "bad")]


def test_change_direction(spark):
    df = spark.createDataFrame([(1.0, 0.0), (100.4, 100.0), (110.0, 100.0), (90.0, 100.0)],
                               "cur double, prev double")
    out = df.select(S.change(F.col("cur"), F.col("prev")).alias("c"),
                    S.direction(F.col("cur"), F.col("prev")).alias("d")).collect()
    assert out[0]["c"] is None and out[0]["d"] is None
    assert [r["d"] for r in out[1:]] == ["flat", "up", "down"]


def test_timeline_strip_and_summary(spark):
    t = AS_OF - dt.timedelta(minutes=30)
    calls = make_calls(spark, [call(f"a{i}", ts=t, project="p1") for i in range(10)]
                       + [call("leak", ts=t, project="p1", ok=False, winner=None)]
                       + [call("b", ts=AS_OF - dt.timedelta(hours=5), project="p2", failed_over=True)])
    sc, rng = scan(calls)
    tl = {r["project"]: r for r in Se.project_timeline(P.row_measures(sc), rng).collect()}
    assert len(tl["p1"]["buckets"]) == 25 and tl["p1"]["buckets"].count("down") == 1
    assert tl["p2"]["buckets"].count("warn") == 1 and tl["p1"]["calls"] == 11
    pt = {r["project"]: r for r in B.project_table(P.row_measures(sc), rng).collect()}
    assert pt["p1"]["status"] == "down" and pt["p1"]["strip_summary"] == "1 interval(s) leaked"
    assert pt["p2"]["status"] == "warn" and pt["p2"]["warn_buckets"] == 1


def test_media_failover_bare_providers(spark):
    calls = make_calls(spark, [call(
        "v", model="vid", winner="summit", modality="video", failed_over=True,
        media_usage={"seconds": 4.0, "outputs": 1.0, "megapixels": None}, cost_usd="0.4",
        attempts=[attempt("cheap", False, error="429"), attempt("summit", True)])])
    sc, rng = scan(calls)
    m = B.model_stats(P.row_measures(sc)).first()
    assert m["model"] == "vid" and m["unit_label"] == "/s" and m["unit_cost"] == pytest.approx(0.1)
    h = {r["provider"] for r in H.provider_health(sc, rng).collect()}
    assert h == {"cheap", "summit"}


def test_fleet_top_provider_tie_breaks_by_name(spark):
    calls = make_calls(spark, [call("a", winner="m@zeta"), call("b", winner="m@alpha")])
    sc, _ = scan(calls)
    f = B.fleet(P.row_measures(sc)).first()
    assert f["top_provider"] == "alpha" and f["top_provider_pct"] == 0.5
