"""Rollup-backed drift and full-window health equal the raw plans exactly."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF_SMALL, utc
from helpers import attempt, call, make_calls

from relaywatch.functions import windows as W
from relaywatch.operators import drift as D
from relaywatch.operators import health as H
from relaywatch.plans import rollup as R
from relaywatch.sources.calls import window_scan
from relaywatch.sources.fixture import AS_OF, fixture_calls

INSTANTS = [AS_OF, "2024-01-29 17:03:27", "2024-01-20 00:00:00"]
SCOPES = [(None, None), ("borealis", None), (None, "eastgate"), ("atlas", "summit")]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def fixture(spark):
    calls = fixture_calls(spark, SF_SMALL).cache()
    return calls, R.build(calls).cache(), R.build_attempts(calls).cache()


@pytest.mark.parametrize("window", ["1h", "24h", "7d", "30d"])
def test_rollup_drift_equals_raw(spark, fixture, window):
    calls, rollup, _ = fixture
    for as_of in INSTANTS:
        for project, provider in SCOPES:
            sc, rng = window_scan(calls, window, as_of, project, provider)
            raw = D.price_drift(sc, limit=None)
            rolled = D.price_drift_measures(R.measures(calls, rollup, rng, project, provider), limit=None)
            assert _rows(rolled) == _rows(raw), (window, as_of, project, provider)


@pytest.mark.parametrize("window", ["24h", "7d", "30d"])
def test_rollup_health_equals_raw(spark, fixture, window):
    calls, _, attempts = fixture
    for as_of in INSTANTS:
        for project, provider in SCOPES:
            sc, rng = window_scan(calls, window, as_of, project, provider)
            raw = H.provider_health(sc, rng, None, sort=False)
            am = R.attempt_measures(calls, attempts, rng, project, provider)
            rolled = H.provider_health_measures(am, rng, sort=False)
            assert _rows(rolled) == _rows(raw), (window, as_of, project, provider)


def test_attempt_rollup_edges_and_fail_rule(spark):
    as_of = utc(2024, 1, 30, 23, 30)
    start = as_of - dt.timedelta(hours=1)
    rows = [
        # exactly on the excluded lower bound, just inside it, on a bucket start
        call("a", ts=start, attempts=[attempt("x@p1", False)]),
        call("b", ts=start + dt.timedelta(seconds=1), attempts=[attempt("x@p1", False)]),
        call("c", ts=utc(2024, 1, 30, 23, 0), attempts=[attempt("x@p1", None), attempt("p2", True)]),
        # exactly at as_of (included) and after it (excluded)
        call("d", ts=as_of, attempts=[attempt("m@eu@p3", False)]),
        call("e", ts=as_of + dt.timedelta(seconds=1), attempts=[attempt("p3", False)]),
    ]
    calls = make_calls(spark, rows)
    rng = W.current("1h", as_of)
    sc, _ = window_scan(calls, "1h", as_of)
    raw = _rows(H.provider_health(sc, rng, None, sort=False))
    rolled = _rows(H.provider_health_measures(
        R.attempt_measures(calls, R.build_attempts(calls), rng), rng, sort=False))
    assert rolled == raw
    totals = {r[0]: (r[1], r[2]) for r in rolled}
    # p1: b fails, c's attempt has no ok (not a fail); a lies outside the window
    assert totals == {"p1": (2, 0.5), "p2": (1, 0.0), "p3": (1, 1.0)}
