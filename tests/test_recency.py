"""Newest rows found by counts: same rows as a plain top-k, and only the dates that hold them are read."""

from __future__ import annotations

import datetime as dt
import glob

import pytest

from helpers import AS_OF, attempt, call, make_calls
from relaywatch.functions import windows as W
from relaywatch.operators import events as E
from relaywatch.operators import health as H
from relaywatch.operators import partials as P
from relaywatch.operators.recency import newest
from relaywatch.plans import rollup as R
from relaywatch.sources.calls import read_calls, scoped


def rows(spark):
    """Twenty days of calls a few hours apart, ties among them, every third failed over, two projects."""
    out = []
    for k in range(160):
        at = AS_OF - dt.timedelta(hours=6 * (k // 2), minutes=7)
        out.append(call(f"c{k:03d}", at, project="ab"[k % 2], failed_over=k % 3 == 0,
                        attempts=[attempt("m@x", False), attempt("m@prov", True)]))
    return make_calls(spark, out)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("k", [1, 2, 7, 40, 53, 54, 500])
@pytest.mark.parametrize("project", [None, "a"])
def test_newest_equals_a_plain_top_k(spark, k, project):
    calls = rows(spark)
    rng = W.current("30d", AS_OF)
    sc = scoped(calls, rng, project)
    m = R.measures(calls, R.build(calls), rng, project)
    assert ids(E.failover_events(newest(sc, m, "failovers", k), k)) == ids(E.failover_events(sc, k))
    got, want = H.recent_sample(sc, k, m), H.recent_sample(sc, k)
    assert sorted(ids(got)) == sorted(ids(want))


def test_nothing_in_the_window(spark):
    calls = rows(spark)
    rng = W.current("30d", "2019-01-01 00:00:00")
    sc = scoped(calls, rng)
    m = R.measures(calls, R.build(calls), rng)
    assert ids(newest(sc, m, "calls", 5)) == [] and ids(newest(sc, P.row_measures(sc), "failovers", 5)) == []


def test_other_dates_are_not_read(spark, scratch):
    path, stored = f"{scratch}/calls", f"{scratch}/rollup"
    rows(spark).write.partitionBy("ts_date").parquet(path)
    R.write(R.build(read_calls(spark, path)), stored)
    calls = read_calls(spark, path)
    rng = W.current("30d", AS_OF)
    sc, m = scoped(calls, rng), R.measures(calls, R.read(spark, stored), rng)
    want = ids(E.failover_events(sc, 7)), sorted(ids(H.recent_sample(sc, 9)))
    # older dates that nobody may open any more
    newest_dates = {(AS_OF.date() - dt.timedelta(days=d)).isoformat() for d in range(3)}
    spoiled = [f for f in glob.glob(f"{path}/ts_date=*/*.parquet") if f.split("ts_date=")[1][:10] not in newest_dates]
    for f in spoiled:
        with open(f, "wb") as out:
            out.write(b"not parquet")
        crc = f.rsplit("/", 1)
        with open(f"{crc[0]}/.{crc[1]}.crc", "wb") as out:
            out.write(b"")
    assert len(spoiled) >= 10
    with pytest.raises(Exception):
        E.failover_events(sc, 7).collect()
    assert ids(E.failover_events(newest(sc, m, "failovers", 7), 7)) == want[0]
    assert sorted(ids(H.recent_sample(sc, 9, m))) == want[1]
