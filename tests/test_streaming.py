"""T1 streaming ingest and T2/T3 rollup maintenance."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relaywatch.functions import windows as W
from relaywatch.operators import health as H
from relaywatch.operators import metrics as Mt
from relaywatch.operators import partials as P
from relaywatch.plans import ingest as I
from relaywatch.plans import rollup as R
from relaywatch.sources import sink
from relaywatch.sources.calls import read_calls, window_scan
from relaywatch.sources.fixture import AS_OF, fixture_calls, record_lines
from relaywatch.streaming import ingest as SI
from relaywatch.streaming import rollup as SR


def _feed(spark, path):
    """Two files in arrival order: originals and junk, then the resends."""
    import time

    lines = record_lines(fixture_calls(spark, SF_SMALL))
    first = lines.where(F.col("_seq") % 4 != 1).orderBy("_seq").coalesce(1).select("value")
    first.write.text(f"{path}/a")
    time.sleep(1.1)
    lines.where(F.col("_seq") % 4 == 1).orderBy("_seq").coalesce(1).select("value").write.text(f"{path}/b")


def test_stream_ingest_is_exactly_once(spark, scratch):
    _feed(spark, f"{scratch}/src")
    q = SI.start(spark, f"{scratch}/src/*", f"{scratch}/calls", f"{scratch}/quar", f"{scratch}/ck1",
                 max_files_per_trigger=1)
    q.awaitTermination()
    assert len({p["batchId"] for p in q.recentProgress}) >= 2
    calls = read_calls(spark, f"{scratch}/calls")
    n_events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert calls.count() == n_events == calls.select("id").distinct().count()
    assert calls.where(F.col("model") == "retry-resend").count() == 0
    reasons = {r["reason"]: r["count"] for r in
               spark.read.parquet(f"{scratch}/quar").groupBy("reason").count().collect()}
    assert set(reasons) == {"invalid_json", "not_a_record", "bad_value"}
    # a new query over the same files (a lost checkpoint) writes nothing new
    q = SI.start(spark, f"{scratch}/src/*", f"{scratch}/calls", f"{scratch}/quar", f"{scratch}/ck2")
    q.awaitTermination()
    assert read_calls(spark, f"{scratch}/calls").count() == n_events


def test_new_checkpoint_with_other_files_keeps_stored_calls(spark, scratch):
    """Epochs of a new checkpoint start at 0 again; they are not the first query's."""
    for k, name in enumerate("xy"):
        line = '{"id": "%s", "model": "m", "ok": true, "attempts": []}' % name
        spark.createDataFrame([(line,)], "value string").write.text(f"{scratch}/{name}")
        SI.start(spark, f"{scratch}/{name}", f"{scratch}/calls", f"{scratch}/quar", f"{scratch}/ck{k}").awaitTermination()
    assert sorted(r["id"] for r in read_calls(spark, f"{scratch}/calls").collect()) == ["x", "y"]


def test_stream_rollup_matches_batch_rollup(spark, scratch):
    lines = record_lines(fixture_calls(spark, SF_SMALL))
    I.ingest_lines(spark, lines, f"{scratch}/calls", f"{scratch}/quar", "bulk", order=["_seq"],
                   explicit_ts=True)
    calls = read_calls(spark, f"{scratch}/calls")
    q = SR.start(spark, f"{scratch}/calls", f"{scratch}/rollup", f"{scratch}/ck")
    q.awaitTermination()
    streamed = R.read(spark, f"{scratch}/rollup")
    # the table has commits: every bucket is there, the newest too
    closed = R.build(calls)
    cols = ["t0", *R.GROUP, "calls", "cost", "saved", "latency_sum"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, closed.select(cols).collect()))


def test_stream_attempts_rollup_matches_batch(spark, scratch):
    lines = record_lines(fixture_calls(spark, SF_SMALL))
    I.ingest_lines(spark, lines, f"{scratch}/calls", f"{scratch}/quar", "bulk", order=["_seq"],
                   explicit_ts=True)
    calls = read_calls(spark, f"{scratch}/calls")
    q = SR.start_attempts(spark, f"{scratch}/calls", f"{scratch}/attempts", f"{scratch}/ck")
    q.awaitTermination()
    streamed = R.read(spark, f"{scratch}/attempts")
    closed = R.build_attempts(calls)
    cols = ["t0", *R.ATTEMPT_GROUP, *R.ATTEMPT_MEASURES]
    assert streamed.count() > 0
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, closed.select(cols).collect()))


def test_rollup_rebuild_and_exact_edges(spark, scratch):
    calls_df = fixture_calls(spark, SF_SMALL)
    path = f"{scratch}/calls"
    calls_df.write.partitionBy("ts_date").parquet(path)
    calls = read_calls(spark, path)
    R.write(R.build(calls), f"{scratch}/rollup")
    R.rebuild_dates(calls, f"{scratch}/rollup", [W.to_utc(AS_OF).date()])
    rollup = R.read(spark, f"{scratch}/rollup")
    assert rollup.agg(F.sum("calls")).first()[0] == calls.count()
    for as_of in (AS_OF, "2024-01-20 11:11:11.5"):
        for w in ("1h", "24h", "7d"):
            sc, rng = window_scan(calls, w, as_of)
            raw = Mt.metrics(P.row_measures(sc)).first()
            via = Mt.metrics(R.measures(calls, rollup, rng)).first()
            assert raw == via, (as_of, w)


def _panels(calls, rollup, attempts, rng):
    return (Mt.metrics(R.measures(calls, rollup, rng)).first(),
            sorted(map(tuple, H.provider_health_measures(R.attempt_measures(calls, attempts, rng), rng, sort=False).collect())))


def test_streamed_rollup_that_lags_answers_like_the_raw_table(spark, scratch):
    """New days before old ones, one file a trigger; a replay; then late and newer calls it has not seen."""
    import time

    every = fixture_calls(spark, SF_SMALL).where("ts_date >= '2024-01-26'").cache()
    path = f"{scratch}/calls"
    days = ["2024-01-29", "2024-01-27", "2024-01-28"]
    for k, day in enumerate(days):
        sink.write_batch(every.where(F.col("ts_date") == day).where("id not like '%3'").coalesce(1), path, f"b{k}")
        time.sleep(1.1)

    def keep(ck):
        for name, start in (("rollup", SR.start), ("attempts", SR.start_attempts)):
            start(spark, path, f"{scratch}/{name}", f"{scratch}/{ck}-{name}", max_files_per_trigger=1).awaitTermination()

    def check():
        calls = read_calls(spark, path)
        rollup, attempts = R.read(spark, f"{scratch}/rollup"), R.read(spark, f"{scratch}/attempts")
        for as_of in (AS_OF, "2024-01-29 17:03:27"):
            for w in ("1h", "24h", "7d"):
                sc, rng = window_scan(calls, w, as_of)
                assert _panels(calls, rollup, attempts, rng) == (
                    Mt.metrics(P.row_measures(sc)).first(),
                    sorted(map(tuple, H.provider_health(sc, rng, None, sort=False).collect()))), (as_of, w)
        return calls, rollup

    keep("ck")
    calls, rollup = check()
    assert rollup.agg(F.sum("calls")).first()[0] > 0.9 * calls.count()
    keep("other")                      # a lost checkpoint replays every file
    check()
    sink.write_batch(every.where("ts_date = '2024-01-27' and id like '%3'"), path, "late")
    sink.write_batch(every.where("ts_date = '2024-01-30'"), path, "new")
    calls, rollup = check()
    first = int(W.to_utc("2024-01-26 00:00:00").timestamp())
    until = R.read_mark(spark, f"{scratch}/rollup")["until"]
    # the 27th has changed since, everything after the mark is not there yet
    assert R._rolled(calls, rollup, first, first + 5 * 86400) == [(first, first + 86400), (first + 2 * 86400, until)]
    keep("ck")
    check()
    assert R._rolled(calls, R.read(spark, f"{scratch}/rollup"), first, first + 4 * 86400) == [(first, first + 4 * 86400)]


def test_rollup_of_a_file_sink_is_refused(spark, scratch):
    os.makedirs(f"{scratch}/rollup/_spark_metadata")
    with pytest.raises(ValueError):
        SR.start(spark, f"{scratch}/calls", f"{scratch}/rollup", f"{scratch}/ck")
