"""Commits, the id ledger, compaction and the rollup's deltas."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, utc
from helpers import attempt, call, make_calls
from relaywatch.functions import windows as W
from relaywatch.operators import breakdowns as B
from relaywatch.operators import health as H
from relaywatch.operators import metrics as Mt
from relaywatch.operators import partials as P
from relaywatch.plans import rollup as R
from relaywatch.sources import commits, ledger, sink
from relaywatch.sources.calls import read_calls, window_scan
from relaywatch.sources.fixture import AS_OF, fixture_calls
from relaywatch.streaming import rollup as SR

DAY = utc(2024, 1, 10)


def some(spark, ids, at=DAY, project="p"):
    return make_calls(spark, [call(str(i), at + dt.timedelta(seconds=k), project=project, attempts=[attempt("m@x", True)])
                              for k, i in enumerate(ids)]).coalesce(1)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("batch", ["plain", "2024-01-01T10:00", "a/b*c d%3Aé", "x" * 300])
def test_any_batch_id_and_one_commit_a_batch(spark, scratch, batch):
    path = f"{scratch}/calls"
    sink.append(spark, some(spark, "ab"), path, batch, order=["id"])
    assert ids(read_calls(spark, path)) == ["a", "b"]
    before = read_calls(spark, path)
    sink.append(spark, some(spark, "ac"), path, batch, order=["id"])           # the batch again, with other rows
    assert ids(read_calls(spark, path)) == ["a", "c"]
    assert ids(before) == ["a", "b"]                                            # a reader in the middle keeps the old batch
    sink.append(spark, some(spark, "abd"), path, "later", order=["id"])         # b is free again, a is not
    assert ids(read_calls(spark, path)) == ["a", "b", "c", "d"]
    assert {r["id"]: r["ts"] for r in read_calls(spark, path).select("id", "ts").collect()}["a"] == DAY.replace(tzinfo=None)


def test_rows_without_a_commit_are_not_seen(spark, scratch, monkeypatch):
    path = f"{scratch}/calls"
    sink.append(spark, some(spark, "a"), path, "one", order=["id"])

    def fails(*a, **k):
        raise RuntimeError("lost")
    monkeypatch.setattr(commits, "publish", fails)
    with pytest.raises(RuntimeError):
        commits.commit_batch(spark, some(spark, "b"), path, "two")
    monkeypatch.undo()
    assert ids(read_calls(spark, path)) == ["a"]
    sink.append(spark, some(spark, "b"), path, "two", order=["id"])             # the re-run after the failure
    assert ids(read_calls(spark, path)) == ["a", "b"]
    with pytest.raises(RuntimeError):                                           # two writers: the second does not win silently
        commits.publish(spark, f"{path}/{commits.FOLDER}", {}, commits.current(spark, path)["number"])


def test_a_table_of_plain_batches_is_taken_over(spark, scratch):
    path = f"{scratch}/calls"
    sink.write_batch(some(spark, "ab"), path, "b0")
    sink.write_batch(some(spark, "cd", DAY + dt.timedelta(days=1)), path, "b1")
    sink.append(spark, some(spark, "ax"), path, "b2", order=["id"])
    assert ids(read_calls(spark, path)) == ["a", "b", "c", "d", "x"]
    sink.append(spark, some(spark, "ac"), path, "b0", order=["id"])             # a re-run of a plain batch: c is b1's
    assert ids(read_calls(spark, path)) == ["a", "c", "d", "x"]


def test_ledger_stores_narrow_rows_and_stored_ids_are_not_shuffled(spark, scratch):
    path = f"{scratch}/calls"
    for k in range(3):
        sink.append(spark, some(spark, range(10 * k, 10 * k + 10)), path, f"b{k}", order=["id"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = ledger.unknown(spark, some(spark, range(25, 40)), path, "b9")
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert ids(new) == [str(k) for k in range(30, 40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    stored_side = plan[plan.index("id_ledger"):]
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in stored_side
    assert "ReadSchema: struct<h1:bigint,h2:bigint" in plan
    mark = ledger.compact(spark, path)
    assert mark["generation"] == 1
    assert ids(ledger.unknown(spark, some(spark, range(25, 35)), path, "b9")) == [str(k) for k in range(30, 35)]


def test_ledger_of_a_batch_on_many_dates(spark, scratch):
    path = f"{scratch}/calls"
    rows = some(spark, "abc").unionByName(some(spark, "def", DAY + dt.timedelta(days=1)))
    sink.append(spark, rows, path, "two days", order=["id"])
    assert ids(ledger.unknown(spark, some(spark, "afgh"), path, "next")) == ["g", "h"]
    commits.compact(spark, path, ["2024-01-10"])
    sink.append(spark, some(spark, "aeg"), path, "next", order=["id"])
    assert ids(read_calls(spark, path)) == list("abcdefg")


def test_ledger_follows_many_batches_against_a_set(spark, scratch, monkeypatch):
    monkeypatch.setattr(ledger, "COMPACT_AFTER", 3)
    rng, path, stored = random.Random(5), f"{scratch}/calls", {}
    for k in range(7):
        batch, mine = f"b{k % 5}", [str(rng.randrange(25)) for _ in range(6)]
        stored = {i: b for i, b in stored.items() if b != batch}                # 5 and 6 are re-runs of 0 and 1
        stored |= {i: batch for i in mine if i not in stored}
        sink.append(spark, some(spark, mine), path, batch, order=["id"])
        assert ids(read_calls(spark, path)) == sorted(stored)


def test_compaction_keeps_answers_and_clusters_projects(spark, scratch):
    path = f"{scratch}/calls"
    for k in range(12):
        at = DAY + dt.timedelta(days=k % 2, minutes=k)
        commits.commit_batch(spark, some(spark, [f"{k}-{j}" for j in range(6)], at, f"p{k % 3}"), path, f"b{k}")
    before, number = sorted(map(tuple, read_calls(spark, path).drop("attempts", "media_usage").collect())), commits.current(spark, path)["number"]
    old = read_calls(spark, path)
    commits.compact(spark, path, ["2024-01-10"], file_rows=6)
    commit = commits.current(spark, path)
    assert commit["number"] == number + 1 and len([f for f in commit["folders"] if f["date"] == "2024-01-10"]) == 1
    now = read_calls(spark, path)
    assert sorted(map(tuple, now.drop("attempts", "media_usage").collect())) == before
    assert old.count() == len(before)
    files = now.where("ts_date = '2024-01-10'").groupBy(F.input_file_name()).agg(F.countDistinct("project").alias("n")).collect()
    assert len(files) > 1 and sum(f["n"] for f in files) <= len(files) + 2      # a project stands in few files
    sink.append(spark, some(spark, ["0-0", "1-0", "new"]), path, "later", order=["id"])
    assert read_calls(spark, path).count() == len(before) + 1
    sink.append(spark, some(spark, ["0-0", "zz"]), path, "b0", order=["id"])     # a compacted batch is settled: only new ids land
    assert read_calls(spark, path).count() == len(before) + 2
    assert commits.compact(spark, path, ["2024-01-09"]) == commits.current(spark, path)


def panels(calls, rollup, attempts, rng):
    return (Mt.metrics(R.measures(calls, rollup, rng)).first(),
            sorted(map(str, B.model_stats(R.measures(calls, rollup, rng)).collect())),
            sorted(map(tuple, H.provider_health_measures(R.attempt_measures(calls, attempts, rng), rng, sort=False).collect())))


def raw_panels(calls, window, as_of):
    sc, rng = window_scan(calls, window, as_of)
    return rng, (Mt.metrics(P.row_measures(sc)).first(), sorted(map(str, B.model_stats(P.row_measures(sc)).collect())),
                 sorted(map(tuple, H.provider_health(sc, rng, None, sort=False).collect())))


def test_deltas_read_only_their_commit_and_answer_like_the_raw_table(spark, scratch):
    every = fixture_calls(spark, SF_SMALL).where("ts_date >= '2024-01-28'").cache()
    path, rolled, tried = (f"{scratch}/{n}" for n in ("calls", "rollup", "attempts"))
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1

    def check():
        calls, rollup, attempts = read_calls(spark, path), R.read(spark, rolled), R.read(spark, tried)
        for as_of, w in ((AS_OF, "24h"), ("2024-01-29 17:03:27", "7d")):
            rng, wanted = raw_panels(calls, w, as_of)
            assert panels(calls, rollup, attempts, rng) == wanted, (as_of, w)
        return calls, rollup, attempts

    def add():
        return [[f["path"] for f in R.add_deltas(spark, path, to, a)] for to, a in ((rolled, False), (tried, True))]

    commits.commit_batch(spark, every.where(odd), path, "odd")
    assert len(add()[0]) == 3
    check()
    commits.commit_batch(spark, every.where(~odd & (F.col("ts_date") == "2024-01-29")), path, "29")
    old = check()                                                    # the rollup lacks a batch: it is read raw, nothing else
    last = commits.current(spark, path)["folders"][-1]["path"]
    assert add() == [[last], [last]] and add() == [[], []]           # its own rows only; a replay adds nothing
    calls, rollup, _ = check()
    mark = R.read_mark(spark, rolled)
    assert R._covered(commits.current(spark, path)["folders"], mark["deltas"])[1] == []      # nothing raw but edges
    rng, wanted = raw_panels(old[0], "24h", AS_OF)
    assert panels(old[0], *(R.read(spark, p) for p in (rolled, tried)), rng) == wanted       # newer rollup, older snapshot
    commits.commit_batch(spark, every.where(~odd & (F.col("ts_date") == "2024-01-29") & (F.col("project") != "alpha")), path, "29")
    check()                                                          # a replaced batch voids its delta
    add()
    check()
    commits.commit_batch(spark, every.where(~odd & (F.col("ts_date") == "2024-01-30")), path, "30")
    commits.compact(spark, path, ["2024-01-30"])                     # holds a commit that the rollup lacks
    check()
    add()
    for p in (rolled, tried):
        R.merge_deltas(spark, p, ["2024-01-28", "2024-01-29", "2024-01-30"])
    assert len(R.read_mark(spark, rolled)["deltas"]) == 3
    check()
    commits.compact(spark, path, ["2024-01-29"])                     # same commits, other files: still covered
    assert add() == [[], []]
    check()


def test_streamed_deltas_serve_the_current_date(spark, scratch):
    every = fixture_calls(spark, SF_SMALL).where("ts_date >= '2024-01-29'").cache()
    path, rolled = f"{scratch}/calls", f"{scratch}/rollup"
    for k in range(2):
        commits.commit_batch(spark, every.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k), path, f"b{k}")
        SR.start(spark, path, rolled, f"{scratch}/ck").awaitTermination()
        calls, rollup = read_calls(spark, path), R.read(spark, rolled)
        assert rollup.agg(F.sum("calls")).first()[0] == calls.count()          # to the last bucket of today
        sc, rng = window_scan(calls, "24h", AS_OF)
        assert Mt.metrics(R.measures(calls, rollup, rng)).first() == Mt.metrics(P.row_measures(sc)).first()
    SR.start(spark, path, rolled, f"{scratch}/other").awaitTermination()        # a lost checkpoint adds nothing
    assert R.read(spark, rolled).agg(F.sum("calls")).first()[0] == every.count()


def test_a_span_is_covered_once_by_the_widest_aligned_spans():
    rnd = random.Random(5)
    for _ in range(300):
        lo = rnd.randrange(-50, 900) * 300
        hi = lo + rnd.randrange(0, 900) * 300
        got = R.cover(lo, hi, [*reversed(R.TIERS), R.GRAIN])
        assert all(a % w == 0 and b % w == 0 and a < b for w, spans in got.items() for a, b in spans)
        spans = sorted(s for x in got.values() for s in x)
        assert [a for a, _ in spans] + [hi] == [lo] + [b for _, b in spans] if spans else lo == hi
        assert all(len(x) <= 2 for x in got.values())
        for w, wider in zip([R.GRAIN, *R.TIERS], R.TIERS):                       # no span could have been wider
            assert all(-(-a // wider) >= b // wider for a, b in got.get(w, []))


def test_tiers_answer_like_the_raw_table_and_read_a_row_a_day(spark, scratch):
    every = fixture_calls(spark, SF_SMALL).where("ts_date >= '2024-01-22'").cache()
    path, rolled, tried = (f"{scratch}/{n}" for n in ("calls", "rollup", "attempts"))
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1

    def bring(batch, rows, fold):
        commits.commit_batch(spark, rows, path, batch)
        for to, a in ((rolled, False), (tried, True)):
            R.add_deltas(spark, path, to, a)
            R.merge_deltas(spark, to, fold)

    def check():
        calls, rollup, attempts = read_calls(spark, path), R.read(spark, rolled), R.read(spark, tried)
        for as_of, w in ((AS_OF, "30d"), ("2024-01-29 17:03:27", "7d"), ("2024-01-29 17:03:27", "24h")):
            rng, wanted = raw_panels(calls, w, as_of)
            assert panels(calls, rollup, attempts, rng) == wanted, (as_of, w)

    last = every.agg(F.max("ts_date")).first()[0].isoformat()
    dates = sorted(r[0].isoformat() for r in every.select("ts_date").distinct().collect())
    bring("most", every.where(odd | (F.col("ts_date") < dates[-4])), [d for d in dates if d < last])
    check()
    mark = R.read_mark(spark, rolled)
    assert {d["date"] for d in mark["deltas"] if "tiers" in d} == set(dates) - {last}
    inside = [d for d in mark["deltas"] if "2024-01-23" <= d["date"] <= "2024-01-25"]
    lo = int(utc(2024, 1, 23).timestamp())
    fine = R._delta_rows(spark, rolled, mark, inside)
    day = R._spanned(spark, rolled, mark, mark["deltas"], lo, lo + 3 * R.DAY, R.DAY)
    assert day.count() == fine.select("ts_date", *R.GROUP).distinct().count() < fine.count()
    assert day.agg(F.sum("calls")).first() == fine.agg(F.sum("calls")).first()
    hour = R._spanned(spark, rolled, mark, mark["deltas"], lo, lo + 3 * R.DAY, 21600)
    assert hour.count() == fine.select((F.col("t0") / 3600).cast("long"), *R.GROUP).distinct().count()
    bring("rest", every.where(~odd & (F.col("ts_date") >= dates[-4])), [])       # folded dates with another delta beside
    check()
    bring("rest", every.where(~odd & (F.col("ts_date") >= dates[-4]) & (F.col("project") != "alpha")), dates)
    assert all("tiers" in d for d in R.read_mark(spark, rolled)["deltas"])
    check()
    number = R.read_mark(spark, rolled)["number"]
    R.merge_deltas(spark, rolled, dates)                                         # nothing to fold
    assert R.read_mark(spark, rolled)["number"] == number
    bring("rest", every.where(~odd & (F.col("ts_date") >= dates[-4])), [])       # a replaced batch voids folded deltas
    check()
