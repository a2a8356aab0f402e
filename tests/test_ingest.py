"""record validation, defaults, quarantine and idempotent append."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from relaywatch.plans import ingest as I
from relaywatch.sources import records as Rec
from relaywatch.sources import sink
from relaywatch.sources.calls import read_calls

BASE = {"id": "r1", "model": "m", "ok": True, "attempts": []}


def rec(**kw) -> str:
    return json.dumps({**BASE, **kw})


def parse(spark, lines: list[str]):
    df = spark.createDataFrame([(line, i) for i, line in enumerate(lines)], "value string, _seq long")
    return {r["_seq"]: r for r in Rec.parse(df).collect()}


def test_minimal_record_gets_defaults(spark):
    r = parse(spark, [rec()])[0]
    assert r["reason"] is None and r["project"] == "default" and r["winner"] is None
    assert r["failed_over"] is False and r["latency_ms"] == 0 and r["ttft_ms"] is None
    assert float(r["cost_usd"]) == 0.0 and r["attempts"] == [] and r["media_usage"] is None
    assert r["official_usd"] is None and r["modality"] is None and r["ts"] is not None


@pytest.mark.parametrize("line,reason", [
    (json.dumps({**BASE, "id": 5}), "not_a_record"),
    (json.dumps({**BASE, "ok": "true"}), "not_a_record"),
    (json.dumps({**BASE, "attempts": {}}), "not_a_record"),
    (json.dumps({"id": "x", "ok": True, "attempts": []}), "not_a_record"),
    ("not json", "invalid_json"),
    ("[1]", "not_a_record"),
    ("null", "not_a_record"),
    (rec(costUsd=1000000), "bad_value"),
    (rec(latencyMs=12.5), "bad_value"),
    (rec(inputTokens="abc"), "bad_value"),
    (rec(failedOver=[1]), "bad_value"),
    (rec(estCostUsd=1e9), "bad_value"),
])
def test_rejections(spark, line, reason):
    assert parse(spark, [line])[0]["reason"] == reason


def test_typing_rules(spark):
    rows = parse(spark, [
        rec(ttftMs="7"),
        rec(usage=[1]),
        rec(extra={"a": 1}, other=3),
        '{"id": "r1", "model": "a", "model": "b", "ok": true, "attempts": []}',
        rec(costUsd=0.1234565, latencyMs="12", failedOver="true", project=7, modality=3,
            estCostUsd="0.5", usage={"seconds": "4", "outputs": 2}, winner="m@p",
            attempts=[{"provider": "m@p", "ok": False, "latencyMs": 10, "errorClass": "429"},
                      {"ok": 1}]),
    ])
    assert rows[0]["reason"] is None and rows[0]["ttft_ms"] is None
    assert rows[1]["reason"] is None and rows[1]["media_usage"] is None
    assert rows[2]["reason"] is None
    assert rows[3]["model"] == "b"
    r = rows[4]
    assert r["reason"] is None and float(r["cost_usd"]) == 0.123457 and r["latency_ms"] == 12
    assert r["failed_over"] is True and r["project"] == "7" and r["modality"] is None
    assert r["est_cost_usd"] is None and r["media_usage"]["seconds"] == 4.0
    a0, a1 = r["attempts"]
    assert (a0["provider"], a0["ok"], a0["latency_ms"], a0["error_class"]) == ("m@p", False, 10.0, "429")
    assert a1["provider"] is None and a1["ok"] is None


def test_first_write_wins_and_replay(spark, scratch):
    lines = [rec(id="a", model="first"), rec(id="a", model="second"), rec(id="b"), "not json"]
    df = spark.createDataFrame([(line, i) for i, line in enumerate(lines)], "value string, _seq long")
    table, quar = f"{scratch}/calls", f"{scratch}/quar"
    I.ingest_lines(spark, df, table, quar, "batch-1", order=["_seq"])
    calls = read_calls(spark, table)
    assert sorted((r["id"], r["model"]) for r in calls.collect()) == [("a", "first"), ("b", "m")]
    assert spark.read.parquet(quar).select("reason").collect()[0][0] == "invalid_json"
    # the same batch again (a replay after a failure): nothing changes
    I.ingest_lines(spark, df, table, quar, "batch-1", order=["_seq"])
    assert read_calls(spark, table).count() == 2
    assert spark.read.parquet(quar).count() == 1
    # a later batch resending a stored id and one new id: only the new one lands
    later = spark.createDataFrame([(rec(id="a", model="late"), 0), (rec(id="c"), 1)],
                                  "value string, _seq long")
    I.ingest_lines(spark, later, table, quar, "batch-2", order=["_seq"])
    got = sorted((r["id"], r["model"]) for r in read_calls(spark, table).collect())
    assert got == [("a", "first"), ("b", "m"), ("c", "m")]


def test_stored_ids_drop_out_of_a_batch(spark, scratch):
    table = f"{scratch}/calls"
    first = Rec.accepted(Rec.parse(spark.createDataFrame([(rec(id="a"), 0)], "value string, _seq long")))
    sink.write_batch(sink.dedupe_batch(first, ["_seq"]), table, "b1")
    batch = Rec.accepted(Rec.parse(spark.createDataFrame(
        [(rec(id="a"), 0), (rec(id="z"), 1)], "value string, _seq long")))
    fresh = sink.new_rows(spark, sink.dedupe_batch(batch, ["_seq"]), table, "b2")
    assert [r["id"] for r in fresh.collect()] == ["z"]


def test_older_files_without_new_columns(spark, scratch):
    path = f"{scratch}/old"
    old = spark.createDataFrame(
        [("o1", "p", "m", "m@x", True, False, 5, 1, 2, "0.5", [])],
        "id string, project string, model string, winner string, ok boolean, failed_over boolean, "
        "latency_ms int, input_tokens int, output_tokens int, cost_usd string, "
        "attempts array<struct<provider:string,ok:boolean,latency_ms:double,error_class:string>>")
    old.withColumn("ts", F.current_timestamp()).write.parquet(path)
    r = read_calls(spark, path).first()
    assert r["ttft_ms"] is None and float(r["baseline_usd"]) == 0.0 and r["cached_input_tokens"] == 0
    assert r["provider_key"] == "x" and r["model_key"] == "m" and r["modality"] is None


def test_batch_rerun_with_another_arrival_replaces_itself(spark, scratch):
    """A re-run after midnight carries another date; nothing may stay under the first."""
    table, quar = f"{scratch}/calls", f"{scratch}/quar"
    df = spark.createDataFrame([(rec(id="a"), 0), (rec(id="b"), 1)], "value string, _seq long")
    for day in ("2024-01-01 23:59:59", "2024-01-02 00:00:01"):
        I.ingest_lines(spark, df, table, quar, "b1", order=["_seq"], arrival_ts=F.lit(day).cast("timestamp"))
    assert sorted(r["id"] for r in read_calls(spark, table).collect()) == ["a", "b"]
    # without an explicit arrival the batch's first one is pinned
    I.ingest_lines(spark, df.where("_seq < 0"), f"{scratch}/other", quar, "b2", order=["_seq"])
    one = sink.pinned_arrival(spark, f"{scratch}/other", "b2")
    two = sink.pinned_arrival(spark, f"{scratch}/other", "b2")
    row = spark.range(1).select(one.alias("x"), two.alias("y")).first()
    assert row["x"] == row["y"]


def test_tables_with_equal_batch_ids_do_not_share_staging(spark, scratch):
    one, two = sink.staging(spark, f"{scratch}/a", "parsed", "b"), sink.staging(spark, f"{scratch}/b", "parsed", "b")
    assert one != two


def test_old_ids_are_stored_once_however_old(spark, scratch):
    table, quar = f"{scratch}/calls", f"{scratch}/quar"
    line = rec(id="old", ts="2020-01-01T00:00:00Z")
    df = spark.createDataFrame([(line, 0)], "value string, _seq long")
    for batch in ("b1", "b2"):
        I.ingest_lines(spark, df, table, quar, batch, order=["_seq"], explicit_ts=True)
    assert read_calls(spark, table).count() == 1


def test_malformed_explicit_time_is_rejected(spark):
    df = spark.createDataFrame([(rec(ts="yesterday"), 0), (rec(ts="2024-01-01T00:00:00Z"), 1)], "value string, _seq long")
    got = {r["_seq"]: r["reason"] for r in Rec.parse(df, explicit_ts=True).collect()}
    assert got == {0: "bad_value", 1: None}


def test_dates_of_different_age_read_right_together(spark, scratch):
    """An old date without some columns does not hide them in the new one."""
    path = f"{scratch}/calls"
    lines = [rec(id=f"n{k}", baselineUsd=2, estCostUsd=1) for k in range(3)]
    rows = Rec.accepted(Rec.parse(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, _seq long"),
                                  arrival_ts=F.lit("2024-01-02 00:00:00").cast("timestamp")))
    sink.write_batch(sink.dedupe_batch(rows, ["_seq"]), path, "new")
    old = rows.withColumn("id", F.concat(F.lit("o"), "id")).drop("baseline_usd", "est_cost_usd", "_seq", "ts_date")
    old.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(f"{path}/ts_date=2024-01-01/ingest_batch=old")
    got = read_calls(spark, path).groupBy("ts_date").agg(
        F.count("*").alias("n"), F.sum("baseline_usd").cast("double").alias("b"), F.count("est_cost_usd").alias("e")).orderBy("ts_date")
    assert [tuple(r)[1:] for r in got.collect()] == [(3, 0.0, 0), (3, 6.0, 3)]
