"""Hand-written call rows (F2) for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from relaywatch.schema import RECORD_SCHEMA, with_keys

AS_OF = dt.datetime(2024, 1, 30, 23, 30, tzinfo=dt.timezone.utc)


def attempt(provider=None, ok=None, latency=100.0, error=None) -> dict:
    return {"provider": provider, "ok": ok, "latency_ms": latency, "error_class": error}


def call(cid: str, ts: dt.datetime | None = None, **kw) -> dict:
    row = {
        "id": cid, "project": "p", "ts": ts or AS_OF - dt.timedelta(minutes=10), "model": "m",
        "winner": "m@prov", "ok": True, "failed_over": False, "latency_ms": 100, "ttft_ms": None,
        "input_tokens": 0, "output_tokens": 0, "cost_usd": Decimal("0"), "baseline_usd": Decimal("0"),
        "cached_saving_usd": Decimal("0"), "cached_input_tokens": 0,
        "attempts": [attempt("m@prov", True)], "modality": None, "media_usage": None,
        "baseline_kind": None, "official_usd": None, "est_cost_usd": None,
    }
    for k in ("cost_usd", "baseline_usd", "cached_saving_usd", "official_usd", "est_cost_usd"):
        if k in kw and kw[k] is not None and not isinstance(kw[k], Decimal):
            kw[k] = Decimal(str(kw[k]))
    row.update(kw)
    return row


def make_calls(spark, rows: list[dict]):
    ordered = [tuple(r[f.name] for f in RECORD_SCHEMA.fields) for r in rows]
    return with_keys(spark.createDataFrame(ordered, RECORD_SCHEMA))
