"""the ``calls`` table derived deterministically from the ``events`` table.

The derivation is a pure projection (no shuffle, no UDF): each event becomes
one call record. All arithmetic is on integers so every engine agrees bit for
bit; money is ``n`` micro-dollars as DECIMAL(12,6). The rules are the ones
written down in ``FIXTURES.md``; the fixed names below are that table's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.schema import ATTEMPT, MEDIA_USAGE, MONEY, with_keys

# Fixed values of the fixture (FIXTURES.md, F1).
PROJECTS = ["atlas", "borealis", "cobalt", "delta.dev"]
MODEL_CLICK = "swift-mini"
MODEL_VIEW = "swift-large"
MODEL_IMAGE = "lumen/pixel-1"
MODEL_VIDEO = "lumen/reel-1"
MODEL_OTHER = "quartz-4"
PROVIDER_CHEAP_A = "northwind"   # click, purchase
PROVIDER_CHEAP_B = "eastgate"    # everything else
PROVIDER_FALLBACK = "summit"
REGION_HOP = "eu"

AS_OF = "2024-01-30 23:30:00"


def money(n: Column) -> Column:
    """``n`` micro-dollars as DECIMAL(12,6), exactly."""
    return (n.cast("decimal(12,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast(MONEY)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table as it is split on disk."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def calls_from_events(events: DataFrame) -> DataFrame:
    """Map every event to one call record with the stored key columns."""
    a = F.col("event_id")
    et = F.col("event_type")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    v = F.round(F.col("value") * 100).cast("bigint")

    base = events.select(
        a.alias("a"), F.col("user_id").alias("u"), et.alias("et"), k.alias("k"), v.alias("v"),
        F.col("ts").cast("timestamp").alias("ts"))

    a, u, et, k, v = (F.col(c) for c in ("a", "u", "et", "k", "v"))
    media = et == "purchase"
    image = a % 2 == 0
    failed_over = (et == "error") & (k < 30)
    ok = ~((et == "error") & (k < 3))
    base_model = (F.when(et == "click", F.lit(MODEL_CLICK))
                   .when(et == "view", F.lit(MODEL_VIEW))
                   .when(media & image, F.lit(MODEL_IMAGE))
                   .when(media, F.lit(MODEL_VIDEO))
                   .otherwise(F.lit(MODEL_OTHER)))
    cheap = F.when(et.isin("click", "purchase"), F.lit(PROVIDER_CHEAP_A)).otherwise(F.lit(PROVIDER_CHEAP_B))

    step1 = base.select(
        "*",
        media.alias("media"), image.alias("image"), failed_over.alias("failed_over"), ok.alias("ok"),
        base_model.alias("base_model"), cheap.alias("cheap"))

    media, image, failed_over, ok = (F.col(c) for c in ("media", "image", "failed_over", "ok"))
    base_model, cheap = F.col("base_model"), F.col("cheap")
    cost_u = (F.when(~ok, F.lit(0))
               .when(media, 50000 + (v * 17) % 100000)
               .otherwise(300 + (v * 11) % 20000))
    input_tokens = F.when(media, F.lit(0)).otherwise(400 + (v * 7) % 5600)
    output_tokens = F.when(media | ~ok, F.lit(0)).otherwise(80 + (v * 13) % 1120)
    ttft = F.when(media | ~ok | (et == "signup"), F.lit(None)).otherwise(200 + v % 800)

    step2 = step1.select(
        "*", cost_u.alias("cost_u"), input_tokens.cast("int").alias("input_tokens"),
        output_tokens.cast("int").alias("output_tokens"), ttft.cast("int").alias("ttft_ms"))

    cost_u = F.col("cost_u")
    ttft = F.col("ttft_ms")
    out = F.col("output_tokens")
    inp = F.col("input_tokens")
    prov = F.when(failed_over, F.lit(PROVIDER_FALLBACK)).otherwise(cheap)
    bare = media | ((et == "click") & (k == 98))
    winner = (F.when(~ok, F.lit(None).cast("string"))
               .when(bare, prov)
               .when((et == "view") & (k == 97), F.concat_ws("@", base_model, F.lit(REGION_HOP), prov))
               .otherwise(F.concat_ws("@", base_model, prov)))
    latency = (F.when(k == 96, F.coalesce(ttft, F.lit(100)))
                .otherwise(F.coalesce(ttft, F.lit(900)) + out * 8 + v % 50))
    baseline_u = (F.when(~ok | (k % 25 == 7), F.lit(0))
                   .when(failed_over, cost_u)
                   .when(k % 10 == 9, cost_u - 100)
                   .otherwise(cost_u + (v * 5) % 9000))
    cached_in = F.when(media | (k % 2 == 1), F.lit(0)).otherwise(inp - inp % 100 - 300)
    est_u = (F.when(~(media & ok), F.lit(None))
              .when(k % 2 == 0, cost_u)
              .when(image, 30000 + v % 10000)
              .otherwise(cost_u + 500))

    def route(provider: Column) -> Column:
        return F.when(media, provider).otherwise(F.concat_ws("@", base_model, provider))

    first = F.struct(route(cheap).alias("provider"), (~failed_over).alias("ok"),
                     F.col("latency_ms").cast("double").alias("latency_ms"),
                     F.when(failed_over, F.lit("429")).alias("error_class")).cast(ATTEMPT)
    second = F.struct(route(F.lit(PROVIDER_FALLBACK)).alias("provider"), ok.alias("ok"),
                      F.col("latency_ms").cast("double").alias("latency_ms"),
                      F.when(~ok, F.lit("503")).alias("error_class")).cast(ATTEMPT)

    step3 = step2.select(
        "*",
        winner.alias("winner"), latency.cast("int").alias("latency_ms"),
        baseline_u.alias("baseline_u"), cached_in.cast("int").alias("cached_input_tokens"),
        est_u.alias("est_u"))

    cached_in = F.col("cached_input_tokens")
    calls = step3.select(
        F.concat(F.lit("evt-"), a.cast("string")).alias("id"),
        F.element_at(F.array(*[F.lit(p) for p in PROJECTS]), (u % 4 + 1).cast("int")).alias("project"),
        F.col("ts"),
        F.when((et == "click") & (k == 98), F.lit("")).otherwise(base_model).alias("model"),
        F.col("winner"), ok.alias("ok"), failed_over.alias("failed_over"),
        F.col("latency_ms"), ttft.alias("ttft_ms"), inp.alias("input_tokens"), out.alias("output_tokens"),
        money(cost_u).alias("cost_usd"),
        money(F.col("baseline_u")).alias("baseline_usd"),
        money(F.when((cached_in == 0) | (k % 4 == 0), F.lit(0)).otherwise(cost_u - cost_u % 3))
        .alias("cached_saving_usd"),
        cached_in.alias("cached_input_tokens"),
        F.when(failed_over, F.array(first, second)).otherwise(F.array(first)).alias("attempts"),
        F.when(media, F.when(image, F.lit("image")).otherwise(F.lit("video"))).alias("modality"),
        F.when(media, F.struct(
            F.when(~image, (4 + k % 7).cast("double")).alias("seconds"),
            F.lit(1.0).alias("outputs"),
            F.lit(None).cast("double").alias("megapixels")).cast(MEDIA_USAGE)).alias("media_usage"),
        F.when(~ok, F.lit(None).cast("string")).when(media, F.lit("official"))
        .otherwise(F.lit("last-leg")).alias("baseline_kind"),
        F.when(media & ok, money(F.col("baseline_u"))).alias("official_usd"),
        money(F.col("est_u")).alias("est_cost_usd"),
    )
    return with_keys(calls)


def fixture_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 calls for a driver scale-factor directory."""
    return calls_from_events(read_events(spark, sf_dir))


# Fixed markers of the ingest feed derived from the fixture (F3 shapes).
RESEND_MODEL = "retry-resend"


def record_lines(calls: DataFrame) -> DataFrame:
    """F3-style JSON lines from F1 calls: one wire record per call, a resend
    of every failed-over call (same id, other model: must be dropped), and a
    few malformed lines, with an arrival order column ``_seq``.

    Keys are the camelCase wire names; optional fields that are null are
    left out of the JSON, and ``ts`` is carried for the bulk-load path (S7).
    """
    n = F.regexp_extract(F.col("id"), r"(\d+)$", 1).cast("bigint")
    k = F.col("_k")
    attempt = lambda a: F.struct(a["provider"].alias("provider"), a["ok"].alias("ok"),
                                 a["latency_ms"].alias("latencyMs"), a["error_class"].alias("errorClass"))

    def wire(model: "Column") -> "Column":
        return F.to_json(F.struct(
            F.col("id").alias("id"), F.col("project").alias("project"), model.alias("model"),
            F.transform("attempts", attempt).alias("attempts"), F.col("winner").alias("winner"),
            F.col("ok").alias("ok"), F.col("failed_over").alias("failedOver"),
            F.col("latency_ms").alias("latencyMs"), F.col("ttft_ms").alias("ttftMs"),
            F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"),
            F.col("cost_usd").alias("costUsd"), F.col("baseline_usd").alias("baselineUsd"),
            F.col("cached_saving_usd").alias("cachedSavingUsd"),
            F.col("cached_input_tokens").alias("cachedInputTokens"),
            F.col("modality").alias("modality"), F.col("media_usage").alias("usage"),
            F.col("baseline_kind").alias("baselineKind"), F.col("official_usd").alias("officialUsd"),
            F.col("est_cost_usd").alias("estCostUsd"),
            F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
        ))

    base = calls.select("*", n.alias("_n"), (n % 100).alias("_k"))
    originals = base.select(wire(F.col("model")).alias("value"), (F.col("_n") * 4).alias("_seq"))
    resends = base.where(F.col("failed_over")).select(
        wire(F.lit(RESEND_MODEL)).alias("value"), (F.col("_n") * 4 + 1).alias("_seq"))
    junk = base.where(k.isin(13, 14, 15, 16)).select(
        F.when(k == 13, F.concat(F.lit("not json "), F.col("id")))
         .when(k == 14, F.lit("[1]"))
         .when(k == 15, F.to_json(F.struct(F.col("_n").alias("id"), F.col("model").alias("model"),
                                           F.lit(True).alias("ok"), F.array().alias("attempts"))))
         .otherwise(F.to_json(F.struct(F.concat(F.lit("bad-"), F.col("id")).alias("id"),
                                       F.col("model").alias("model"), F.lit(True).alias("ok"),
                                       F.array().alias("attempts"), F.lit(12.5).alias("latencyMs"))))
        .alias("value"),
        (F.col("_n") * 4 + 2).alias("_seq"))
    return originals.unionByName(resends).unionByName(junk)
