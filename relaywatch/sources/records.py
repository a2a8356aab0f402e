"""JSON call records to typed rows, or to quarantine.

A record arrives as one JSON text (camelCase wire names). It is parsed once
into a VARIANT (``try_parse_json``), checked, and projected onto the row
schema with the dashboard's defaults -- all with built-in functions, so the
work stays in the JVM and in whole-stage code generation.

Acceptance (S2) is exactly the dashboard's: an object whose ``id`` and
``model`` are strings, ``ok`` is a boolean and ``attempts`` is an array;
nothing else is checked for shape. Typing then follows the column rules:

* counters and money default to 0 when missing or null; a value that does not
  fit its column (a fraction in an integer, an amount beyond numeric(12,6),
  text that is no number) makes the record a ``bad_value`` -- where the
  database would have refused the insert;
* ``ttftMs``, ``officialUsd``, ``estCostUsd`` are kept only when they are JSON
  numbers, ``modality`` and ``baselineKind`` only when strings, ``usage`` only
  when an object;
* text columns take scalars as their text and objects as their JSON text.

Rejected records keep their raw text and a reason: ``invalid_json``,
``not_a_record`` or ``bad_value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.schema import ATTEMPT, MEDIA_USAGE, MONEY, RECORD_COLUMNS, with_keys

INVALID_JSON = "invalid_json"
NOT_A_RECORD = "not_a_record"
BAD_VALUE = "bad_value"

INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1
_NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


# wire name -> short column stem of the extracted field
FIELDS = {
    "id": "id", "project": "project", "model": "model", "winner": "winner", "ok": "ok",
    "failedOver": "fo", "latencyMs": "lat", "ttftMs": "ttft", "inputTokens": "inp",
    "outputTokens": "out", "costUsd": "cost", "baselineUsd": "base", "cachedSavingUsd": "csave",
    "cachedInputTokens": "cin", "attempts": "att", "modality": "mod", "usage": "usage",
    "baselineKind": "bk", "officialUsd": "off", "estCostUsd": "est", "ts": "ts",
}


def _f(stem: str) -> Column:
    """The extracted field as a VARIANT (SQL null when the key is missing)."""
    return F.col(f"_f_{stem}")


def _kind(stem: str) -> Column:
    """Variant type name of a field: ``STRING``, ``BIGINT``, ``OBJECT<..>``,
    ``VOID`` for JSON null, SQL null when the key is missing."""
    return F.col(f"_k_{stem}")


# typed candidates extracted once per row: (type, column prefix, field stems)
_CANDIDATES = [
    ("double", "_d_", ["lat", "ttft", "inp", "out", "cin"]),
    ("string", "_s_", ["id", "project", "model", "winner", "mod", "bk", "fo"]),
    ("boolean", "_b_", ["ok", "fo"]),
    ("timestamp", "_t_", ["ts"]),
]
_MONEY_STEMS = ["cost", "base", "csave", "off", "est"]
_PREFIX = {dtype: prefix for dtype, prefix, _ in _CANDIDATES}


def _get(stem: str, dtype: str) -> Column:
    """A field already cast to ``dtype`` (see ``_CANDIDATES``)."""
    return F.col(f"{_PREFIX[dtype]}{stem}")


def _absent(stem: str) -> Column:
    k = _kind(stem)
    return k.isNull() | (k == "VOID")


def _is_number(stem: str) -> Column:
    k = _kind(stem)
    return k.isin(*_NUMERIC_TYPES) | k.startswith("DECIMAL")


def _is_structured(stem: str) -> Column:
    k = _kind(stem)
    return k.startswith("OBJECT") | k.startswith("ARRAY") | (k == "BOOLEAN")


def _int_value(stem: str) -> tuple[Column, Column]:
    """(value, bad) for an integer column with default 0."""
    x = _get(stem, "double")
    fits = x.isNotNull() & (x == F.floor(x)) & (x >= INT_MIN) & (x <= INT_MAX)
    bad = ~_absent(stem) & (_is_structured(stem) | ~fits)
    value = F.when(_absent(stem), F.lit(0)).otherwise(F.when(fits, x.cast("int")))
    return value, F.coalesce(bad, F.lit(True))


def _money_value(stem: str, numbers_only: bool) -> tuple[Column, Column]:
    """(value, bad) for a numeric(12,6) column.

    Rounds to 6 places half away from zero; an amount that does not fit is
    bad. With ``numbers_only`` a non-number is simply not kept (null);
    otherwise a missing value is 0.
    """
    value = F.col(f"_m_{stem}")
    if numbers_only:
        keep = _is_number(stem)
        return F.when(keep, value), F.coalesce(keep & value.isNull(), F.lit(False))
    bad = ~_absent(stem) & (_is_structured(stem) | value.isNull())
    out = F.when(_absent(stem), F.lit(0).cast(MONEY)).otherwise(value)
    return out, F.coalesce(bad, F.lit(True))


def _bool_value(stem: str, default: bool) -> tuple[Column, Column]:
    k = _kind(stem)
    text = F.lower(F.trim(_get(stem, "string")))
    parsed = (F.when(k == "BOOLEAN", _get(stem, "boolean"))
               .when(text.isin("t", "true", "y", "yes", "on", "1"), F.lit(True))
               .when(text.isin("f", "false", "n", "no", "off", "0"), F.lit(False)))
    bad = ~_absent(stem) & (k.startswith("OBJECT") | k.startswith("ARRAY") | parsed.isNull())
    return F.when(_absent(stem), F.lit(default)).otherwise(parsed), F.coalesce(bad, F.lit(True))


def _attempts() -> Column:
    arr = F.col("_att")

    def one(e: Column) -> Column:
        ok = F.try_variant_get(e, "$.ok", "variant")
        return F.struct(
            F.try_variant_get(e, "$.provider", "string").alias("provider"),
            F.when(F.schema_of_variant(ok) == "BOOLEAN", F.try_variant_get(ok, "$", "boolean")).alias("ok"),
            F.try_variant_get(e, "$.latencyMs", "double").alias("latency_ms"),
            F.try_variant_get(e, "$.errorClass", "string").alias("error_class"),
        ).cast(ATTEMPT)

    return F.transform(arr, one)


def _usage() -> Column:
    is_obj = _kind("usage").startswith("OBJECT")
    return F.when(is_obj, F.struct(
        F.try_variant_get(_f("usage"), "$.seconds", "double").alias("seconds"),
        F.try_variant_get(_f("usage"), "$.outputs", "double").alias("outputs"),
        F.try_variant_get(_f("usage"), "$.megapixels", "double").alias("megapixels"),
    ).cast(MEDIA_USAGE))


def parse(lines: DataFrame, text_col: str = "value", arrival_ts: Column | None = None,
          explicit_ts: bool = False) -> DataFrame:
    """Parse and type records; every input row comes out once.

    Output: the record columns, ``reason`` (null when accepted), ``raw``
    and any other input columns (arrival order, batch id) unchanged.
    ``ts`` is the arrival instant (S5) unless ``explicit_ts`` lets a bulk
    load (S7) carry its own ``ts`` field.

    Three projections: parse once, extract every wire field (and its type
    name) once, then type. Each field lookup is computed a single time.
    """
    keep = [c for c in lines.columns if c != text_col]
    parsed = lines.select(*keep, F.col(text_col).alias("raw"),
                          F.try_parse_json(F.col(text_col)).alias("v"))
    # Type names only for scalar fields: ``schema_of_variant`` renders the whole
    # nested type, so the root and ``attempts`` are tested structurally instead
    # (a parsed line is an object iff its text starts with "{"; a non-array
    # ``attempts`` gives null as ARRAY<VARIANT>).
    fields = parsed.select(
        *keep, "raw", "v",
        (F.col("v").isNotNull() & F.col("raw").rlike(r"^[ \t\r\n]*\{")).alias("_root_obj"),
        *[F.try_variant_get(F.col("v"), f"$.{wire}", "variant").alias(f"_f_{stem}")
          for wire, stem in FIELDS.items() if stem != "att"],
        F.try_variant_get(F.col("v"), "$.attempts", "array<variant>").alias("_att"))
    fields = fields.select(
        "*", *[F.schema_of_variant(F.col(f"_f_{stem}")).alias(f"_k_{stem}")
               for stem in FIELDS.values() if stem != "att"],
        *[F.try_variant_get(_f(stem), "$", dtype).alias(f"{prefix}{stem}")
          for dtype, prefix, stems in _CANDIDATES for stem in stems],
        *[F.round(F.try_variant_get(_f(stem), "$", "decimal(38,12)"), 6).try_cast(MONEY).alias(f"_m_{stem}")
          for stem in _MONEY_STEMS])

    shape_ok = (F.col("_root_obj")
                & F.coalesce(_kind("id") == "STRING", F.lit(False))
                & F.coalesce(_kind("model") == "STRING", F.lit(False))
                & F.coalesce(_kind("ok") == "BOOLEAN", F.lit(False))
                & F.col("_att").isNotNull())

    latency, bad_latency = _int_value("lat")
    ttft_raw = _get("ttft", "double")
    ttft_fits = (ttft_raw == F.floor(ttft_raw)) & (ttft_raw >= INT_MIN) & (ttft_raw <= INT_MAX)
    ttft = F.when(_is_number("ttft") & ttft_fits, ttft_raw.cast("int"))
    bad_ttft = F.coalesce(_is_number("ttft") & ~ttft_fits, F.lit(False))
    inp, bad_inp = _int_value("inp")
    out, bad_out = _int_value("out")
    cin, bad_cin = _int_value("cin")
    cost, bad_cost = _money_value("cost", False)
    base, bad_base = _money_value("base", False)
    csave, bad_csave = _money_value("csave", False)
    official, bad_official = _money_value("off", True)
    est, bad_est = _money_value("est", True)
    failed_over, bad_fo = _bool_value("fo", False)

    ts = arrival_ts if arrival_ts is not None else F.current_timestamp()
    bad_ts = F.lit(False)
    if explicit_ts:
        given = _get("ts", "timestamp")
        # A malformed time is a bad value, not "now"
        bad_ts = F.coalesce(_kind("ts") != "VOID", F.lit(False)) & given.isNull()
        ts = F.coalesce(given, ts)

    def text_or_null(stem: str) -> Column:
        return F.when(_kind(stem) == "STRING", _get(stem, "string"))

    typed = fields.select(
        *keep, "raw", F.col("v").isNull().alias("_invalid"), shape_ok.alias("_shape_ok"),
        _get("id", "string").alias("id"),
        F.coalesce(_get("project", "string"), F.lit("default")).alias("project"),
        ts.alias("ts"),
        _get("model", "string").alias("model"),
        _get("winner", "string").alias("winner"),
        _get("ok", "boolean").alias("ok"),
        failed_over.alias("failed_over"),
        latency.alias("latency_ms"), ttft.alias("ttft_ms"),
        inp.alias("input_tokens"), out.alias("output_tokens"),
        cost.alias("cost_usd"), base.alias("baseline_usd"), csave.alias("cached_saving_usd"),
        cin.alias("cached_input_tokens"),
        _attempts().alias("attempts"),
        text_or_null("mod").alias("modality"),
        _usage().alias("media_usage"),
        text_or_null("bk").alias("baseline_kind"),
        official.alias("official_usd"), est.alias("est_cost_usd"),
        (bad_latency | bad_ttft | bad_inp | bad_out | bad_cin | bad_cost | bad_base | bad_csave
         | bad_official | bad_est | bad_fo | bad_ts).alias("_bad"),
    )
    reason = (F.when(F.col("_invalid"), F.lit(INVALID_JSON))
               .when(~F.col("_shape_ok"), F.lit(NOT_A_RECORD))
               .when(F.col("_bad"), F.lit(BAD_VALUE)))
    return typed.select(*keep, "raw", reason.alias("reason"), *RECORD_COLUMNS)


def accepted(parsed: DataFrame) -> DataFrame:
    """Rows that passed, with the stored key columns."""
    extra = [c for c in parsed.columns if c not in RECORD_COLUMNS and c not in ("raw", "reason")]
    return with_keys(parsed.where(F.col("reason").isNull()).select(*RECORD_COLUMNS, *extra))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected rows: raw text, reason and a hash of the raw text."""
    extra = [c for c in parsed.columns if c not in RECORD_COLUMNS and c not in ("raw", "reason")]
    return parsed.where(F.col("reason").isNotNull()).select(
        "raw", "reason", F.sha2(F.col("raw"), 256).alias("raw_sha256"), *extra)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files as (value, arrival order) rows.

    Arrival order is the file's modification time, then its name (two files of
    one instant), then the position in the file: the block start and the row
    number inside the task, which increases along the file.
    """
    return spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_modification_time").alias("_modified"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"))
