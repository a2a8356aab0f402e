"""The call-record table: declared schema, defaults and schema evolution.

One row per routed request. Money is DECIMAL(12,6) and stays decimal until a
result is formed, so sums are exact and their DOUBLE casts agree across
engines. ``null`` means unknown and ``0`` means zero: ttft, modality, media
usage, baseline kind, official and estimated price stay null when absent.

Besides the 21 record columns the table stores three derived columns written
at ingest (decision D6): ``provider_key`` and ``model_key`` (so a provider
scope is a plain pushed-down equality instead of a CASE over ``winner``) and
``ts_date`` (the partition column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 6)

ATTEMPT = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("error_class", T.StringType()),
])

MEDIA_USAGE = T.StructType([
    T.StructField("seconds", T.DoubleType()),
    T.StructField("outputs", T.DoubleType()),
    T.StructField("megapixels", T.DoubleType()),
])

# (name, type, nullable, default used when an older file lacks the column)
_COLUMNS = [
    ("id", T.StringType(), False, None),
    ("project", T.StringType(), False, "default"),
    ("ts", T.TimestampType(), False, None),
    ("model", T.StringType(), False, None),
    ("winner", T.StringType(), True, None),
    ("ok", T.BooleanType(), False, None),
    ("failed_over", T.BooleanType(), False, False),
    ("latency_ms", T.IntegerType(), False, 0),
    ("ttft_ms", T.IntegerType(), True, None),
    ("input_tokens", T.IntegerType(), False, 0),
    ("output_tokens", T.IntegerType(), False, 0),
    ("cost_usd", MONEY, False, 0),
    ("baseline_usd", MONEY, False, 0),
    ("cached_saving_usd", MONEY, False, 0),
    ("cached_input_tokens", T.IntegerType(), False, 0),
    ("attempts", T.ArrayType(ATTEMPT), False, None),
    ("modality", T.StringType(), True, None),
    ("media_usage", MEDIA_USAGE, True, None),
    ("baseline_kind", T.StringType(), True, None),
    ("official_usd", MONEY, True, None),
    ("est_cost_usd", MONEY, True, None),
]

# every file has these and scopes filter on them: read bare, so that filters reach the scan
PUSHED = {"project"}

RECORD_COLUMNS = [c[0] for c in _COLUMNS]
KEY_COLUMNS = ["provider_key", "model_key"]
PARTITION_COLUMN = "ts_date"

RECORD_SCHEMA = T.StructType([T.StructField(n, t, nullable) for n, t, nullable, _ in _COLUMNS])

CALLS_SCHEMA = T.StructType(
    RECORD_SCHEMA.fields
    + [T.StructField("provider_key", T.StringType(), False),
       T.StructField("model_key", T.StringType(), False),
       T.StructField("ts_date", T.DateType(), False)]
)


def _default(name: str, dtype: T.DataType, default) -> Column:
    if name == "attempts":
        return F.array().cast(dtype)
    if default is None:
        return F.lit(None).cast(dtype)
    return F.lit(default).cast(dtype)


def conform(df: DataFrame) -> DataFrame:
    """Project ``df`` onto the record schema, filling columns it lacks.

    This is the additive evolution rule: files written before a column
    existed read back with that column's default (0 for counters and money,
    null for the provenance fields), never with an error.
    """
    present = set(df.columns)
    cols = []
    for name, dtype, _, default in _COLUMNS:
        if name in present:
            column = F.col(name).cast(dtype)
            filled = default is not None and name not in PUSHED or name == "attempts"
            cols.append((F.coalesce(column, _default(name, dtype, default)) if filled else column).alias(name))
        else:
            cols.append(_default(name, dtype, default).alias(name))
    extra = [c for c in (*KEY_COLUMNS, PARTITION_COLUMN) if c in present]
    return df.select(*cols, *extra)


def with_keys(df: DataFrame) -> DataFrame:
    """Add the stored derived columns (X1, X2 and the date partition)."""
    from relaywatch.functions.keys import model_key, provider_key

    return (df.withColumn("provider_key", provider_key(F.col("winner")))
              .withColumn("model_key", model_key(F.col("winner"), F.col("model")))
              .withColumn("ts_date", F.to_date(F.col("ts"))))
