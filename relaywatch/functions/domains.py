"""Name to web domain, as a dimension table.

Provider names resolve through a configured map, then the built-in map below
(matched on the lower-cased name), then the name itself when it already looks
like a domain. Project names resolve to themselves when they look like a
domain, else through a configured map. The dimension holds one row per known
name (the built-ins plus configuration); Spark chooses the join by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Built-in provider domains.
BUILTIN_PROVIDER_DOMAINS = {
    "openrouter": "openrouter.ai",
    "deepinfra": "deepinfra.com",
    "deepseek": "deepseek.com",
    "tokenmart": "tokenmart.ai",
    "runware": "runware.ai",
    "fal": "fal.ai",
    "anthropic": "anthropic.com",
    "openai": "openai.com",
    "google": "ai.google.dev",
}

DOMAIN_PATTERN = r"(?i)\.[a-z]{2,}$"


def looks_like_domain(name: Column) -> Column:
    return name.rlike(DOMAIN_PATTERN)


def _dimension(spark: SparkSession, mapping: dict[str, str], key: str) -> DataFrame:
    rows = sorted(mapping.items()) or [("", None)]
    return spark.createDataFrame(rows, f"{key} string, domain string")


def provider_domains(df: DataFrame, col: str = "provider",
                     configured: dict[str, str] | None = None) -> DataFrame:
    """Add ``domain`` for the provider names in ``col``."""
    spark = df.sparkSession
    conf = _dimension(spark, {k.lower(): v for k, v in (configured or {}).items()}, "_cfg_key")
    builtin = _dimension(spark, BUILTIN_PROVIDER_DOMAINS, "_bi_key")
    low = F.lower(F.col(col))
    out = (df.join(conf.withColumnRenamed("domain", "_cfg"), low == F.col("_cfg_key"), "left")
             .join(builtin.withColumnRenamed("domain", "_bi"), low == F.col("_bi_key"), "left"))
    domain = F.coalesce(F.col("_cfg"), F.col("_bi"),
                        F.when(looks_like_domain(F.col(col)), F.col(col)))
    return out.withColumn("domain", domain).drop("_cfg_key", "_cfg", "_bi_key", "_bi")


def project_domains(df: DataFrame, col: str = "project",
                    configured: dict[str, str] | None = None) -> DataFrame:
    """Add ``domain`` for the project names in ``col``."""
    conf = _dimension(df.sparkSession, configured or {}, "_cfg_key")
    out = df.join(conf.withColumnRenamed("domain", "_cfg"), F.col(col) == F.col("_cfg_key"),
                  "left")
    domain = F.when(looks_like_domain(F.col(col)), F.col(col)).otherwise(F.col("_cfg"))
    return out.withColumn("domain", domain).drop("_cfg_key", "_cfg")
