"""The stored ``calls`` table and the scoped scan every query starts from.

Layout (S9): Parquet, partitioned by ``ts_date`` (and by ``ingest_batch`` so
a replayed micro-batch overwrites exactly its own files), rows sorted by
(project, ts) inside files so min/max statistics prune a project scope.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.functions import windows as W
from relaywatch.schema import CALLS_SCHEMA, KEY_COLUMNS, conform, with_keys
from relaywatch.sources import commits

ALL = "all"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Read a calls table written by :mod:`relaywatch.sources.sink`.

    The read takes the declared schema, whatever any one file holds: columns
    that older files lack come back with their default (S8), date by date. The
    sink has always written the key columns, so in its layout they are read as
    stored and a scope on them is pushed to the scan; a folder of plain files
    (no ``ts_date=`` partitions) may lack them and gets them computed.

    A table with commits is read at its newest one: the folders that it lists,
    whatever else lies beside them.
    """
    commit = commits.current(spark, path)
    if commit is not None:
        return commits.read(spark, path, commit)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ts_date=*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.globStatus(pattern):
        out = conform(spark.read.schema(CALLS_SCHEMA).parquet(path))
    else:
        out = with_keys(conform(spark.read.option("mergeSchema", "true").parquet(path)).drop(*KEY_COLUMNS, "ts_date"))
    return out.select(*[f.name for f in CALLS_SCHEMA.fields])


def scope_filter(project: str | None = None, provider: str | None = None) -> Column:
    """Equality filters; empty or ``all`` means unconstrained.

    The provider scope compares the stored ``provider_key`` (X1), so Parquet
    can push it down instead of evaluating a CASE over ``winner`` per row.
    """
    cond = F.lit(True)
    if project and project != ALL:
        cond = cond & (F.col("project") == F.lit(project))
    if provider and provider != ALL:
        cond = cond & (F.col("provider_key") == F.lit(provider))
    return cond


def scoped(calls: DataFrame, rng: W.TimeRange, project: str | None = None,
           provider: str | None = None) -> DataFrame:
    """Rows of ``calls`` in ``rng`` and in scope."""
    return calls.where(rng.predicate() & scope_filter(project, provider))


def window_scan(calls: DataFrame, window: str, as_of: dt.datetime | str,
                project: str | None = None, provider: str | None = None,
                previous: bool = False) -> tuple[DataFrame, W.TimeRange]:
    rng = W.previous(window, as_of) if previous else W.current(window, as_of)
    return scoped(calls, rng, project, provider), rng
