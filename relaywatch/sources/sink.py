"""Idempotent append of call rows to the Parquet table.

First write wins on ``id``, as ``INSERT ... ON CONFLICT DO NOTHING`` does:

1. **In-batch duplicates** keep the earliest arrival. This is an aggregate
   (``min_by`` over the arrival order), not a window: partial aggregation
   collapses repeats of one id inside each task before the shuffle, so a
   retry storm on a single id never lands whole in one task.
2. **Already stored ids** drop out by an anti join against the id ledger
   (:mod:`relaywatch.sources.ledger`), bucket by bucket; stored ids are never
   shuffled. First write wins over the whole table: there is no horizon beyond
   which an id would be stored again.
3. **Write**: rows go to folders of their own and become visible by one commit
   (:mod:`relaywatch.sources.commits`). A batch's arrival time is pinned next to the
   table the first time it runs (:func:`pinned_arrival`). A re-run's rows replace its
   earlier ones in one commit, under whatever dates; those are excluded from step 2
   too. A re-run after a failure, or after midnight, so ends as one clean run would,
   and a reader in the middle of it sees the batch before or after, never half.
   Rows are sorted by (project, ts) inside files (S9).

:func:`write_batch` writes a batch's folders without a commit, for tables that are
loaded once; the first :func:`append` takes such a table over.
"""

from __future__ import annotations

import hashlib
import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.schema import CALLS_SCHEMA
from relaywatch.sources import commits, ledger
from relaywatch.sources.commits import BATCH_COLUMN, STORED_SCHEMA
from relaywatch.sources.commits import hadoop_path as _path

ARRIVAL = ["_modified", "_file", "_block", "_pos"]


def dedupe_batch(rows: DataFrame, order: list[str]) -> DataFrame:
    """Keep the earliest row per id by the arrival columns ``order``."""
    cols = [f.name for f in CALLS_SCHEMA.fields]
    first = F.min_by(F.struct(*cols), F.struct(*[c for c in order if c in rows.columns])).alias("r")
    return rows.groupBy("id").agg(first).select("r.*")


def _name(batch_id: str) -> str:
    """A folder name for any batch id; plain ids are their own."""
    batch_id = str(batch_id)
    if re.fullmatch(r"[A-Za-z0-9_.-]{1,200}", batch_id):
        return batch_id
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '-', batch_id)[:40]}-{hashlib.sha256(batch_id.encode()).hexdigest()[:16]}"


def pinned_arrival(spark: SparkSession, path: str, batch_id: str) -> Column:
    """The arrival time of a batch, fixed when the batch first runs.

    It is kept as a file name under the table's ``_batches`` folder (readers
    skip folders that begin with an underscore).
    """
    folder, fs = _path(spark, os.path.join(path, "_batches", _name(batch_id)))
    if not fs.exists(folder) or not fs.listStatus(folder):
        fs.mkdirs(folder)
        mark, _ = _path(spark, os.path.join(path, "_batches", _name(batch_id), str(time.time_ns() // 1000)))
        fs.create(mark).close()
    return F.timestamp_micros(F.lit(min(int(f.getPath().getName()) for f in fs.listStatus(folder))))


def staging(spark: SparkSession, table: str, name: str, batch_id: str) -> str:
    """Scratch path of one table's batch; two tables never share one."""
    from relaywatch.session import checkpoint_dir

    owner = hashlib.sha256(table.encode()).hexdigest()[:16]
    return os.path.join(checkpoint_dir(spark), "ingest-staging", owner, f"{name}-{_name(batch_id)}")


def drop_staging(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        hpath, fs = _path(spark, p)
        fs.delete(hpath, True)


def new_rows(spark: SparkSession, batch: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Rows of an already deduplicated batch whose id is not stored yet."""
    if commits.current(spark, path) is not None:
        return ledger.unknown(spark, batch, path, str(batch_id))
    pattern, fs = _path(spark, os.path.join(path, "ts_date=*"))
    if not fs.globStatus(pattern):
        return batch
    # a table without commits yet: the ids of its folders, the batch's own left out
    stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    return batch.join(stored.where(F.col(BATCH_COLUMN) != F.lit(str(batch_id))).select("id"), "id", "left_anti")


def write_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Append rows as the partitions of ``batch_id`` (idempotent on replay)."""
    out = rows.withColumn(BATCH_COLUMN, F.lit(str(batch_id)))
    # rebalance: cluster by date, but let AQE split a date holding most of
    # the rows into several right-sized tasks instead of one
    (out.hint("rebalance", "ts_date").sortWithinPartitions("project", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ts_date", BATCH_COLUMN).parquet(path))


def append(spark: SparkSession, accepted: DataFrame, path: str, batch_id: str,
           order: list[str] = ARRIVAL) -> DataFrame:
    """S4 + S7: dedupe, drop stored ids, write, commit. Returns the rows written.

    The rows to add are staged in the checkpoint folder first: they are read twice, and
    a failure in between loses nothing, since the re-run starts from the same input.
    """
    staged = staging(spark, path, "fresh", batch_id)
    new_rows(spark, dedupe_batch(accepted, order), path, batch_id).write.mode("overwrite").parquet(staged)
    commit = commits.commit_batch(spark, spark.read.schema(CALLS_SCHEMA).parquet(staged), path, str(batch_id))
    drop_staging(spark, staged)
    return commits.read_folders(spark, path, [f for f in commit["folders"] if f["batch"] == str(batch_id)]).drop(BATCH_COLUMN)
