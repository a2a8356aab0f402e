"""The ids a calls table holds, in hash buckets.

Beside the calls lies a narrow table (two 64-bit hashes of the id and the commit
number) in a fixed number of buckets by those hashes. An arriving batch is shuffled to
the same buckets and joined bucket by bucket: stored ids are read, never moved, and
how wide the calls are does not matter.

The ledger is derived from the commits: before it is asked it takes in the folders
that hold commits it does not know, one narrow read of each. A failure at any point leaves
it behind the table, never ahead of it; ids taken in twice mean nothing more. Ids of
a commit that a re-run batch has replaced count no longer.

Every batch adds a file to each bucket; :func:`compact` rewrites the ledger as one file a
bucket in a new generation. ``buckets`` is fixed when a ledger is made: about one for each
gigabyte of ids expected (24 bytes an id).
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.sources import commits

FOLDER = "_ids"
BUCKETS = 16
KEYS = ["h1", "h2"]
COMPACT_AFTER = 64       # batches taken in before the ledger is rewritten
FOLDED = -1              # commit number of ids whose batch can no longer be replaced


def _marks(path: str) -> str:
    return os.path.join(path, FOLDER, "_marks")


def _place(path: str, generation: int) -> str:
    return os.path.join(path, FOLDER, f"generation={generation}")


def _registered(spark: SparkSession, path: str, mark: dict) -> str:
    """The ledger's name in this session's catalog."""
    place = _place(path, mark["generation"])
    name = f"id_ledger_{hashlib.sha256(place.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, commit_no BIGINT) USING parquet "
                  f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {mark['buckets']} BUCKETS LOCATION '{place}'")
    return name


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the two hashes of ``id``."""
    return rows.withColumns({"h1": F.xxhash64("id"), "h2": F.xxhash64(F.lit("second"), F.col("id"))})


def _add(spark: SparkSession, ids: DataFrame, path: str, mark: dict) -> None:
    """Append ids, one sorted file to each bucket."""
    name = _registered(spark, path, mark)
    (ids.repartition(mark["buckets"], *KEYS).write.mode("append").format("parquet")
     .bucketBy(mark["buckets"], *KEYS).sortBy(*KEYS).saveAsTable(name))


def take_in(spark: SparkSession, path: str, buckets: int = BUCKETS) -> dict | None:
    """Bring the ledger up to the table's newest commit; returns its mark (None without commits)."""
    commit = commits.current(spark, path)
    if commit is None:
        return None
    mark = commits.read_numbered(spark, _marks(path)) or {"number": 0, "generation": 0, "buckets": buckets, "known": [], "since": 0}
    known = {n for a, b in mark["known"] for n in range(a, b + 1)}
    new = [f for f in commit["folders"] if not commits.numbers(f) <= known]
    if not new:
        return mark
    # one row for each new folder: its commit number, FOLDED once it holds several
    of = spark.createDataFrame([(f["date"], f["path"].split("=")[-1], f["of"][0][0] if len(commits.numbers(f)) == 1 else FOLDED)
                                for f in new], f"ts_date string, {commits.BATCH_COLUMN} string, commit_no long")
    of = of.withColumn("ts_date", F.col("ts_date").cast("date"))
    ids = hashed(commits.read_folders(spark, path, new).select("id", "ts_date", commits.BATCH_COLUMN))
    _add(spark, ids.join(F.broadcast(of), ["ts_date", commits.BATCH_COLUMN]).select(*KEYS, "commit_no"), path, mark)
    held = known | {n for f in new for n in commits.numbers(f)}
    mark = mark | {"number": mark["number"] + 1, "known": commits.ranges(held), "since": mark["since"] + 1}
    commits.publish(spark, _marks(path), mark, mark["number"])
    return compact(spark, path) if mark["since"] >= COMPACT_AFTER else mark


def stored(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame | None:
    """(h1, h2) of the ids that other batches have stored; None when nothing is stored."""
    mark = take_in(spark, path)
    if mark is None:
        return None
    commit = commits.current(spark, path)
    void = {n for a, b in commit["removed"] for n in range(a, b + 1)}
    void |= {n for f in commit["folders"] if f["batch"] == batch_id and f["batch"] is not None for n in commits.numbers(f)}
    ids = spark.table(_registered(spark, path, mark))
    return ids.where(~F.col("commit_no").isin(*sorted(void)) if void else F.lit(True)).select(*KEYS)


def unknown(spark: SparkSession, rows: DataFrame, path: str, batch_id: str) -> DataFrame:
    """The rows of a batch whose id no other batch has stored."""
    ids = stored(spark, path, batch_id)
    return rows if ids is None else hashed(rows).join(ids, KEYS, "left_anti").select(*rows.columns)


def compact(spark: SparkSession, path: str) -> dict | None:
    """Rewrite the ledger as one file a bucket, without void commits, and publish it."""
    mark = commits.read_numbered(spark, _marks(path))
    if mark is None:
        return None
    void = [n for a, b in (commits.current(spark, path) or {"removed": []})["removed"] for n in range(a, b + 1)]
    rows = spark.table(_registered(spark, path, mark))
    rows = rows.where(~F.col("commit_no").isin(*void) if void else F.lit(True)).groupBy(*KEYS).agg(F.max("commit_no").alias("commit_no"))
    new = mark | {"number": mark["number"] + 1, "generation": mark["generation"] + 1, "since": 0}
    _add(spark, rows, path, new)
    commits.publish(spark, _marks(path), new, new["number"])
    old, fs = commits.hadoop_path(spark, _place(path, mark["generation"]))
    spark.sql(f"DROP TABLE IF EXISTS {_registered(spark, path, mark)}")
    fs.delete(old, True)
    return new
