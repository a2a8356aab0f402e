"""Which folders of a calls table are visible.

A batch writes its rows to folders of its own (``ts_date=<date>/ingest_batch=<token>``)
and becomes visible by one rename: the next numbered list of visible folders. A
reader lists the folders of one commit, so it sees a batch whole or not at all; a batch
that runs again swaps its old folders for new ones in one commit. Compaction swaps
many folders of a date for one the same way.

A list entry names the folder, its date, the batch (none once compacted) and ``of``,
the ranges of commit numbers whose rows it holds. What is derived from the table (id
ledger, rollups) states the commit numbers it holds and reads only the folders that
hold others. A table has one writer at a time. A folder that left the list is deleted
``KEPT`` commits later, so that readers of those commits can finish.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywatch.schema import CALLS_SCHEMA, conform

FOLDER = "_commits"
KEPT = 8
BATCH_COLUMN = "ingest_batch"
STORED_SCHEMA = T.StructType([*CALLS_SCHEMA.fields, T.StructField(BATCH_COLUMN, T.StringType())])
COMPACT_FILE_ROWS = 2_000_000


def hadoop_path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark._jsc.hadoopConfiguration())


def numbered(spark: SparkSession, folder: str) -> list:
    """The numbered files of a folder, oldest first."""
    pattern, fs = hadoop_path(spark, os.path.join(folder, "*.json"))
    return sorted((f.getPath() for f in fs.globStatus(pattern) or []), key=lambda p: p.getName())


def read_numbered(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """The newest document of a folder (or the one numbered ``number``); None when it is not there."""
    files = numbered(spark, folder)
    if number is not None:
        files = [f for f in files if f.getName() == f"{number:012d}.json"]
    if not files:
        return None
    stream = files[-1].getFileSystem(spark._jsc.hadoopConfiguration()).open(files[-1])
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, document: dict, number: int) -> None:
    """Make ``document`` the one numbered ``number``, whole or not at all."""
    hidden, fs = hadoop_path(spark, os.path.join(folder, f".{uuid.uuid4().hex}"))
    stream = fs.create(hidden)
    stream.write(bytearray(json.dumps(document).encode()))
    stream.close()
    final, _ = hadoop_path(spark, os.path.join(folder, f"{number:012d}.json"))
    if fs.exists(final) or not fs.rename(hidden, final):
        raise RuntimeError(f"{final} was published by another writer")
    for old in numbered(spark, folder)[:-KEPT]:
        fs.delete(old, False)


def token(batch_id: str) -> str:
    """A folder name for any batch id, another one at each call."""
    plain = re.sub(r"[^A-Za-z0-9_.-]", "-", batch_id)[:40]
    return f"{plain}-{hashlib.sha256(batch_id.encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}"


def numbers(entry: dict) -> set[int]:
    return {n for a, b in entry["of"] for n in range(a, b + 1)}


def ranges(some: Iterable[int]) -> list[list[int]]:
    """Ascending ranges that hold just the given numbers."""
    out: list[list[int]] = []
    for n in sorted(set(some)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


def current(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The newest commit of a table; None for a table without commits."""
    return read_numbered(spark, os.path.join(path, FOLDER), number)


def _adopted(spark: SparkSession, path: str) -> dict:
    """The state before the first commit: what plain writes have left in the table."""
    pattern, fs = hadoop_path(spark, os.path.join(path, "ts_date=*", "*"))
    folders = []
    for found in sorted(fs.globStatus(pattern) or [], key=lambda f: str(f.getPath())):
        leaf, date = found.getPath().getName(), found.getPath().getParent().getName()
        if found.isDirectory() and leaf.startswith(f"{BATCH_COLUMN}="):
            folders.append({"path": f"{date}/{leaf}", "date": date.removeprefix("ts_date="), "batch": leaf.split("=", 1)[1],
                            "of": [[len(folders) + 1, len(folders) + 1]]})
        elif not leaf.startswith(("_", ".")):
            raise ValueError(f"{path}/{date}/{leaf} lies in no {BATCH_COLUMN} folder; append cannot take the table over")
    return {"number": len(folders), "folders": folders, "gone": [], "removed": []}


def _swap(spark: SparkSession, path: str, base: dict, out: list[dict], new: list[dict], lost: Iterable[int] = ()) -> dict:
    """Publish ``base`` without the folders ``out`` and with ``new``; ``lost`` commit numbers are void."""
    number = base["number"] + 1
    names = {f["path"] for f in out}
    gone = base["gone"] + [[name, number] for name in sorted(names)]
    old = [g for g in gone if g[1] <= number - KEPT]
    commit = {"number": number, "folders": [f for f in base["folders"] if f["path"] not in names] + new,
              "gone": [g for g in gone if g[1] > number - KEPT], "removed": ranges(numbers({"of": base["removed"]}) | set(lost))}
    publish(spark, os.path.join(path, FOLDER), commit, number)
    for name, _ in old:
        folder, fs = hadoop_path(spark, os.path.join(path, name))
        fs.delete(folder, True)
    return commit


def write_folders(rows: DataFrame, path: str, name: str) -> list[str]:
    """Write ``rows`` as folders named ``name`` under their dates; returns the dates."""
    dates = [r[0].isoformat() for r in rows.select("ts_date").distinct().collect()]
    out = rows.withColumn(BATCH_COLUMN, F.lit(name))
    # rebalance: cluster by date, but let AQE split a date holding most of
    # the rows into several right-sized tasks instead of one
    (out.hint("rebalance", "ts_date").sortWithinPartitions("project", "ts")
     .write.mode("append").partitionBy("ts_date", BATCH_COLUMN).parquet(path))
    return dates


def commit_batch(spark: SparkSession, rows: DataFrame, path: str, batch_id: str) -> dict:
    """Write a batch and make it visible in place of whatever the same batch stored before."""
    base = current(spark, path) or _adopted(spark, path)
    own = [f for f in base["folders"] if f["batch"] == batch_id]
    name, number = token(batch_id), base["number"] + 1
    new = [{"path": f"ts_date={d}/{BATCH_COLUMN}={name}", "date": d, "batch": batch_id, "of": [[number, number]]}
           for d in write_folders(rows, path, name)]
    return _swap(spark, path, base, own, new, {n for f in own for n in numbers(f)})


def read_folders(spark: SparkSession, path: str, folders: list[dict]) -> DataFrame:
    """Rows of some folders of a table, with their batch folder's name."""
    if not folders:
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).option("basePath", path).parquet(*[os.path.join(path, f["path"]) for f in folders])


def read(spark: SparkSession, path: str, commit: dict) -> DataFrame:
    """The calls of one commit; which one travels as metadata of ``ts``."""
    rows = conform(read_folders(spark, path, commit["folders"]))
    ts = F.col("ts").alias("ts", metadata={"snapshot": json.dumps({"calls": path, "number": commit["number"]})})
    return rows.select(*[ts if f.name == "ts" else F.col(f.name) for f in CALLS_SCHEMA.fields])


def snapshot(calls: DataFrame) -> dict | None:
    """The table and commit number that ``calls`` was read at, if :func:`read` read it."""
    held = calls.schema["ts"].metadata.get("snapshot") if "ts" in calls.columns else None
    return None if held is None else json.loads(held)


def compact(spark: SparkSession, path: str, dates: Iterable[str], file_rows: int = COMPACT_FILE_ROWS) -> dict:
    """Rewrite dates that hold several folders as one each, clustered by (project, ts).

    Rows are dealt by range of (project, ts) to files of about ``file_rows`` rows, so a
    project's rows stand in few files and row groups. The new folders replace the
    old in one commit; no answer changes. Meant for dates that no longer grow.
    """
    base = current(spark, path) or _adopted(spark, path)
    wanted = set(dates)
    by_date: dict[str, list[dict]] = {}
    for f in base["folders"]:
        if f["date"] in wanted:
            by_date.setdefault(f["date"], []).append(f)
    out = [f for found in by_date.values() if len(found) > 1 for f in found]
    if not out:
        return base
    rows = read_folders(spark, path, out)
    files = -(-rows.count() // file_rows)
    name = token("compacted")
    clustered = rows.repartitionByRange(max(1, files), "ts_date", "project", "ts").sortWithinPartitions("ts_date", "project", "ts")
    (clustered.withColumn(BATCH_COLUMN, F.lit(name)).write.mode("append").partitionBy("ts_date", BATCH_COLUMN).parquet(path))
    new = [{"path": f"ts_date={d}/{BATCH_COLUMN}={name}", "date": d, "batch": None,
            "of": ranges({n for f in found for n in numbers(f)})} for d, found in by_date.items() if len(found) > 1]
    return _swap(spark, path, base, out, new)
