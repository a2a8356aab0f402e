"""R: the additive 300-second rollup, exact window reads, late-data rebuild.

The rollup holds one row per (300 s bucket, project, serving provider, model)
with the additive measures of :mod:`relaywatch.operators.partials`. Every
bucket width of the dashboard (300, 3600, 21600, 86400 s) is a multiple of
300 s, so the rollup serves every window and every aggregate operator
(A1-A10; drift through its evidence sums), and its size grows with buckets x
key combinations, not with calls. A second, attempts rollup (bucket, project,
serving provider, attempted provider) serves provider health over every call
of a window (A11 without the recency sample, D4).

**Exact edges.** A window ``(start, end]`` is generally not bucket aligned.
Buckets lying wholly inside it are read from the rollup; the two partial edge
spans are read from the raw table (a few minutes of rows, pruned to their
dates) and turned into measures rows. Because the money measures are DECIMAL
sums, rollup-plus-edges equals the raw plan exactly.

**A stored rollup that lags.** :func:`refresh` keeps a mark in the rollup's
``_complete`` folder: the calls table it was built from, ``until`` (buckets
that end later are not in it), and for each date the file count and bytes of
the calls that were rolled up. :func:`read` hands the mark on with the frame.
A window takes from the rollup only the buckets before ``until`` on dates whose
calls are still those that were rolled up; the rest it reads raw. A rollup
without a mark (built by the caller) counts as complete.

**Deltas, for a table with commits** (:mod:`relaywatch.sources.commits`).
:func:`add_deltas` reads only the folders whose commits the rollup does not hold and
adds their rows as a delta of their own; readers sum the deltas, so the current date is
served from the rollup while it grows. Each delta states the commit numbers it holds.
A reader takes the deltas that hold only rows its own snapshot of the calls shows,
and reads raw just the folders that no such delta covers. A replayed commit is
known already; a replaced or rewritten batch has a new number, which makes the deltas that
held the old one void. :func:`merge_deltas` folds the deltas of a date into one.

**Tiers.** A folded delta is kept at an hour and at a day as well. A window's whole buckets
are covered exactly by the widest spans that fit (:func:`cover`): days, then hours at both
ends, then 300 s buckets, then the raw edges. A width is used only where it divides the
bucket width of the window, so a series finds each row in its own bucket. A 30-day read thus
takes one row a day and key, however many calls or 300 s buckets the days hold.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaywatch.functions import windows as W
from relaywatch.functions.keys import attempt_provider
from relaywatch.operators import partials as P
from relaywatch.sources import commits, sink
from relaywatch.sources.calls import read_calls, scope_filter

GRAIN = 300
DAY = 86400
TIERS = [3600, DAY]     # wider widths of folded deltas, each a multiple of the one before
TIER_FOLDER = "_tiers"
MARKS = "_complete"
MARKS_KEPT = 8          # older marks stay a while for readers that just listed them
GROUP = ["project", "provider_key", "model_key"]


def build(calls: DataFrame) -> DataFrame:
    """Aggregate calls into rollup rows (partial then final aggregation).

    The group key includes the 300 s bucket, so a project holding a third of
    all calls still spreads over its buckets x providers x models; partial
    aggregation shrinks every task's rows before the shuffle.
    """
    m = P.row_measures(calls).withColumn("t0", F.col("t0") - F.pmod(F.col("t0"), F.lit(GRAIN)))
    agg = m.groupBy("t0", *GROUP).agg(*P.sums())
    return agg.withColumn("ts_date", F.to_date(F.timestamp_seconds(F.col("t0"))))


def write(rollup: DataFrame, path: str) -> None:
    """Write (or rewrite) the rollup's dates.

    Dynamic partition overwrite replaces exactly the ``ts_date`` partitions
    present in ``rollup``, so rebuilding a date range (T3) or re-running a
    failed job is idempotent.
    """
    (rollup.hint("rebalance", "ts_date").sortWithinPartitions("t0", *GROUP)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ts_date").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored rollup; its mark, if it has one, travels as metadata of ``t0``."""
    mark = read_mark(spark, path)
    if mark is None:
        return spark.read.parquet(path)
    if "deltas" in mark:
        return _read_deltas(spark, path, mark)
    out = spark.read.schema(T.StructType.fromJson(mark.pop("schema"))).parquet(path)
    t0 = F.col("t0").alias("t0", metadata={"mark": json.dumps(mark)})
    return out.select(*[t0 if c == "t0" else F.col(c) for c in out.columns])


def _mark_files(spark: SparkSession, path: str) -> list:
    pattern, fs = sink._path(spark, os.path.join(path, MARKS, "*.json"))
    return sorted((f.getPath() for f in fs.globStatus(pattern) or []), key=lambda p: p.getName())


def read_mark(spark: SparkSession, path: str) -> dict | None:
    """The newest mark of a rollup; None when it has none."""
    files = _mark_files(spark, path)
    if not files:
        return None
    stream = files[-1].getFileSystem(spark._jsc.hadoopConfiguration()).open(files[-1])
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, mark: dict) -> None:
    """Make ``mark`` the newest one, whole or not at all (one writer at a time)."""
    files = _mark_files(spark, path)
    number = int(files[-1].getName().removesuffix(".json")) + 1 if files else 0
    hidden, fs = sink._path(spark, os.path.join(path, MARKS, f".{uuid.uuid4().hex}"))
    stream = fs.create(hidden)
    stream.write(bytearray(json.dumps(mark).encode()))
    stream.close()
    final, _ = sink._path(spark, os.path.join(path, MARKS, f"{number:012d}.json"))
    if not fs.rename(hidden, final):
        raise RuntimeError(f"could not publish {final}")
    for old in files[:-MARKS_KEPT]:
        fs.delete(old, False)


def _listed(spark: SparkSession, table_path: str, date: str) -> list[int] | None:
    """[files, bytes] of one date of the calls table; None when it has no files."""
    folder, fs = sink._path(spark, os.path.join(table_path, f"ts_date={date}"))
    if not fs.exists(folder):
        return None
    found = fs.getContentSummary(folder)
    return [found.getFileCount(), found.getLength()] if found.getFileCount() else None


def _all_listed(spark: SparkSession, table_path: str) -> dict[str, list[int]]:
    pattern, fs = sink._path(spark, os.path.join(table_path, "ts_date=*"))
    dates = [f.getPath().getName().removeprefix("ts_date=") for f in fs.globStatus(pattern) or []]
    return {d: n for d in dates if (n := _listed(spark, table_path, d)) is not None}


def _rewrite(spark: SparkSession, path: str, mark: dict, dates: dict[str, list[int]], write_dates: Callable[[], None]) -> None:
    """Write the rollup of ``dates`` while the mark sends readers of them to the raw table."""
    _publish(spark, path, mark | {"dates": mark["dates"] | {d: "being written" for d in dates}})
    for d in dates:
        folder, fs = sink._path(spark, os.path.join(path, f"ts_date={d}"))
        fs.delete(folder, True)
    write_dates()
    _publish(spark, path, mark | {"dates": mark["dates"] | dates})


def _day(epoch: int) -> str:
    return dt.datetime.fromtimestamp(epoch, W.UTC).date().isoformat()


def _on(dates: Iterable[str]) -> Column:
    return F.col("ts_date").isin(*[dt.date.fromisoformat(d) for d in sorted(dates)])


def refresh(spark: SparkSession, table_path: str, path: str, attempts: bool = False,
            touched: Iterable[str] = (), lag: str = "10 minutes") -> None:
    """Bring a stored rollup up to the calls table, date by date.

    Recomputed are the ``touched`` dates, every date whose files are not those
    last rolled up, and the dates of buckets that closed since. Recomputing
    gives the same rows however often it runs, and late rows only make their
    date one to recompute. Buckets that end within ``lag`` of the newest call
    stay out: more rows are likely to follow.
    """
    listed = _all_listed(spark, table_path)
    if not listed:
        return
    mark = read_mark(spark, path)
    if mark is None or mark["calls"] != table_path:
        mark = {"calls": table_path, "until": None, "dates": {}}
    calls = read_calls(spark, table_path)
    newest = calls.where(_on([max(listed)])).agg(F.unix_seconds(F.max("ts") - F.expr(f"interval {lag}"))).first()[0]
    before = mark["until"]
    if newest is None:
        return
    until = max(newest - newest % GRAIN, newest - newest % GRAIN if before is None else before)
    closed = set() if before is None else {d for d in listed if _day(before) <= d <= _day(until) and until > before}
    stale = {d for d, n in listed.items() if mark["dates"].get(d) != n}
    dates = {d: listed[d] for d in sorted(stale | closed | (set(touched) & set(listed)))}
    if not dates:
        return
    rows = calls.where(_on(dates) & (F.col("ts") < F.timestamp_seconds(F.lit(until))))
    out = build_attempts(rows) if attempts else build(rows)
    _rewrite(spark, path, mark | {"until": until, "schema": out.schema.jsonValue()}, dates,
             lambda: write_attempts(out, path) if attempts else write(out, path))


def rebuild_dates(calls: DataFrame, path: str, dates: list[dt.date],
                  attempts_path: str | None = None) -> None:
    """Recompute the rollup (and the attempts rollup) for the given dates
    from the raw table.

    Used after a bulk load with explicit old timestamps. A rollup kept by a
    stream sends readers of such dates to the raw table until then.
    """
    if not dates:
        return
    spark = calls.sparkSession
    for to, attempts in ((path, False), (attempts_path, True)):
        mark = None if to is None else read_mark(spark, to)
        if mark is not None and "deltas" in mark:
            add_deltas(spark, mark["calls"], to, attempts)
    touched = calls.where(F.col("ts_date").isin(*dates))
    for to, make, put in ((path, build, write), (attempts_path, build_attempts, write_attempts)):
        mark = None if to is None else read_mark(spark, to)
        if mark is not None and "deltas" in mark:
            continue
        if mark is not None:
            listed = {d.isoformat(): _listed(spark, mark["calls"], d.isoformat()) for d in dates}
            rows = touched.where(F.col("ts") < F.timestamp_seconds(F.lit(mark["until"])))
            _rewrite(spark, to, mark, listed, lambda: put(make(rows), to))
        elif to is not None:
            put(make(touched), to)


def _covered(folders: list[dict], deltas: list[dict]) -> tuple[list[dict], list[dict]]:
    """(deltas to read, folders to read raw) that together hold every folder's rows once.

    A delta counts if the folders show all commits it holds; a folder is raw unless such
    deltas hold all of its commits, and then no delta that shares a commit with it counts.
    """
    use, raw = [], []
    for date in {f["date"] for f in folders}:
        here = [(f, commits.numbers(f)) for f in folders if f["date"] == date]
        shown = set().union(*(n for _, n in here))
        good = [(d, n) for d in deltas if d["date"] == date and (n := commits.numbers(d)) <= shown]
        while True:
            held = set().union(*(n for _, n in good))
            rest = [(f, n) for f, n in here if not n <= held]
            loose = set().union(*(n for _, n in rest))
            kept = [(d, n) for d, n in good if not n & loose]
            if len(kept) == len(good):
                break
            good = kept
        use += [d for d, _ in good]
        raw += [f for f, _ in rest]
    return use, raw


def cover(lo: int, hi: int, widths: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Spans by width that fill ``[lo, hi)`` once, each aligned to its width.

    ``widths`` go from wide to narrow, each a multiple of the next; ``lo`` and ``hi`` are
    multiples of the narrowest. Every width but the widest used has at most one span at each end.
    """
    if lo >= hi:
        return {}
    width, *narrower = widths
    first, last_end = -(-lo // width) * width, hi // width * width
    if first >= last_end:
        return cover(lo, hi, narrower)
    out = {width: [(first, last_end)]}
    for end in (cover(lo, first, narrower), cover(last_end, hi, narrower)):
        for w, spans in end.items():
            out[w] = out.get(w, []) + spans
    return out


def _tier(path: str, width: int) -> str:
    """The folder that holds a rollup's deltas at ``width``."""
    return path if width == GRAIN else os.path.join(path, TIER_FOLDER, str(width))


def _write_deltas(out: DataFrame, path: str, name: str) -> None:
    (out.withColumn("part", F.lit(name)).hint("rebalance", "ts_date").sortWithinPartitions("t0")
     .write.mode("append").partitionBy("ts_date", "part").parquet(path))


def _publish_deltas(spark: SparkSession, path: str, mark: dict, dropped: list[dict]) -> None:
    """The next mark; the folders of deltas dropped ``KEPT`` marks ago are deleted."""
    number = mark["number"] + 1
    gone = mark["gone"] + [[os.path.join(_tier("", w), d["path"]), number]
                           for d in dropped for w in (GRAIN, *d.get("tiers", []))]
    commits.publish(spark, os.path.join(path, MARKS), mark | {"number": number, "gone": [g for g in gone if g[1] > number - commits.KEPT]}, number)
    for name, since in gone:
        if since <= number - commits.KEPT:
            folder, fs = commits.hadoop_path(spark, os.path.join(path, name))
            fs.delete(folder, True)


def add_deltas(spark: SparkSession, table_path: str, path: str, attempts: bool = False) -> list[dict]:
    """Add to a rollup the rows of the commits it does not hold; returns the folders read.

    Only those folders are read. A run that fails before it publishes leaves files
    that no mark names; a run that finds nothing new writes nothing.
    """
    commit = commits.current(spark, table_path)
    if commit is None:
        raise ValueError(f"{table_path} has no commits")
    mark = read_mark(spark, path)
    if mark is None or mark["calls"] != table_path or "deltas" not in mark:
        number = -1 if mark is None else max(int(f.getName().removesuffix(".json")) for f in _mark_files(spark, path))
        mark = {"calls": table_path, "number": number, "deltas": [], "gone": []}
    good, new = _covered(commit["folders"], mark["deltas"])
    dropped = [d for d in mark["deltas"] if d not in good]
    if not new and not dropped:
        return []
    make = build_attempts if attempts else build
    out = make(commits.read(spark, table_path, commit | {"folders": new}))
    name = uuid.uuid4().hex
    added = []
    if new:
        _write_deltas(out, path, name)
        for date in sorted({f["date"] for f in new}):
            held = {n for f in new if f["date"] == date for n in commits.numbers(f)}
            added.append({"path": f"ts_date={date}/part={name}", "date": date, "of": commits.ranges(held)})
    _publish_deltas(spark, path, mark | {"schema": out.schema.jsonValue(), "deltas": good + added}, dropped)
    return new


def merge_deltas(spark: SparkSession, path: str, dates: Iterable[str]) -> None:
    """Fold the deltas of each of ``dates`` into one and keep it in every tier too.

    For closed dates: a date that grows again has another delta beside the folded one,
    read at 300 s, until it is folded anew. A date that is folded already is left alone.
    """
    mark, wanted = read_mark(spark, path), set(dates)
    if mark is None or "deltas" not in mark:
        return
    of = {day: [d for d in mark["deltas"] if d["date"] == day] for day in wanted}
    days = sorted(day for day, held in of.items() if len(held) > 1 or any("tiers" not in d for d in held))
    old = [d for day in days for d in of[day]]
    if not old:
        return
    name = uuid.uuid4().hex
    new = [{"path": f"ts_date={day}/part={name}", "date": day, "tiers": TIERS,
            "of": commits.ranges({n for d in of[day] for n in commits.numbers(d)})} for day in days]
    _write_deltas(_folded(_delta_rows(spark, path, mark, old), mark, GRAIN), path, name)
    for below, width in zip([GRAIN, *TIERS], TIERS):
        _write_deltas(_folded(_delta_rows(spark, path, mark, new, below), mark, width), _tier(path, width), name)
    _publish_deltas(spark, path, mark | {"deltas": [d for d in mark["deltas"] if d not in old] + new}, old)


def _folded(rows: DataFrame, mark: dict, width: int) -> DataFrame:
    """Rollup rows summed to buckets of ``width``, in the rollup's own types."""
    keys = [c for c in rows.columns if c in ("t0", "ts_date", *GROUP, *ATTEMPT_GROUP)]
    sums = P.sums() if "calls" in rows.columns else [F.sum(c).alias(c) for c in ATTEMPT_MEASURES]
    wider = rows.withColumn("t0", F.col("t0") - F.pmod("t0", F.lit(width)))
    return _cast(wider.groupBy(*keys).agg(*sums), T.StructType.fromJson(mark["schema"]))


def _delta_rows(spark: SparkSession, path: str, mark: dict, deltas: list[dict], width: int = GRAIN) -> DataFrame:
    schema = T.StructType.fromJson(mark["schema"])
    if not deltas:
        return spark.createDataFrame([], schema)
    base = _tier(path, width)
    return spark.read.schema(schema).option("basePath", base).parquet(*[os.path.join(base, d["path"]) for d in deltas])


def _inside(spans: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for lo, hi in spans:
        out = out | ((F.col("t0") >= F.lit(lo)) & (F.col("t0") < F.lit(hi)))
    return out


def _spanned(spark: SparkSession, path: str, mark: dict, deltas: list[dict], first: int, last_end: int,
             bucket_seconds: int) -> DataFrame:
    """Rows of ``deltas`` for the buckets in ``[first, last_end)``.

    Folded deltas give the widest tiers that fit the span and divide ``bucket_seconds``; the others
    give 300 s rows. Deltas hold different calls, so each may be read at widths of its own.
    """
    single = [d for d in deltas if "tiers" not in d]
    parts = [(GRAIN, single, [(first, last_end)])] if single else []
    widths = [w for w in reversed(TIERS) if bucket_seconds % w == 0]
    for width, spans in cover(first, last_end, [*widths, GRAIN]).items():
        here = [d for d in deltas if "tiers" in d and any(_day(lo) <= d["date"] <= _day(hi - 1) for lo, hi in spans)]
        parts += [(width, here, spans)] if here else []
    if not parts:
        return _delta_rows(spark, path, mark, [])
    rows = [_delta_rows(spark, path, mark, held, width).where(_inside(spans)) for width, held, spans in parts]
    return reduce(DataFrame.unionByName, [r.select(*rows[0].columns) for r in rows])


def _read_deltas(spark: SparkSession, path: str, mark: dict) -> DataFrame:
    """All deltas of a mark; which mark travels as metadata of ``t0``."""
    out = _delta_rows(spark, path, mark, mark["deltas"])
    t0 = F.col("t0").alias("t0", metadata={"mark": json.dumps({"deltas_of": path, "number": mark["number"]})})
    return out.select(*[t0 if c == "t0" else F.col(c) for c in out.columns])


def _delta_parts(calls: DataFrame, rollup: DataFrame, held: dict, rng: W.TimeRange,
                 scope: Column) -> tuple[DataFrame | None, DataFrame]:
    """(rollup rows, raw calls) of a window: deltas the calls' snapshot shows, and the folders they lack.

    The folders' raw rows are read by their own list, only on the dates of the window.
    """
    spark, seen = calls.sparkSession, commits.snapshot(calls)
    mark = commits.read_numbered(spark, os.path.join(held["deltas_of"], MARKS), held["number"])
    commit = None if seen is None else commits.current(spark, seen["calls"], seen["number"])
    first, last_end = _edges(rng.start, rng.end)
    if first >= last_end or mark is None or commit is None or mark["calls"] != seen["calls"]:
        return None, calls.where(rng.predicate() & scope)
    days = {_day(first), _day(last_end - 1)}
    inside = [f for f in commit["folders"] if min(days) <= f["date"] <= max(days)]
    use, raw = _covered(inside, mark["deltas"])
    lo, hi = (dt.datetime.fromtimestamp(t, W.UTC) for t in (first, last_end))
    rest = calls.where((_edge_rows(calls, rng.start, False, lo, False) | _edge_rows(calls, hi, True, rng.end, True)) & scope)
    if raw:
        rows = commits.read(spark, seen["calls"], commit | {"folders": raw})
        rest = rest.unionByName(rows.where(_edge_rows(rows, lo, True, hi, False) & scope).select(*rest.columns))
    return _spanned(spark, held["deltas_of"], mark, use, first, last_end, rng.bucket_seconds).where(scope), rest


def _edges(start: dt.datetime, end: dt.datetime) -> tuple[int, int]:
    """(first interior bucket, end of the last interior bucket), epochs."""
    first = (int(start.timestamp()) // GRAIN) * GRAIN + GRAIN
    last_end = (int(end.timestamp()) // GRAIN) * GRAIN
    return first, last_end


def _edge_rows(calls: DataFrame, lo: dt.datetime, lo_incl: bool, hi: dt.datetime, hi_incl: bool) -> Column:
    ts = F.col("ts")
    c = (ts >= F.lit(lo)) if lo_incl else (ts > F.lit(lo))
    c = c & ((ts <= F.lit(hi)) if hi_incl else (ts < F.lit(hi)))
    return c & (F.col("ts_date") >= F.lit(lo.date())) & (F.col("ts_date") <= F.lit(hi.date()))


def _rolled(calls: DataFrame, rollup: DataFrame, first: int, last_end: int) -> list[tuple[int, int]]:
    """Spans of whole buckets in [first, last_end) that the rollup answers for."""
    mark = rollup.schema["t0"].metadata.get("mark")
    if mark is None:
        return [(first, last_end)] if first < last_end else []
    mark = json.loads(mark)
    spans: list[tuple[int, int]] = []
    end = min(last_end, mark["until"])
    for day in range(first - first % DAY, end, DAY):
        lo, hi = max(first, day), min(end, day + DAY)
        if mark["dates"].get(_day(day)) != _listed(calls.sparkSession, mark["calls"], _day(day)):
            continue
        if spans and spans[-1][1] == lo:
            spans[-1] = (spans[-1][0], hi)
        else:
            spans.append((lo, hi))
    return spans


def _parts(calls: DataFrame, rollup: DataFrame, rng: W.TimeRange,
           scope: Column) -> tuple[DataFrame | None, DataFrame]:
    """(rollup rows of whole buckets, raw calls of the rest of the window).

    The rest is the two partial edge spans and whatever the rollup does not
    hold yet. A window shorter than two buckets is all raw.
    """
    held = json.loads(rollup.schema["t0"].metadata.get("mark", "{}"))
    if "deltas_of" in held:
        return _delta_parts(calls, rollup, held, rng, scope)
    spans = _rolled(calls, rollup, *_edges(rng.start, rng.end))
    if not spans:
        return None, calls.where(rng.predicate() & scope)
    bounds = [(dt.datetime.fromtimestamp(lo, W.UTC), dt.datetime.fromtimestamp(hi, W.UTC)) for lo, hi in spans]
    interior = rollup.where(
        (F.col("ts_date") >= F.lit(bounds[0][0].date())) & (F.col("ts_date") <= F.lit(bounds[-1][1].date()))
        & _inside(spans) & scope)
    rest = _edge_rows(calls, rng.start, False, bounds[0][0], False)
    for (_, lo), (hi, _) in zip(bounds, bounds[1:]):
        rest = rest | _edge_rows(calls, lo, True, hi, False)
    rest = rest | _edge_rows(calls, bounds[-1][1], True, rng.end, True)
    return interior, calls.where(rest & scope)


def measures(calls: DataFrame, rollup: DataFrame, rng: W.TimeRange,
             project: str | None = None, provider: str | None = None) -> DataFrame:
    """A measures frame covering exactly ``rng`` and the scope.

    Buckets the rollup holds come from it, the rest of the window (the partial
    buckets at both ends at least) from the raw table; the union has the rollup's column types.
    """
    schema = rollup.select("t0", *GROUP, *P.MEASURES, "modality").schema
    interior, edge = _parts(calls, rollup, rng, scope_filter(project, provider))
    raw = _cast(P.row_measures(edge), schema)
    return raw if interior is None else _cast(interior, schema).unionByName(raw)


# The attempts rollup (A11 at scale): one row per (300 s bucket, project,
# serving provider, attempted provider) with attempt and fail counts. The
# first two keys keep the dashboard's scope filters; the size grows with
# buckets x key combinations, not with calls or attempts.
ATTEMPT_GROUP = ["project", "provider_key", "attempt_provider"]
ATTEMPT_MEASURES = ["attempts", "fails"]


def attempt_rows(calls: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per attempt: ``t0`` (epoch second), keys, attempts 1, fails 0/1.

    A fail is ``ok`` equal to false exactly (A11); X3 names the provider.
    """
    a = calls.select(*extra, "project", "provider_key", F.unix_seconds(F.col("ts")).alias("t0"),
                     F.explode("attempts").alias("a"))
    return a.select(*extra, "t0", "project", "provider_key",
                    attempt_provider(F.col("a.provider")).alias("attempt_provider"),
                    F.lit(1).cast("bigint").alias("attempts"),
                    F.when(F.col("a.ok") == F.lit(False), F.lit(1)).otherwise(F.lit(0))
                    .cast("bigint").alias("fails"))


def build_attempts(calls: DataFrame) -> DataFrame:
    """Aggregate every attempt into attempts-rollup rows (partial then final)."""
    r = attempt_rows(calls).withColumn("t0", F.col("t0") - F.pmod(F.col("t0"), F.lit(GRAIN)))
    agg = r.groupBy("t0", *ATTEMPT_GROUP).agg(*[F.sum(c).alias(c) for c in ATTEMPT_MEASURES])
    return agg.withColumn("ts_date", F.to_date(F.timestamp_seconds(F.col("t0"))))


def write_attempts(rollup: DataFrame, path: str) -> None:
    """Write (or rewrite) dates of the attempts rollup, as :func:`write`."""
    (rollup.hint("rebalance", "ts_date").sortWithinPartitions("t0", *ATTEMPT_GROUP)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ts_date").parquet(path))


def attempt_measures(calls: DataFrame, attempts_rollup: DataFrame, rng: W.TimeRange,
                     project: str | None = None, provider: str | None = None) -> DataFrame:
    """Attempt counts covering exactly ``rng`` and the scope (every call).

    Same split as :func:`measures`: whole buckets from the attempts rollup,
    the edge spans exploded from the raw table.
    """
    cols = ["t0", *ATTEMPT_GROUP, *ATTEMPT_MEASURES]
    interior, edge = _parts(calls, attempts_rollup, rng, scope_filter(project, provider))
    raw = attempt_rows(edge).select(*cols)
    return raw if interior is None else interior.select(*cols).unionByName(raw)


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
