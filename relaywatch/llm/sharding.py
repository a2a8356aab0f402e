"""Sharding by histogram sort: shards of near equal bytes, in key order.

Rows are ordered by a key: hash of the text, then doc_id (null first), then the row's
place in a written table, which tells repeated rows apart. Equal texts so stand
together. The ``shards - 1`` splitters are found without moving a row: the
driver proposes boundaries between keys, the tasks count the exact bytes and rows
between them (and the least and largest key that occurs there), and every span that
still holds a splitter is probed again, ``PROBES`` boundaries to a span. After that
the rows are exchanged once, each to its place.

A splitter lies at the row boundary whose bytes before it are nearest to the shard's
due share. If that is inside a group of equal texts, it goes to the nearer end of the
group when that is within ``tolerance`` of a shard's size; a larger group is
cut. Both depend on the rows alone, not on partitions or probes.

Spans of more rows than a task should sort are probed on as well, so the exchange
deals by (shard, span) and a shard is many tasks; a group of equal texts that holds a
third of all rows is many spans. Rows below each boundary are known exactly,
so a row's slot is its place in its span plus a constant. The driver holds
boundaries and counts, a few for each task.

Defined results: null text has no bytes; a row's size is its bytes plus 1. Repeated
rows are rows of their own. An empty table gives an empty result. Fewer rows than
shards leave shards empty. Of the input's columns those named shard, slot, size or
text_crc32 give way to the operator's.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm.common import Scratch

SHARDS, TOLERANCE = 16, 0.005
PROBES = 64              # boundaries proposed in a span
TASK_ROWS = 1 << 18      # rows that a task sorts, at most while keys tell them apart
TEXT = 1 << 192          # keys of one text differ below this
END = 1 << 256
RESULT = ["size", "text_crc32", "shard", "slot"]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """32 sortable bytes of each row: hash, doc_id known, doc_id, place."""
    known = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
    whole = np.empty((batch.num_rows, 4), ">u8")
    top = np.uint64(1 << 63)
    whole[:, 0] = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ top
    whole[:, 1] = known
    whole[:, 2] = np.where(known, batch.column("doc").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ top, 0)
    whole[:, 3] = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return whole.view("S32").ravel()


def _sorted_bytes(boundaries: list[int]) -> np.ndarray:
    return np.array([b.to_bytes(32, "big") for b in boundaries], "S32")


def _count(batches: Iterator[pa.RecordBatch], probes) -> Iterator[pa.RecordBatch]:
    """Rows and weight of this task in each open span, with its least and largest key."""
    edges, is_open = probes.value
    edges = _sorted_bytes(edges)
    rows, weight = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
    low, high = {}, {}
    for batch in batches:
        keys = _keys(batch)
        span = np.searchsorted(edges, keys, side="right") - 1
        held = is_open[span]
        keys, span = keys[held], span[held]
        order = np.lexsort((keys, span))
        keys, span = keys[order], span[order]
        spans, first = np.unique(span, return_index=True)
        last = np.r_[first[1:], len(span)] - 1
        rows += np.bincount(span, minlength=len(edges))
        np.add.at(weight, span, batch.column("weight").to_numpy(zero_copy_only=False)[held][order])
        for s, a, b in zip(spans.tolist(), first, last):
            least, most = bytes(keys[a]).ljust(32, b"\0"), bytes(keys[b]).ljust(32, b"\0")
            low[s], high[s] = min(least, low.get(s, least)), max(most, high.get(s, most))
    at = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([
        pa.array(at, pa.int32()), pa.array(rows[at]), pa.array(weight[at]), pa.array([low[s] for s in at.tolist()], pa.binary()),
        pa.array([high[s] for s in at.tolist()], pa.binary())], names=["span", "n", "weight", "low", "high"])


class Histogram:
    """Boundaries with the exact rows and weight below them, and what is known of the spans between."""

    def __init__(self, shards: int, tolerance: float, most_rows: int, rows: int, weight: int, low: int, high: int):
        self.shards, self.most_rows, self.rows, self.weight = shards, most_rows, rows, weight
        self.slack = tolerance * weight / shards
        self.edges, self.below = [0, END], {0: (0, 0), END: (rows, weight)}
        self.keys = {0: (low, high)}            # least and largest key of the span that starts here

    def span_at(self, shard: int) -> int:
        """Start of the span in which the weight before reaches what is due to the shards below ``shard``."""
        lo, hi = 0, len(self.edges) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.below[self.edges[mid]][1] * self.shards >= shard * self.weight else (mid, hi)
        return self.edges[lo]

    def after(self, edge: int) -> int:
        return self.edges[bisect_right(self.edges, edge)]

    def snapped(self, shard: int, edge: int) -> int | None:
        """The end of the group of equal texts around a span that is near enough, if any."""
        low, high = self.keys[edge]
        start = low // TEXT * TEXT
        stop = min(start + TEXT, END)
        if high // TEXT * TEXT != start or start not in self.below or stop not in self.below:
            return None
        due = shard * self.weight / self.shards
        away, end = min((abs(self.below[e][1] - due), e) for e in (start, stop))
        return end if away <= self.slack else None

    def splitter(self, shard: int) -> int | None:
        """The boundary where ``shard`` begins, once it is settled."""
        edge = self.span_at(shard)
        low, high = self.keys[edge]
        end = self.snapped(shard, edge)
        if end is not None:
            return end
        if low == high and low // TEXT * TEXT in self.below and min(low // TEXT * TEXT + TEXT, END) in self.below:
            due, (before, after) = shard * self.weight / self.shards, (edge, self.after(edge))
            return before if due - self.below[before][1] <= self.below[after][1] - due else after
        return None

    def wanted(self) -> list[int]:
        """Spans to probe: those with a splitter to settle or with too many rows."""
        out = {self.span_at(s) for s in range(1, self.shards) if self.splitter(s) is None}
        for a, b in zip(self.edges, self.edges[1:]):
            if self.below[b][0] - self.below[a][0] > self.most_rows and self.keys[a][0] < self.keys[a][1]:
                out.add(a)
        return sorted(out)

    def probes(self, edge: int, many: int) -> list[int]:
        """New boundaries in a span: between texts while it holds several, then inside the one."""
        low, high = self.keys[edge]
        start, end = edge, self.after(edge)
        if low // TEXT != high // TEXT:
            some = {(low + (high - low) * k // many) // TEXT * TEXT for k in range(1, many)} | {high // TEXT * TEXT}
        else:
            some = {low // TEXT * TEXT, low // TEXT * TEXT + TEXT}
            if some <= self.below.keys():
                some = {low + (high - low) * k // many + 1 for k in range(many)} | {high}
        return sorted(b for b in some if start < b < end and b not in self.below)

    def learn(self, edges: list[int], found: dict[int, tuple[int, int, int, int]], opened: list[int]) -> None:
        """Counts of the spans between ``edges`` inside the ``opened`` spans."""
        known = set(opened)
        rows = weight = 0
        inside = False
        for edge in edges:
            if edge in self.below:
                rows, weight = self.below[edge]
                inside = edge in known
            else:
                self.below[edge] = (rows, weight)
            if inside and edge != END:
                n, w, low, high = found.get(edge, (0, 0, edge, edge))
                self.keys[edge] = (low, high)
                rows, weight = rows + n, weight + w
        self.edges = sorted(self.below)


def _histogram(rows: DataFrame, shards: int, tolerance: float, parts: int) -> Histogram | None:
    """Probe until every splitter is settled and no span has more rows than a task should sort."""
    spark = rows.sparkSession
    keyed = rows.select("hash", "doc", "place", "weight")

    def counted(edges: list[int], opened: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        shared = spark.sparkContext.broadcast((edges, opened))
        sums = keyed.mapInArrow(partial(_count, probes=shared), "span int, n long, weight long, low binary, high binary").groupBy(
            "span").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
        return {edges[r["span"]]: (r["n"], r["weight"], int.from_bytes(r["low"], "big"), int.from_bytes(r["high"], "big"))
                for r in sums.collect()}

    whole = counted([0], np.array([True])).get(0)
    if whole is None:
        return None
    n, weight, low, high = whole
    parts = max(parts, -(-n // TASK_ROWS))
    hist = Histogram(shards, tolerance, -(-n // parts), n, weight, low, high)
    many = max(PROBES, 4 * parts)
    while opened := hist.wanted():
        new = [b for e in opened for b in hist.probes(e, many)]
        edges = sorted({*hist.edges[:-1], *new})
        held = set(opened)
        inside, flags = False, []
        for e in edges:
            inside = e in held if e in hist.below else inside
            flags.append(inside)
        hist.learn([*edges, END], counted(edges, np.array(flags)), opened)
        many = PROBES
    return hist


def _dealt(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    """Rows with their sortable key, the part that takes them, its shard and first slot."""
    edges, shard, base = plan.value
    edges = _sorted_bytes(edges)
    for batch in batches:
        keys = _keys(batch)
        part = np.searchsorted(edges, keys, side="right") - 1
        keep = [n for n in batch.schema.names if n not in ("hash", "doc", "place", "weight")]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(n) for n in keep), pa.array(np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, 32).view("V32").ravel().tolist(), pa.binary()),
            pa.array(part, pa.int32()), pa.array(shard[part], pa.int32()), pa.array(base[part], pa.int64())],
            names=[*keep, "key", "part", "shard", "base"])


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a task with their slots: a part's first slot plus the place in the part."""
    now, seen = None, 0
    for batch in batches:
        part = batch.column("part").to_numpy()
        place = np.arange(len(part))
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else place
        start = np.repeat(first, np.diff(np.r_[first, len(part)]))
        slot = place - start
        if len(part) and part[0] == now:
            slot[start == 0] += seen
        if len(part):
            now, seen = part[-1], int(slot[-1]) + 1
        keep = [n for n in batch.schema.names if n not in ("key", "part", "base")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(batch.column("base").to_numpy() + slot, pa.int64())],
                                         names=[*keep, "slot"])


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, law: str = "bytes",
          columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) of ``docs(doc_id, text, ...)`` with size, text_crc32, shard and slot.

    ``law`` is ``bytes`` (near equal sizes) or ``rows`` (counts at most one apart, where
    ``tolerance`` is 0). The rows come dealt and sorted by (shard, slot).
    """
    if law not in ("bytes", "rows"):
        raise ValueError(law)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    carried = [c for c in (docs.columns if columns is None else columns) if c not in RESULT]
    rows = scratch.write(docs.select(
        F.struct(*carried).alias("row") if carried else F.struct(F.lit(0).alias("_")).alias("row"),
        size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
        F.col("doc_id").cast("long").alias("doc"), F.monotonically_increasing_id().alias("place"),
        (size if law == "bytes" else F.lit(1).cast("long")).alias("weight")))
    hist = _histogram(rows, shards, tolerance, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fields = [F.col(f"row.`{c}`") for c in carried]
    if hist is None:
        return scratch.keep(rows.select(*fields, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0))
    starts = [0, *(hist.splitter(s) for s in range(1, shards))]
    edges: list[int] = []
    for a, b in zip(hist.edges, hist.edges[1:]):
        if not edges or a in starts or hist.below[b][0] - hist.below[edges[-1]][0] > hist.most_rows:
            edges.append(a)
    shard_of = np.array([bisect_right(starts, e) - 1 for e in edges])
    base = np.array([hist.below[e][0] - hist.below[starts[s]][0] for e, s in zip(edges, shard_of)])
    plan = spark.sparkContext.broadcast((edges, shard_of, base))
    kind = rows.schema["row"].dataType.simpleString()
    held = f"row {kind}, size long, text_crc32 long"
    dealt = rows.mapInArrow(partial(_dealt, plan=plan), f"{held}, key binary, part int, shard int, base long")
    placed = dealt.repartitionById(len(edges), F.col("part")).sortWithinPartitions("part", "key").mapInArrow(
        _slotted, f"{held}, shard int, slot long")
    return scratch.keep(placed.select(*fields, *RESULT))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder ``shard=<n>`` for each shard, files in slot order, all columns of ``docs`` kept."""
    shard(docs, **options).write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``)."""
    return shard(docs, shards, columns=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
