"""Token-id output: best-fit-decreasing packing of documents into fixed rows.

Every document is tokenized, closed by an end-of-text id and cut into pieces of
at most ``length`` ids (nothing is lost: the pieces of a document, in order, are
its ids). Pieces are packed into rows of ``length`` ids, largest first, each
into the open row with the least room that still fits; a segment tree over the
rooms 0..length finds that row in log(length) steps.

Packing runs inside each partition, a block of ``block`` ids at a time, without
a shuffle: memory is bounded by the block, a lost executor repeats its
partitions only, and only the last rows of each block may stay unfilled.

Output, one row per packed row: ``pack_id``, ``ids`` (little-endian unsigned
integers, padded with the end-of-text id to ``length``; the rows of a file form
an id matrix), ``n_tokens``, ``cu_seqlens`` (cumulative segment lengths, from
0), ``resets`` (offsets at which positions restart from 0; the padding's start
is one), ``doc_ids`` and ``parts`` (the document and its piece number of each
segment).

Null or empty text gives the end-of-text id alone. Null and repeated ids are
carried as they are. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm.common import ship

LENGTH = 2048
BLOCK = 4 << 20
_ROWS = ("pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, "
         "doc_ids array<long>, parts array<int>")


class RoomTree:
    """Segment tree over room sizes: which sizes have an open row."""

    def __init__(self, length: int):
        self.leaves = 1 << (length + 1).bit_length()
        self.open = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def least(self, room: int) -> int:
        """The smallest open room of at least ``room``, or -1."""
        at, tree = room + self.leaves, self.open
        if tree[at]:
            return room
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; equal sizes in order of their number."""
    tree, rows, by_room = RoomTree(length), [], {}
    for piece in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        room = tree.least(sizes[piece])
        if room < 0:
            rows.append([])
            row, room = len(rows) - 1, length
        else:
            row = by_room[room].pop()
            tree.change(room, -1)
        rows[row].append(piece)
        left = room - sizes[piece]
        if left:
            by_room.setdefault(left, []).append(row)
            tree.change(left, 1)
    return rows


def _pack(batches: Iterator[pa.RecordBatch], vocabulary, length: int, block: int) -> Iterator[pa.RecordBatch]:
    import tiktoken
    pattern, ranks, eot = vocabulary.value
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kind = np.dtype("<u2" if eot < 1 << 16 else "<u4")
    partition, made = TaskContext.get().partitionId(), 0
    pieces: list[np.ndarray] = []
    owner: list[tuple[int | None, int]] = []
    held = 0

    def rows(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal pieces, owner, held, made
        packed = best_fit_decreasing([len(p) for p in pieces], length)
        for at in range(0, len(packed), 256):
            some = packed[at:at + 256]
            ids, n, cu, resets = [], [], [], []
            for row in some:
                cuts = np.cumsum([0, *(len(pieces[k]) for k in row)])
                flat = np.full(length, eot, kind)
                flat[:cuts[-1]] = np.concatenate([pieces[k] for k in row])
                ids.append(flat.tobytes())
                n.append(int(cuts[-1]))
                cu.append(cuts.tolist())
                resets.append([c for c in cuts.tolist() if c < length])
            yield pa.RecordBatch.from_arrays([
                pa.array([partition << 33 | made + k for k in range(len(some))], pa.int64()), pa.array(ids, pa.binary()),
                pa.array(n, pa.int32()), pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())),
                pa.array([[owner[k][0] for k in row] for row in some], pa.list_(pa.int64())),
                pa.array([[owner[k][1] for k in row] for row in some], pa.list_(pa.int32()))],
                names=["pack_id", "ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "parts"])
            made += len(some)
        pieces, owner, held = [], [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part.column(0).cast(pa.int64()).to_pylist(), part.column(1).to_pylist()):
                ids = np.empty(0, np.uint32) if not text else coder.encode_to_numpy(text, disallowed_special=())
                ids = np.append(ids, np.uint32(eot)).astype(kind)
                for k, cut in enumerate(range(0, len(ids), length)):
                    pieces.append(ids[cut:cut + length])
                    owner.append((doc, k))
                held += len(ids)
                if held >= block:
                    yield from rows(False)
    if pieces:
        yield from rows(True)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Packed rows of ``docs(doc_id, text)`` under the rank file at ``path``.

    The end-of-text id is the first id above the ranks. The ranks are broadcast;
    their size is the vocabulary's.
    """
    ranks = load_ranks(path)
    shared = ship(docs.sparkSession).sparkContext.broadcast((pattern, ranks, max(ranks.values()) + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_pack, vocabulary=shared, length=length, block=block), _ROWS)


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, part, ids binary): the segments of packed rows, as they were cut."""
    segments = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "parts")).alias("k", "segment"))
    start = F.element_at("cu_seqlens", F.col("k") + 1)
    size = F.element_at("cu_seqlens", F.col("k") + 2) - start
    return segments.select(F.col("segment.doc_ids").alias("doc_id"), F.col("segment.parts").alias("part"),
                           F.substring("ids", start * width + 1, size * width).alias("ids"))


def write(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet; the ``ids`` column of a file is its id matrix."""
    packed.write.parquet(path)
