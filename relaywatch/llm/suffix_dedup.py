"""Suffix-array dedup: a front-coded distributed merge sort of text suffixes.

Every byte of a text that lies in a ``SPAN``-byte string which also starts
earlier (a smaller doc_id, or the same document at a smaller place) is removed.
Strings never cross documents, overlapping places count, and all strings are
judged on the input.

Sorting every suffix of a corpus would move many times its size. Equal strings
have equal insides, so it is enough to sort suffixes at *anchors*: the place of
the smallest ``GRAM``-byte hash in each string (leftmost of equals). It depends
on the string alone, so equal strings have their anchor at the same offset, and
neighbouring strings mostly share one. Three passes follow.

1. Anchor grams are exchanged by hash; anchors whose gram occurs once drop out.
   A task sends a gram that it holds several times only once.
2. The suffix at each remaining anchor (as far as its strings reach, at most
   ``SPAN`` bytes) and the bytes to its left (reversed, at most ``SPAN - GRAM``)
   are sorted in each task. Equal contexts in a task are one. The sorted runs
   are exchanged front-coded (common prefix with the one before, then the rest).
   Each task merges its runs with a loser tree that keeps, for every candidate,
   the prefix length shared with the last winner: candidates are compared by
   that length, and bytes only from there on, so known prefixes are never
   compared again. The merge gives the suffix order and its common prefixes.
3. A string at offset o left of its anchor is the last o bytes to the left and
   the first SPAN - o of the suffix: equal strings lie in one run of common
   prefixes of at least SPAN - o and have equal left bytes. All but the first
   of each such class are covered.

A gram with more than ``MANY`` anchors (a common line with different text around
it) would bring all its contexts to one task. Its strings are dealt one by one
instead, by two 64-bit hashes of their bytes; a task sends the first of equal
strings of each ``BLOCK`` anchors, so a common string stays small as well.

Null text is empty text. Rows with a null id are kept whole and compared with
nothing. Rows that repeat an id start at the same places, so they are not
earlier than each other; each is judged by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm import common as C
from relaywatch.llm.common import Scratch

SPAN, GRAM = 100, 32
SIDE = SPAN - GRAM              # most bytes left of an anchor
PIECE = 2 << 20                 # bytes whose anchors are found at a time
HELD = 1 << 20                  # anchors a task gathers before it sends a run
TEXT_PART = 16 << 20            # text bytes for each part of the gram exchange
PART = 1 << 16                  # anchors for each part of the suffix exchange
MANY = 1 << 14                  # anchors of a gram from which its strings are dealt one by one
BLOCK = 1 << 13                 # such anchors whose strings are formed at a time
LOAD = 4                        # what such an anchor weighs in a part, in contexts


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first string, last string) of every anchor of the documents in ``data``."""
    n, reach = len(data), SIDE + 1
    if n < SPAN:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    places = np.arange(n - GRAM + 1)
    grams = C.span_hashes(data, places, places + GRAM)
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    rows = -(-len(keyed) // reach)
    block = np.full(rows * reach, np.uint64(2**64 - 1))
    block[:len(keyed)] = keyed
    block = block.reshape(rows, reach)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - SPAN
    least = np.minimum(behind[:last + 1], ahead[reach - 1:last + reach])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[:last + 1]
    sound = np.arange(last + 1) + SPAN <= end
    first = sound.copy()
    first[1:] &= ~sound[:-1] | (at[1:] != at[:-1])
    final = sound.copy()
    final[:-1] &= ~sound[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(final)
    return grams[at[lo]], at[lo], lo, hi


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in it, bytes, offsets); a long text comes in overlapping pieces."""
    for first, _, data, offsets in C.chunks(column, PIECE):
        if len(data) <= 2 * PIECE:
            yield first, 0, data, offsets
        else:
            for at in range(0, max(1, len(data) - SPAN + 1), PIECE):
                part = data[at:at + PIECE + SPAN - 1]
                yield first, at, part, np.array([0, len(part)])


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed block."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        out.append(np.frombuffer(raw, np.dtype(chr(kind)), size // np.dtype(chr(kind)).itemsize, at))
        at += size
    return out


def _sent(parts: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p]:cut[p + 1]]


def _send_grams(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (docs, anchors of each doc, gram hashes, places, offsets, kind) for each part.

    Kind 0 is an anchor to be judged, 1 one known to be repeated that only
    travels back, 2 a gram's sign that this task holds it more than once, with
    the number held in place of the place.
    """
    held: list[tuple] = []
    size = 0

    def send():
        docs, gram, at, left, right = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        many = np.zeros(len(gram), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        sign = np.zeros(len(gram), bool)
        sign[order[np.r_[True, ~same]]] = True
        sign &= many
        group = np.cumsum(np.r_[True, ~same]) - 1
        number = np.empty(len(gram), np.int64)
        number[order] = np.bincount(group)[group]
        target = np.where(many, docs.view(np.uint64) ^ at.astype(np.uint64), gram)
        part = (C.mix64(target) % np.uint64(parts)).astype(np.int64)
        kind = many.astype(np.uint8)
        signs = np.flatnonzero(sign)
        part = np.r_[part, (C.mix64(gram[signs]) % np.uint64(parts)).astype(np.int64)]
        pick = np.r_[np.arange(len(gram)), signs]
        kind = np.r_[kind, np.full(len(signs), 2, np.uint8)]
        out_parts, blocks = [], []
        for p, rows in _by_part(part, parts):
            own = pick[rows]
            by_doc = np.argsort(docs[own], kind="stable")
            rows, own = rows[by_doc], own[by_doc]
            names, counts = np.unique(docs[own], return_counts=True)
            out_parts.append(p)
            blocks.append(_pack([names, counts.astype(np.uint32), np.where(kind[rows] == 1, np.uint64(0), gram[own]),
                                 np.where(kind[rows] == 2, number[own], at[own]).astype(np.uint32), left[own], right[own], kind[rows]]))
        held.clear()
        return _sent(out_parts, blocks)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, base, data, offsets in _pieces(batch.column(1)):
            gram, at, lo, hi = anchors(data, offsets)
            if not len(at):
                continue
            doc = np.searchsorted(offsets, at, side="right") - 1
            held.append((ids[first + doc], gram, at - offsets[doc] + base, (at - lo).astype(np.uint8), (at - hi).astype(np.uint8)))
            size += len(at)
            if size >= HELD:
                yield send()
                size = 0
    if held:
        yield send()


def _repeated(table: pa.Table, limit: int) -> pa.Table:
    """(doc_id, anchor) of the anchors whose gram stands at two places or more.

    Rows without a doc_id name the grams with more than ``limit`` anchors and their number.
    """
    parts = [_unpack(b) for b in table.column("block").to_pylist()]
    docs = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    gram, at, left, right, kind = (np.concatenate([p[k] for p in parts]) for k in range(2, 7))
    live = np.flatnonzero(kind != 1)
    order = live[np.argsort(gram[live], kind="stable")]
    same = gram[order[1:]] == gram[order[:-1]]
    many = kind == 1
    many[order[1:][same]] = many[order[:-1][same]] = True
    many &= kind != 2
    packed = at.astype(np.int64) << 16 | left.astype(np.int64) << 8 | right
    first = np.flatnonzero(np.r_[True, ~same])[:len(order)]
    total = np.add.reduceat(np.where(kind[order] == 2, at[order], 1).astype(np.int64), first) if len(order) else np.zeros(0, np.int64)
    common = total > limit
    names = gram[order[first[common]]].view(np.int64)
    none = pa.nulls(len(names), pa.int64())
    return pa.table({"doc_id": pa.concat_arrays([pa.array(docs[many]), none]), "anchor": np.r_[packed[many], names],
                     "number": pa.concat_arrays([pa.nulls(int(many.sum()), pa.int64()), pa.array(total[common])])})


def _contexts(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """[anchors, SPAN + SIDE] bytes: the suffix, then the left bytes reversed; zero beyond their strings."""
    column = np.r_[np.arange(SPAN), -1 - np.arange(SIDE)]
    inside = np.concatenate([np.arange(SPAN)[None, :] < (SPAN - right)[:, None],
                             np.arange(SIDE)[None, :] < left[:, None]], axis=1)
    place = np.where(inside, at[:, None] + column[None, :], 0)
    return np.where(inside, data[place], 0).astype(np.uint8)


def _shared(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _strings(text: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset left of its anchor, two hashes of the bytes) of every string of the contexts."""
    offset = np.arange(SIDE + 1)
    who, off = np.nonzero((right[:, None] <= offset) & (offset <= left[:, None]))
    weight = C.powers(SPAN + SIDE)[0][:SPAN + SIDE]
    hashes = []
    with np.errstate(over="ignore"):
        for table in (C.BYTE_KEYS, C.mix64(C.BYTE_KEYS)):
            after = np.cumsum(table[text[:, :SPAN]] * weight[SIDE:], axis=1)
            before = np.zeros((len(text), SIDE + 1), np.uint64)
            np.cumsum(table[text[:, SPAN:]] * weight[:SIDE][::-1], axis=1, out=before[:, 1:])
            hashes.append(C.mix64(after[who, SPAN - 1 - off] + before[who, off] + off.astype(np.uint64)))
    return who, off, hashes[0], hashes[1]


def _judged(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for the strings that are later than an equal one; one id and place is never later than itself."""
    by = np.lexsort((start, docs, h2, h1))
    new = np.ones(len(by), bool)
    new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    head = by[new][np.cumsum(new) - 1]
    later = np.zeros(len(by), bool)
    later[by] = (docs[by] != docs[head]) | (start[by] != start[head])
    return later


def _joined(docs: np.ndarray, keys: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text key, start, end) of the covered spans, neighbouring strings as one."""
    by = np.lexsort((start, keys, docs))
    docs, keys, start = docs[by], keys[by], start[by]
    first = np.ones(len(by), bool)
    first[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1]) | (start[1:] > start[:-1] + 1)
    last = np.r_[first[1:], np.ones(min(1, len(by)), bool)]
    return docs[first], keys[first], start[first], start[last] + SPAN


def _send_strings(rows: tuple, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, block) of the strings of contexts whose gram is common."""
    for cut in range(0, len(rows[1]), BLOCK):
        text, docs, keys, at, left, right = (x[cut:cut + BLOCK] for x in rows)
        who, off, h1, h2 = _strings(text, left, right)
        docs, keys, start = docs[who], keys[who], at[who] - off
        later = _judged(h1, h2, docs, start)
        if later.any():
            spans = _joined(docs[later], keys[later], start[later])
            yield int(C.mix64(spans[0][:1].view(np.uint64))[0] % np.uint64(parts)), _pack([np.zeros(0, np.uint8), *spans])
        own = np.flatnonzero(~later)
        for p, some in _by_part((C.mix64(h1[own]) % np.uint64(parts)).astype(np.int64), parts):
            some = own[some]
            names, which = np.unique(np.stack([docs[some], keys[some]]), axis=1, return_inverse=True)
            yield p, _pack([np.full(2, 2, np.uint8), names[0], names[1], which.ravel().astype(np.uint32), h1[some], h2[some],
                            start[some].astype(np.uint32)])


def _send_runs(batches: Iterator[pa.RecordBatch], parts: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs for each part, and marks of contexts met before in the task.

    Contexts of the ``common`` grams go string by string.
    """
    held: list[tuple] = []
    size = 0

    def send():
        rows = tuple(np.concatenate(x) for x in zip(*held))
        held.clear()
        if len(common):
            flat, place = rows[0][:, :GRAM].ravel(), np.arange(len(rows[0])) * GRAM
            apart = np.isin(C.span_hashes(flat, place, place + GRAM), common)
            for p, block in _send_strings(tuple(x[apart] for x in rows), parts):
                yield _sent([p], [block])
            rows = tuple(x[~apart] for x in rows)
        if len(rows[1]):
            yield send_runs(*rows)

    def send_runs(text, docs, keys, at, left, right):
        order = np.argsort(text.view(f"S{SPAN + SIDE}").ravel(), kind="stable")
        text, docs, keys, at, left, right = (x[order] for x in (text, docs, keys, at, left, right))
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]).any(axis=1) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        group = np.cumsum(new) - 1
        early = np.lexsort((at, docs, group))
        lead = np.zeros(len(at), bool)
        lead[early[np.r_[True, group[early][1:] != group[early][:-1]]]] = True
        again = np.flatnonzero(~lead)
        # rows of one document at one place (a repeated id) are not earlier than each other
        head = early[np.r_[True, group[early][1:] != group[early][:-1]]][group[again]]
        tie = (docs[again] == docs[head]) & (at[again] == at[head])
        lead[again[tie]] = True
        again = again[~tie]
        out_parts, blocks = [], []
        if len(again):
            out_parts.append(int(C.mix64(docs[again[:1]].view(np.uint64))[0] % np.uint64(parts)))
            blocks.append(_pack([np.zeros(0, np.uint8), docs[again], keys[again], at[again] - left[again], at[again] - right[again] + SPAN]))
        own = np.flatnonzero(lead)
        zero = np.zeros(len(own), np.int64)
        flat = text[own][:, :GRAM].ravel()
        part = C.span_hashes(flat, np.arange(len(own)) * GRAM, (np.arange(len(own)) + 1) * GRAM) % np.uint64(parts) if len(own) else zero
        for p, rows in _by_part(part.astype(np.int64), parts):
            rows = own[rows]
            suffix, reverse = text[rows, :SPAN], text[rows, SPAN:]
            common, back = _shared(suffix), _shared(reverse)
            rest = suffix[(np.arange(SPAN)[None, :] >= common[:, None])]
            rest_left = reverse[(np.arange(SIDE)[None, :] >= back[:, None])]
            names, which = np.unique(np.stack([docs[rows], keys[rows]]), axis=1, return_inverse=True)
            out_parts.append(p)
            blocks.append(_pack([np.ones(1, np.uint8), names[0], names[1], which.ravel().astype(np.uint32), at[rows].astype(np.uint32),
                                 left[rows], right[rows], common.astype(np.uint8), back.astype(np.uint8), rest, rest_left]))
        return _sent(out_parts, blocks)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = batch.column(3)
        for first, last, data, offsets in C.chunks(batch.column(2)):
            for k in range(first, last):
                packed = wanted[k].values.to_numpy(zero_copy_only=False)
                raw = data[offsets[k - first]:offsets[k - first + 1]]
                at, left, right = packed >> 16, (packed >> 8) & 255, packed & 255
                fits = at - right + SPAN <= len(raw)     # an id that repeats may carry another row's anchors
                at, left, right = at[fits], left[fits], right[fits]
                for cut in range(0, len(at), 8192):
                    some = slice(cut, cut + 8192)
                    n = len(at[some])
                    held.append((_contexts(raw, at[some], left[some], right[some]), np.full(n, ids[k]), np.full(n, keys[k]),
                                 at[some], left[some].astype(np.uint8), right[some].astype(np.uint8)))
                    size += n
                    if size >= HELD // 4:
                        yield from send()
                        size = 0
    if held:
        yield from send()


def _decoded(common: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """The rows of a front-coded run."""
    n = len(common)
    own = np.arange(width)[None, :] >= common[:, None]
    rows = np.zeros((n, width), np.uint8)
    rows[own] = rest
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(rows, source, axis=0)


def _mismatch(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, equal up to ``start``; both of one length."""
    step = 16
    while start < len(a):
        x, y = a[start:start + step], b[start:start + step]
        if x != y:
            if step == 1:
                return start
            step = max(1, step // 4)
        else:
            start += len(x)
    return len(a)


def merge_runs(runs: list[list[bytes]], common: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of equal-length strings with a loser tree on common prefixes.

    ``common[r][i]`` is the prefix length string i of run r shares with the one
    before it. Returns the merged order as (run, number) and the prefix length
    that each merged string shares with the one before it.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    length = len(runs[0][0])
    strings = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k                      # prefix shared with the last winner
    at = [0] * k
    loser = [-1] * k                     # of each inner node
    order: list[tuple[int, int]] = []
    shared: list[int] = []

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
        x, y = strings[a], strings[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        m = length if x == y else _mismatch(x, y, p)
        if m == length or x[m] < y[m]:
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    while strings[top] is not None:
        order.append((top, at[top]))
        shared.append(known[top])
        run = runs[top]
        at[top] += 1
        if at[top] < len(run):
            strings[top], known[top] = run[at[top]], common[top][at[top]]
        else:
            strings[top] = None
        node = (top + k) >> 1
        while node:
            top, loser[node] = play(top, loser[node])
            node >>= 1
    return order, shared


def _covered(table: pa.Table) -> pa.Table:
    """Marks (doc_id, text_key, start << 32 | end) of the bytes covered by later strings."""
    known, runs, strings = [], [], []
    for block in table.column("block").to_pylist():
        arrays = _unpack(block)
        (known, runs, strings)[len(arrays[0])].append(arrays[1:])
    out = [(k[0], k[1], k[2], k[3]) for k in known]
    if strings:
        docs, keys = (np.concatenate([x[k][x[2]] for x in strings]) for k in range(2))
        h1, h2, place = (np.concatenate([x[k] for x in strings]) for k in range(3, 6))
        place = place.astype(np.int64)
        later = _judged(h1, h2, docs, place)
        out.append(_joined(docs[later], keys[later], place[later]))
    if runs:
        texts = [_decoded(r[6].astype(np.int64), r[8], SPAN) for r in runs]
        lefts = np.concatenate([_decoded(r[7].astype(np.int64), r[9], SIDE) for r in runs])
        start = np.cumsum([0, *(len(r[3]) for r in runs)])
        strings = [[row.tobytes() for row in t] for t in texts]
        order, common = merge_runs(strings, [r[6].tolist() for r in runs])
        pick = np.array([start[r] + i for r, i in order], np.int64)
        common = np.array(common, np.int64)
        docs = np.concatenate([r[0][r[2]] for r in runs])[pick]
        keys = np.concatenate([r[1][r[2]] for r in runs])[pick]
        at = np.concatenate([r[3] for r in runs]).astype(np.int64)[pick]
        left = np.concatenate([r[4] for r in runs]).astype(np.int64)[pick]
        right = np.concatenate([r[5] for r in runs]).astype(np.int64)[pick]
        lefts = lefts[pick]
        # anchors alone in their gram are done
        alone = (common < GRAM) & np.r_[common[1:] < GRAM, True]
        live = np.flatnonzero(~alone)
        if len(live):
            place = np.lexsort((at[live], docs[live]))
            first = np.ones(len(place), bool)
            first[1:] = (docs[live][place][1:] != docs[live][place][:-1]) | (at[live][place][1:] != at[live][place][:-1])
            turn = np.empty(len(live), np.int64)
            turn[place] = np.cumsum(first)             # rows of one id and place take one turn
            sums = np.zeros((len(live), SIDE + 1), np.uint64)
            with np.errstate(over="ignore"):
                weight = C.powers(SIDE)[0][:SIDE]
                np.cumsum(C.BYTE_KEYS[lefts[live]] * weight, axis=1, out=sums[:, 1:])
            later = np.zeros((len(live), SIDE + 1), bool)
            for o in range(SIDE + 1):
                klass = np.cumsum(common < SPAN - o)[live]
                some = np.flatnonzero((right[live] <= o) & (o <= left[live]))
                if len(some) < 2:
                    continue
                by = some[np.lexsort((turn[some], sums[some, o], klass[some]))]
                same = (klass[by][1:] == klass[by][:-1]) & (sums[by, o][1:] == sums[by, o][:-1])
                group = np.cumsum(np.r_[True, ~same]) - 1
                head = turn[by][np.r_[True, ~same]][group]
                later[by[turn[by] > head], o] = True
            # runs of covered offsets of an anchor are spans of its document
            edge = np.zeros((len(live), SIDE + 3), np.int8)
            edge[:, 1:-1] = later
            step = np.diff(edge, axis=1)
            who, low = np.nonzero(step == 1)
            _, high = np.nonzero(step == -1)
            own = live[who]
            out.append((docs[own], keys[own], at[own] - (high - 1), at[own] - low + SPAN))
    docs, keys, starts, ends = (np.concatenate([np.asarray(x[k], np.int64) for x in out]) if out else np.zeros(0, np.int64) for k in range(4))
    return pa.table({"doc_id": docs, "text_key": keys, "mark": starts << 32 | ends})


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(2)
        for first, last, data, offsets in C.chunks(batch.column(1)):
            n, removed, spans, digest, kept = [], [], [], [], []
            for k in range(first, last):
                raw = data[offsets[k - first]:offsets[k - first + 1]]
                own = marks[k]
                rest = raw
                gone = runs = 0
                if own.is_valid and len(own.values):
                    packed = own.values.to_numpy(zero_copy_only=False)
                    level = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(level, packed >> 32, 1)
                    np.add.at(level, packed & 0xFFFFFFFF, -1)
                    out = np.cumsum(level[:-1]) > 0
                    gone, runs = int(out.sum()), int((np.diff(np.r_[0, out.astype(np.int8)]) == 1).sum())
                    rest = raw[~out]
                n.append(len(raw))
                removed.append(gone)
                spans.append(runs)
                digest.append(hashlib.sha256(rest.tobytes()).hexdigest())
                if texts:
                    kept.append(rest.tobytes())
            columns = [batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, texts: bool = False, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``docs(doc_id, text)``.

    ``texts`` adds ``kept``, the remaining bytes. Strings around grams with more
    than ``many`` anchors are dealt one by one; the result is the same for any.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // TEXT_PART))
    named = rows.filter("doc_id is not null and octet_length(text) >= %d" % SPAN).select("doc_id", "text")
    grams = named.mapInArrow(partial(_send_grams, parts=parts), "part int, block binary")
    found = scratch.write(grams.groupBy("part").applyInArrow(lambda t: _repeated(t, many), "doc_id long, anchor long, number long"))
    apart = found.filter("doc_id is null").select("anchor", "number").collect()    # at most one for every ``many`` anchors
    common = np.array([r["anchor"] for r in apart], np.int64).view(np.uint64)
    found = found.filter("doc_id is not null").select("doc_id", "anchor")
    parts = max(1, -(-(found.count() + LOAD * sum(r["number"] for r in apart)) // PART))

    dealt = rows.repartition("doc_id")
    wanted = found.groupBy("doc_id").agg(F.collect_list("anchor").alias("wanted"))
    runs = dealt.filter("doc_id is not null").join(wanted.hint("shuffle_hash"), "doc_id").select(
        "doc_id", "text_key", "text", "wanted").mapInArrow(partial(_send_runs, parts=parts, common=common), "part int, block binary")
    marks = scratch.write(runs.groupBy("part").applyInArrow(_covered, "doc_id long, text_key long, mark long"))
    per_doc = marks.groupBy("doc_id", "text_key").agg(F.collect_list("mark").alias("marks"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    out = rows.join(per_doc.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select("doc_id", "text", "marks")
    return scratch.keep(out.mapInArrow(partial(_kept, texts=texts), kind))
