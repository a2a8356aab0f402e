"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece BPE (B).

Both tokenizers read a space and the text. Byte offsets where a token of A and one
of B end cut the tokens into groups; the tokens that end there are linked. How often
an id pair is linked is counted over all documents.

Identity-map fast path: an array gives for each A id the B id of the same bytes. A
group of one token on each side covers the same bytes twice, so its link is one entry
of that array and is counted in a vector of the vocabulary's length, summed by task.
Only links of irregular groups (several tokens, or bytes that have two B ids) are
counted by id pair in a shuffle, after each task has summed its own.

Reading the counts back: vocabulary-length vectors for the fast links, and the pairs
that hold more than 1 / ``HEAVY`` of the irregular links (at most ``HEAVY``, by
arithmetic) are looked up in the tasks; the rest, none of which is frequent, joins
its counts by pair. So no common pair lands in one task.

Texts are tokenized in pieces cut before a space that follows a non-space: no
pre-token of A and no merge of B crosses such a place (for B both the vocabulary and
the normalizer are tested when it is loaded; if they do not allow it, texts are
tokenized whole). Pieces repeat, so a task tokenizes and aligns each of its pieces
once and then only looks them up; a large store drops the pieces met only once.

Defined results: null and empty texts, and texts whose joined A or B bytes are not a
space and the text, have no tokens: counts 0 and groups ''. Special tokens' strings
in a text are plain text. Rows that repeat, or repeat an id, are rows of their own.
Texts of any length are read whole. Only ``doc_id`` and ``text`` are used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaywatch.llm import common as C

HEAVY = 32768
STORED, STEP = 200_000, 1 << 15   # pieces after which a task drops those met once; pieces aligned at once
LINK_BYTES = 1 << 20         # stored links that a task looks up at once
CHUNK_BYTES = 2 << 20        # text that a task handles at once, more only for a longer document
TALLY = 1 << 19              # pairs that a task sums before it hands them on
PROBE = "a  b é é 가 ﬁ ㎒ Ａ   c\t d  "
_cut = re.compile(r"(?<=\S) ")


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Lists:
    """Lists of ids as one array."""

    def __init__(self, lists: list[list[int]]):
        self.n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ends = np.r_[0, np.cumsum(self.n)]
        self.flat = np.fromiter(chain.from_iterable(lists), np.int64, int(self.ends[-1]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each list of the values of its ids."""
        total = np.r_[0, np.cumsum(values[self.flat])]
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def kept(self, which: np.ndarray) -> Lists:
        """The same lists, those not in ``which`` emptied."""
        out = Lists([])
        out.n = np.where(which, self.n, 0)
        out.ends = np.r_[0, np.cumsum(out.n)]
        out.flat = self.flat[np.repeat(which, self.n)]
        return out


class Pair:
    """The two tokenizers, the bytes of their ids, and the A id to B id array."""

    def __init__(self, a_json: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of = byte_level()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        is_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        a_bytes = [bytes(of[c] for c in n) if all(c in of for c in n) else n.encode() for n in names]
        b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, is_byte)]
        best: dict[bytes, int] = {}
        for byte_ones in (False, True):                 # a piece goes before a byte of the same value
            for i, byte in enumerate(is_byte):
                if byte == byte_ones and not self.b.is_control(i) and not self.b.is_unknown(i):
                    best.setdefault(b_bytes[i], i)
        self.same = np.array([best.get(x, -1) for x in a_bytes], np.int64)
        self.kind = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")      # of A ids where they are stored
        self.a_bytes, self.b_bytes = np.array([*a_bytes, None], object)[:-1], np.array([*b_bytes, None], object)[:-1]
        self.a_size, self.b_size = (np.array(list(map(len, table)), np.int64) for table in (a_bytes, b_bytes))
        self.cuts = (b"".join(self.b_bytes[self.b.encode(PROBE)]) == (" " + PROBE).encode()
                     and not any("▁" in p.lstrip("▁") for p in pieces))
        self._lead = len(self.b.encode("x"))
        # an id as it stands in the groups' text: inside its side, at the end of A's side, at the end of the group
        most = range(max(len(names), len(pieces)))
        self.commas, self.ends_a, self.ends_b = (np.array([f"{i}{mark}" for i in most], object) for mark in ",|;")

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that both tokenizers read by themselves, each without the space before it."""
        return _cut.split(text) if self.cuts else [text]

    def tokens(self, pieces: list[str]) -> tuple[Lists, Lists]:
        """A ids and B ids of pieces, each read with the space before it."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        many = Lists([e.ids for e in encode([" " + p for p in pieces], add_special_tokens=False)])
        if self.cuts:
            return many, Lists([ids[self._lead:] for ids in self.b.encode(["x " + p for p in pieces], num_threads=1)])
        return many, Lists(self.b.encode(pieces, num_threads=1))

    def spelled(self, texts: list[str], a: Lists, b: Lists) -> np.ndarray:
        """Whether A's and B's tokens both spell a space and the text, for each text."""
        raw = [(" " + t).encode() for t in texts]
        whole, size = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        sides = ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size))
        if all((ids.sums(n) == size).all() and b"".join(table[ids.flat].tolist()) == whole for ids, table, n in sides):
            return np.ones(len(texts), bool)
        sound = np.ones(len(texts), bool)
        for ids, table, _ in sides:
            ends = ids.ends.tolist()
            sound &= [b"".join(table[ids.flat[x:y]].tolist()) == r for r, x, y in zip(raw, ends, ends[1:])]
        return sound


class Groups:
    """The groups of many pieces at once; both sides of each piece spell the same bytes.

    ``n`` groups, ``text`` and, one for each group, ``links`` (A id * 2^32 + B id).
    """

    def __init__(self, pair: Pair, a: Lists, b: Lists):
        end_a, end_b = np.cumsum(pair.a_size[a.flat]), np.cumsum(pair.b_size[b.flat])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        self.links = a.flat[np.searchsorted(end_a, common)] << 32 | b.flat[np.searchsorted(end_b, common)]
        self.n = np.diff(np.searchsorted(common, np.r_[0, end_a][a.ends], side="right"))
        # the tokens in the order of the text: of each group first A's, then B's
        before_a, before_b = (np.r_[0, np.cumsum(np.bincount(g, minlength=len(common)))] for g in (in_a, in_b))
        words = np.empty(len(a.flat) + len(b.flat), object)
        for flat, group, place, marks in ((a.flat, in_a, before_b[in_a], pair.ends_a), (b.flat, in_b, before_a[in_b + 1], pair.ends_b)):
            shuts = np.r_[group[1:] != group[:-1], True][:len(group)]
            words[np.arange(len(flat)) + place] = np.where(shuts, marks[flat], pair.commas[flat])
        words = words.tolist()
        whole = "".join(words)
        chars = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        cut = chars[a.ends + b.ends].tolist()
        self.text = [whole[x:y - 1] if y > x else "" for x, y in zip(cut, cut[1:])]


class Store(dict):
    """Piece to number; what is known of each piece stands in arrays by number."""

    def __init__(self, pair: Pair):
        self.pair, self.new, self.text = pair, [], []
        self.n_a = self.n_b = self.n_groups = self.links = self.seen = np.zeros(0, np.int64)
        self.sound = np.zeros(0, bool)

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k

    def learn(self) -> None:
        """Tokenize and align the pieces met since the last call."""
        for at in range(0, len(self.new), STEP):
            some = self.new[at:at + STEP]
            a, b = self.pair.tokens(some)
            self.add(a, b, self.pair.spelled(some, a, b))
        self.new = []

    def add(self, a: Lists, b: Lists, sound: np.ndarray) -> None:
        if not sound.all():
            a, b = a.kept(sound), b.kept(sound)
        groups = Groups(self.pair, a, b)
        self.n_a, self.n_b, self.sound = np.r_[self.n_a, a.n], np.r_[self.n_b, b.n], np.r_[self.sound, sound]
        self.n_groups, self.links = np.r_[self.n_groups, groups.n], np.r_[self.links, groups.links]
        self.seen = np.r_[self.seen, np.zeros(len(sound), np.int64)]
        self.text += groups.text

    def links_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the pieces ``which``, one after the other, and where each piece's end."""
        n = self.n_groups[which]
        ends = np.r_[0, np.cumsum(n)]
        start = np.cumsum(self.n_groups) - self.n_groups
        return self.links[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], n)], ends

    def pruned(self) -> Store:
        """A store of the pieces that were met more than once, at most half of what a task may keep."""
        out, some = Store(self.pair), np.flatnonzero(self.seen > 1)
        if len(some) > STORED // 2:
            some = np.sort(np.argsort(-self.seen, kind="stable")[:STORED // 2])
        names = list(self)
        for k, old in enumerate(some.tolist()):
            dict.__setitem__(out, names[old], k)
        out.text = [self.text[k] for k in some.tolist()]
        out.links = self.links_of(some)[0]
        out.n_a, out.n_b, out.n_groups, out.sound = self.n_a[some], self.n_b[some], self.n_groups[some], self.sound[some]
        out.seen = np.ones(len(some), np.int64)
        return out


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, fast binary, odd binary"


def _stored(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` as a binary column."""
    if not len(values):
        return pa.array([b""] * (len(ends) - 1), pa.binary())
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _read(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many in each row) of a column that :func:`_stored` made."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = b"" if data is None else memoryview(data)[ends[0]:ends[-1]]
    return np.frombuffer(raw, kind).astype(np.int64), np.diff(ends) // np.dtype(kind).itemsize


_loaded: dict[tuple[str, bytes], Pair] = {}


def _pair(files: tuple[str, bytes]) -> Pair:
    """The tokenizers of a worker process, loaded once: it runs many tasks."""
    if files not in _loaded:
        _loaded.clear()
        _loaded[files] = Pair(*files)
    return _loaded[files]


@C.tidy
def _aligned(batches: Iterator[pa.RecordBatch], files, digest: bool) -> Iterator[pa.RecordBatch]:
    pair = _pair(files.value)
    store = Store(pair)
    for batch in batches:
        for first, last, _, _ in C.chunks(batch.column(1), CHUNK_BYTES):
            texts = batch.column(1).slice(first, last - first).to_pylist()
            numbers = [list(map(store.__getitem__, pair.pieces(text))) if text else [] for text in texts]
            store.learn()
            if not store.sound.all():
                numbers = [_whole(store, n, text) for n, text in zip(numbers, texts)]
            yield _rows(batch.column(0).slice(first, last - first), store, numbers, digest)
            if len(store) > STORED:
                store = store.pruned()


def _whole(store: Store, numbers: list[int], text: str | None) -> list[int]:
    """The numbers of a document; where its tokens do not spell a piece, it is judged as a whole."""
    if not numbers or store.sound[numbers].all():
        return numbers
    pair = store.pair
    a, b = Lists([pair.a.encode(" " + text, add_special_tokens=False).ids]), Lists([pair.b.encode(text)])
    sound = pair.spelled([text], a, b)
    if not sound[0]:
        return []
    store[None, len(store)] = len(store)           # a number of its own that no piece has
    store.add(a, b, sound)
    return [len(store) - 1]


def _rows(ids: pa.Array, store: Store, numbers: list[list[int]], digest: bool) -> pa.RecordBatch:
    lists = Lists(numbers)
    first, which = lists.ends, lists.flat
    store.seen += np.bincount(which, minlength=len(store.seen))
    sums = [lists.sums(per_piece) if len(which) else np.zeros(len(numbers), np.int64) for per_piece in (store.n_a, store.n_b, store.n_groups)]
    links, ends = store.links_of(which)
    a = links >> 32
    fast = store.pair.same[a] == links & 0xFFFFFFFF
    held = np.r_[0, np.cumsum(fast)][ends[first]]
    texts = (";".join(map(store.text.__getitem__, n)) for n in numbers)
    if digest:
        texts = (hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts)
    return pa.RecordBatch.from_arrays([
        ids.cast(pa.int64()), *(pa.array(s, pa.int64()) for s in sums), pa.array(texts, pa.string()),
        _stored(a[fast].astype(store.pair.kind), held), _stored(links[~fast].astype("<i8"), ends[first] - held)],
        names=["doc_id", "n_a", "n_b", "n_groups", "groups", "fast", "odd"])


def vocabularies(spark: SparkSession, a_path: str, b_path: str):
    """The two vocabulary files, read on the driver and broadcast (their size is the vocabularies')."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return C.ship(spark).sparkContext.broadcast((a.read(), b.read()))


def align(docs: DataFrame, files, digest: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: token and group counts, the groups as text, and the links.

    ``groups`` reads ``a1,a2|b1;a3|b2`` ('' without tokens); with ``digest`` it is that text's sha256 in hex, so
    that the text, longer than the document, need not leave the task. ``fast`` holds the A ids of the links that the
    identity map gives (little-endian, two bytes each, four for vocabularies above 65,536), ``odd`` the other
    links as A id * 2^32 + B id (eight bytes each).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_aligned, files=files, digest=digest), _ALIGNED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``LINK_BYTES`` of links; a longer row stays whole."""
    for batch in batches:
        sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_binary(c.type))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINK_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


@C.tidy
def _fast_counts(batches: Iterator[pa.RecordBatch], size: int, kind) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in _runs(batches):
        total += np.bincount(_read(batch.column(0), kind)[0], minlength=size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["a", "n"])


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, back, np.concatenate(counts))
    return keys, n


@C.tidy
def _odd_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in _runs(batches):
        some, k = np.unique(_read(batch.column(0), "<i8")[0], return_counts=True)
        keys, n = _merged([keys, some], [n, k])
        if len(keys) > TALLY:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])


class Counts:
    """Corpus-wide link counts: vectors for fast links and heavy pairs, a table for the other pairs."""

    def __init__(self, scratch: C.Scratch, links: DataFrame, pair: Pair):
        """``links(fast, odd)`` with any other columns."""
        spark, same = links.sparkSession, pair.same
        self.same, self.kind = same, pair.kind
        self.fast, best = np.zeros(len(same), np.int64), np.zeros(len(pair.b_bytes), np.int64)
        for r in links.select("fast").mapInArrow(partial(_fast_counts, size=len(same), kind=pair.kind), "a int, n long").groupBy("a").agg(
                F.sum("n").alias("n")).collect():                                   # no more rows than A has ids
            self.fast[r["a"]] = r["n"]
        known = np.flatnonzero((same >= 0) & (self.fast > 0))
        np.maximum.at(best, same[known], self.fast[known])
        self.odd = scratch.write(links.select("odd").mapInArrow(_odd_counts, "pair long, n long").groupBy("pair").agg(
            F.sum("n").alias("n")))
        b_of = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        for r in self.odd.groupBy(b_of.alias("b")).agg(F.max("n").alias("n")).collect():   # no more rows than B has ids
            best[r["b"]] = max(best[r["b"]], r["n"])
        self.best = best
        total = self.odd.agg(F.sum("n")).first()[0] or 0
        is_heavy = F.col("n") * HEAVY > total
        heavy = self.odd.filter(is_heavy).collect()                                 # no more rows than HEAVY
        order = np.argsort(np.array([r["pair"] for r in heavy], np.int64))
        self.heavy = np.array([r["pair"] for r in heavy], np.int64)[order]
        self.heavy_n = np.array([r["n"] for r in heavy], np.int64)[order]
        tops = spark.createDataFrame([(int(k), int(best[k])) for k in np.flatnonzero(best)], "b int, top long")
        self.light = self.odd.filter(~is_heavy).withColumn("b", b_of).join(F.broadcast(tops), "b").select(
            "pair", "n", (F.col("n") == F.col("top")).alias("is_best"))

    def vectors(self):
        return self.kind, self.same, self.fast, self.best, self.heavy, self.heavy_n


def _heavy_at(pairs: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of pairs among the heavy ones."""
    if not len(heavy):
        return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = np.minimum(np.searchsorted(heavy, pairs), len(heavy) - 1)
    return at, heavy[at] == pairs


def _per_row(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``."""
    total, ends = np.r_[0, np.cumsum(values)], np.r_[0, np.cumsum(sizes)]
    return total[ends[1:]] - total[ends[:-1]]


@C.tidy
def _looked_up(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) over fast and heavy links."""
    kind, same, fast, best, heavy, heavy_n = vectors.value
    for batch in _runs(batches):
        (a, n_a), (pairs, n_pairs) = _read(batch.column(1), kind), _read(batch.column(2), "<i8")
        at, there = _heavy_at(pairs, heavy)
        n = np.where(there, heavy_n[at] if len(heavy) else 0, 0)
        top = there & (n == best[pairs & 0xFFFFFFFF])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(_per_row(n_a, fast[a] == best[same[a]]) + _per_row(n_pairs, top)),
            pa.array(_per_row(n_a, fast[a]) + _per_row(n_pairs, n))], names=["row", "n_best", "count_sum"])


@C.tidy
def _light_links(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    """(row, pair, k): the links that are neither fast nor heavy, summed in each row."""
    heavy = vectors.value[-2]
    for batch in _runs(batches):
        pairs, sizes = _read(batch.column(1), "<i8")
        row = np.repeat(np.arange(batch.num_rows), sizes)
        rest = ~_heavy_at(pairs, heavy)[1]
        row, pairs = row[rest], pairs[rest]
        order = np.lexsort((pairs, row))
        row, pairs = row[order], pairs[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])]) if len(row) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(row[first])), pa.array(pairs[first]), pa.array(np.diff(np.r_[first, len(row)]), pa.int64())],
            names=["row", "pair", "k"])


def pair_counts(counts: Counts, spark: SparkSession) -> DataFrame:
    """(a_id, b_id, n, is_best): every linked id pair of the corpus with its count."""
    fast = spark.createDataFrame([(int(a) << 32 | int(counts.same[a]), int(counts.fast[a])) for a in np.flatnonzero(counts.fast)], "pair long, n long")
    tops = spark.createDataFrame([(int(k), int(counts.best[k])) for k in np.flatnonzero(counts.best)], "b_id int, top long")
    rows = counts.odd.unionByName(fast).select(
        F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n")
    return rows.join(F.broadcast(tops), "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("is_best"))


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    files = vocabularies(spark, a_path, b_path)
    rows = scratch.write(align(docs, files, digest=True).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "fast", "odd",
        F.col("groups").alias("groups_sha256")))
    pair = Pair(*files.value)
    counts = Counts(scratch, rows, pair)
    vectors = spark.sparkContext.broadcast(counts.vectors())
    known = rows.select("row", "fast", "odd").mapInArrow(partial(_looked_up, vectors=vectors), "row long, n_best long, count_sum long")
    light = rows.select("row", "odd").mapInArrow(partial(_light_links, vectors=vectors), "row long, pair long, k long")
    rest = light.join(counts.light, "pair").select(
        "row", F.when(F.col("is_best"), F.col("k")).otherwise(0).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum"))
    sums = known.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return scratch.keep(rows.drop("fast", "odd").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"))
