"""Vector codes, token alignment and sharding against brute force, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_operators import AWKWARD, frame, small_documents
from tokenizers import Tokenizer

from relaywatch.llm import sharding, token_alignment, vector_codes
from relaywatch.llm.common import Scratch

VECTORS = "vec_id long, embedding array<double>, label int, error long, part int, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, 8, "c") for i, v, label in rows], VECTORS)


def brute_codes(rows):
    """Expected rows of vectors of one width, in plain Python."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    cuts = vector_codes.bounds(len(kept[0][1]))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[r[1][a:b] for r in first] for a, b in cuts]

    def assign(q, p):
        part = q[cuts[p][0]:cuts[p][1]]
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), k) for k, entry in enumerate(books[p]))

    for _ in range(2):
        new = [list(b) for b in books]
        for p in range(16):
            groups = collections.defaultdict(list)
            for _, q, _ in kept:
                groups[assign(q, p)[1]].append(q[cuts[p][0]:cuts[p][1]])
            for k, parts in groups.items():
                new[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
        books = new
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, q, label in kept:
        found = [assign(q, p) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label, digest))
    return out


def expected(*groups):
    out = [r for rows in groups for r in brute_codes(rows)]
    total = collections.Counter()
    for _, _, error, label, _ in out:
        total[label] += error
    return sorted((i is None, i or 0, code, error, min(total[label], vector_codes.LONG), digest) for i, code, error, label, digest in out)


def as_rows(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    wide = [(k, (rng.integers(-6, 7, 32) / 7).tolist(), int(rng.integers(0, 3))) for k in range(150)]
    wide += [(200 + k, wide[3][1], None if k % 2 else 9) for k in range(60)]                 # one vector, a hot label
    wide += [(5, wide[9][1], 1), (5, wide[9][1], 1), (None, wide[4][1], None)]                # repeated and null ids
    bad = [(900, None, 1), (901, [None] + [0.5] * 31, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2)]
    narrow = [(300 + k, (rng.integers(-3, 4, 20) / 3).tolist(), 2) for k in range(12)]        # parts of two sizes, few entries
    empty = [(400, [], 1), (401, [], 4)]
    found = vector_codes.compress(vectors(spark, wide + bad + narrow + empty).repartition(5))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert as_rows(found) == expected(wide, narrow, empty)


def test_vector_codes_of_large_components_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=16) * 10.0 ** rng.integers(0, 6)).tolist(), 1) for k in range(90)]
    assert as_rows(vector_codes.compress(vectors(spark, rows).repartition(3))) == expected(rows)
    huge = vector_codes.compress(vectors(spark, [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1)])).collect()
    assert {r["code"] for r in huge} == {"00" * 16, "01" * 16}
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_equal_average_search_finds_the_first_of_the_nearest(scale):
    rng = np.random.default_rng(scale)
    for length in (1, 3, 4):
        x, book = rng.integers(-4, 5, (300, length)) * scale, rng.integers(-4, 5, (64, length)) * scale
        if scale > 1:
            x, book = x.astype(object), book.astype(object)
        which, away = vector_codes.nearest(x, book)
        all_away = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (which == np.argmin(all_away.astype(float), axis=1)).all() and (away == all_away.min(axis=1)).all()


def test_codes_decode_to_entries(spark):
    rows = [(k, [k / 10] * 16, 0) for k in range(70)]
    books = vector_codes.fit(vectors(spark, rows))
    r = vector_codes.encode(vectors(spark, rows), books).filter("vec_id = 69").first()
    q = [math.floor(256 * 6.9)] * 16
    assert sum((a - b) ** 2 for a, b in zip(q, vector_codes.decode(r["code"], books[16]))) == r["error"]


TEXTS = ["one  two   three ", " leading", "tab\t and\n  newline \n x", "a▁b c▁ d", "<|endoftext|> and <s> </s>", "é é 각 가 ﬁ ㎒", "日本語 テキスト",
         "x" * 5000, "    y", "mail@example.com, 12345 3.14 isn't we'll", "🙂 🙃🙂", "\x00 nul", "new\n\n\nlines\r\n", " ", "  ", "a ", "ab " * 3000]


def brute_alignment(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = token_alignment.byte_level()
    out, counts = [], collections.Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, groups, at_a, at_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, at_a), ends_b.index(end, at_b)
            groups.append(",".join(map(str, ids_a[at_a:i + 1])) + "|" + ",".join(map(str, ids_b[at_b:j + 1])))
            links.append((ids_a[i], ids_b[j]))
            at_a, at_b = i + 1, j + 1
        counts.update(links)
        out.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest)
            for n_a, n_b, links, digest in out], counts


def test_a_pruned_store_gives_the_same(monkeypatch):
    files = collections.namedtuple("Shared", "value")((
        open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()))
    rows = small_documents()
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    whole = pa.Table.from_batches(token_alignment._aligned(iter([batch]), files, False)).to_pylist()
    monkeypatch.setattr(token_alignment, "STORED", 300)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 20_000)
    assert pa.Table.from_batches(token_alignment._aligned(iter([batch]), files, False)).to_pylist() == whole


@pytest.mark.parametrize("heavy", [4, token_alignment.HEAVY])
def test_alignment_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(token_alignment, "HEAVY", heavy)            # few heavy pairs: most links go the way of the join
    rows = small_documents()[:60] + AWKWARD + [(500 + k, t) for k, t in enumerate(TEXTS)] + AWKWARD[3:5]
    found = token_alignment.digests(frame(spark, rows).repartition(3), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("piece_bpe_32k.model"))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted, _ = brute_alignment([t for _, t in rows])
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in r)
    assert sorted(map(key, map(tuple, found.collect()))) == sorted(key((i, *w)) for (i, _), w in zip(rows, wanted))


def test_alignment_outputs_groups_and_pairs(spark):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = small_documents()[:20]
    scratch, files = Scratch(spark), token_alignment.vocabularies(spark, *paths)
    links = scratch.write(token_alignment.align(frame(spark, rows), files))
    pair = token_alignment.Pair(*files.value)
    assert pair.cuts
    counts = token_alignment.Counts(scratch, links, pair)
    _, wanted = brute_alignment([t for _, t in rows])
    found = {(r["a_id"], r["b_id"]): r["n"] for r in token_alignment.pair_counts(counts, spark).collect()}
    assert found == dict(wanted)
    text = links.first()["groups"]
    assert all(len(g.split("|")) == 2 for g in text.split(";"))
    assert token_alignment.digests(frame(spark, []), *paths).count() == 0
    scratch.drop()


def test_alignment_without_cuts_gives_the_same(spark, monkeypatch):
    files = [open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()]
    pair, whole = token_alignment.Pair(*files), token_alignment.Pair(*files)
    whole.cuts = False
    assert pair.cuts
    for text in TEXTS:
        a, b = whole.tokens([text])
        cut_a, cut_b = pair.tokens(pair.pieces(text))
        assert cut_a.flat.tolist() == a.flat.tolist()
        if "▁" not in text:
            assert cut_b.flat.tolist() == b.flat.tolist()


def brute_shards(df, shards, tolerance, weigh):
    """Expected (doc_id, size, crc, shard, slot) by sorting everything on the driver."""
    rows = df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text").collect()
    rows = sorted(((r["h"], r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
                   for r in rows))
    weight = [r[3] if weigh else 1 for r in rows]
    before = np.concatenate([[0], np.cumsum(weight)]).astype(int).tolist()
    total, cuts = before[-1], [0]
    for s in range(1, shards):
        due = s * total / shards
        k = next(i for i in range(1, len(before)) if before[i] >= due)      # the row in which the due share is reached
        text = rows[k - 1][0]
        group = [min(i for i, r in enumerate(rows) if r[0] == text), max(i for i, r in enumerate(rows) if r[0] == text) + 1]
        away, end = min((abs(before[i] - due), i) for i in group)
        if away <= tolerance * total / shards:
            cuts.append(end)
        else:
            cuts.append(k - 1 if due - before[k - 1] <= before[k] - due else k)
    out = []
    for i, r in enumerate(rows):
        s = max(k for k, c in enumerate(cuts) if c <= i)
        out.append((r[2] if r[1] else None, r[3], r[4], s, i - cuts[s]))
    return out


def shard_rows(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("law,tolerance", [("bytes", 0.005), ("bytes", 0.2), ("rows", 0.0)])
def test_shards_equal_brute_force(spark, monkeypatch, law, tolerance):
    monkeypatch.setattr(sharding, "TASK_ROWS", 17)                  # many spans to a shard
    rows = small_documents()
    rows += AWKWARD + [(7, "the same text " * 9)] * 90 + [(800 + k, "one group " * 12) for k in range(70)] + [(1, "z" * 40000)]
    df = frame(spark, rows).repartition(4)
    found = sharding.shard(df, 16, tolerance, law, columns=["doc_id"])
    assert shard_rows(found) == sorted(brute_shards(df, 16, tolerance, law == "bytes"), key=str)
    if law == "rows":
        sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
        assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1


def test_shards_do_not_depend_on_partitions_and_keep_groups(spark):
    rows = small_documents() + AWKWARD + [(900 + k, "twice") for k in range(2)]
    one = shard_rows(sharding.shard(frame(spark, rows).coalesce(1), columns=["doc_id"]))
    assert one == shard_rows(sharding.shard(frame(spark, rows).repartition(7), columns=["doc_id"]))
    assert len({r["shard"] for r in sharding.shard(frame(spark, rows)).filter("text = 'twice'").collect()}) == 1


def test_shards_carry_columns_and_write_files(spark, scratch):
    rows = small_documents()
    clashing = frame(spark, rows).withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y")).withColumn("hash", F.lit("h"))
    out = sharding.shard(clashing, 4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "node", "part", "n", "key", "hash", *sharding.RESULT]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(rows)
    sharding.write_shards(frame(spark, rows), f"{scratch}/shards", shards=4)
    back = spark.read.parquet(f"{scratch}/shards")
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 4
    assert sharding.digests(frame(spark, [])).count() == 0
    few = sharding.digests(frame(spark, [(1, "a"), (2, None)]))
    assert few.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in few.collect()) == [
        (1, 2, zlib.crc32(b"a"), "bytes", None), (2, 1, 0, "bytes", None)]
    with pytest.raises(ValueError):
        sharding.shard(frame(spark, rows), law="key")
