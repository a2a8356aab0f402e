"""The ten operators against brute force, on small frames with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
from tokenizers import Tokenizer

from conftest import SF_SMALL
from relaywatch.llm import (bpe, catalog, decontaminate, embedding_dedup, langid, licenses, minhash_dedup, packing, secret_scan,
                            suffix_dedup, toxicity)
from relaywatch.llm.common import Scratch

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, part int, n long, key string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, 1, 2, 3, "k") for i, t in rows], SCHEMA)


def small_documents():
    t = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


AWKWARD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one two"), (9005, "one two"), (9006, "%% !! --"), (None, "lost id")]


def corpus():
    rows = small_documents()
    return rows + AWKWARD + rows[:3]      # some rows twice


def components(ids, links):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[40:] = x[:20] + rng.normal(size=(20, 8)) * 0.25
    x[30] = x[31]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [None] * 8, 1), (None, x[0].tolist(), 1),
             (104, [1.0, 2.0], 1), (105, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, block=8).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    parts = components(range(60), [(i, j) for i, j in zip(*np.nonzero(hit)) if i < j])
    assert {i: (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(60)} == {
        i: (int(hit[i].sum()) - 1, parts[i], parts[i] == i) for i in range(60)}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (100, 101, 102, 103, 104, 105))
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 40)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 6)), 4, axis=0) + rng.normal(size=(240, 6)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(df, block=16).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.9).sum(axis=1))}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup_of_several_lengths_and_repeated_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 30)
    rng = np.random.default_rng(6)
    rows = []
    for width, n in ((6, 160), (4, 120), (9, 2)):
        x = np.repeat(rng.normal(size=(n // 2, width)), 2, axis=0) + rng.normal(size=(n, width)) * 0.15
        rows += [v.astype(np.float32).tolist() for v in x]
    rows += [rows[0]] * 9 + [rows[200]] * 5
    ids = [i if i % 7 else i // 2 for i in range(len(rows))]      # some ids twice, with other vectors
    df = spark.createDataFrame(list(zip(ids, rows)), f"vec_id long, embedding array<{kind}>")
    got = collections.Counter(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df, block=16).collect())
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    hits = [[j for j in range(len(rows)) if j != i and len(rows[j]) == len(rows[i]) and unit[i] @ unit[j] >= 0.9]
            for i in range(len(rows))]
    part = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in hits[i]])
    least = {}
    for i, p in part.items():
        least[p] = min(least.get(p, ids[i]), ids[i])
    assert got == collections.Counter((ids[i], len(hits[i]), least[part[i]], ids[i] == least[part[i]]) for i in range(len(rows)))
    pair = spark.createDataFrame([(2, [1.0, 0.0], "a"), (1, [1.0, 0.1], "b"), (3, None, "c")], f"vec_id long, embedding array<{kind}>, links string")
    assert sorted(r["vec_id"] for r in embedding_dedup.one_per_group(pair).collect()) == [1, 3]


def brute_secrets(text):
    spans = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def reached(found, text):
    """Spans of the method by plain search: every target by itself, over all assignments."""
    spans = set()
    for name, terms in found:
        weight = secret_scan.name_weight(name)
        level, seen = [(t, "literal") for t in terms] if weight else [], set()
        while level:
            following = []
            for term, kind in level:
                value = text[term[0]:term[1]]
                key = value.split(".")[-1]
                named = not term[2] and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", value) and any(n.split(".")[-1] == key for n, _ in found)
                if named and key not in seen:
                    seen.add(key)
                    following += [(t, "constant") for n, ts in found if n.split(".")[-1] == key for t in ts]
                elif not named and weight * secret_scan.literal_weight(value, term[2]) >= secret_scan.LEAST_SCORE:
                    spans.add((term[0], kind, term[1]))
            level = following
    return spans


def test_secrets_by_propagation_equal_a_plain_search():
    rng = random.Random(8)
    names = ["password", "db.token", "auth", "x", "y", "cfg.z", "w", "private_key", "note"]
    values = ["'Zk29-ddPq!8', 'aa'", '"hunter2X9"', "Qq77wert1", "x", "y", "cfg.z", "z", "w", "password", "token", '"plain"', "changeme", "x + y",
              "\"\"\"Ab12-Cd34\n  Ef56+Gh78 \"\"\""]
    for _ in range(300):
        text = "\n".join(f"{rng.choice(names)}{rng.choice([' = ', ': ', ' := ', ' => '])}{rng.choice(values)}" for _ in range(rng.randint(1, 14)))
        assert secret_scan.lexed_spans(text) == reached(secret_scan.pairs(text), text), text


def test_secrets_in_long_and_block_literals():
    def texts(text):
        return [text[a:b] for a, kind, b in secret_scan.find(text)[1] if kind in ("literal", "constant")]
    assert texts("db_passphrase = \'\'\'\n  Ab12-Cd34\n\n  Ef56+Gh78\n\'\'\'\n") == ["Ab12-Cd34", "Ef56+Gh78"]
    assert texts("a:\n  credential: |\n    Ab12-Cd34\n\n    Ef56+Gh78\n  other: Zz99-Yy88\n") == ["Ab12-Cd34", "Ef56+Gh78"]
    assert texts("credential: >-\n  some words of prose 12\n") == []
    assert texts("n" * 300 + "_credential = 'Ab12-Cd34'") == ["Ab12-Cd34"]
    assert texts("credential = \'\'\'never closed Ab12") == []


def test_secrets_of_a_long_chain_take_time_in_proportion():
    n = 40_000
    chain = "\n".join(f"token_{i} = token_{i + 1}" for i in range(n)) + f"\ntoken_{n} = 'Ab12-Cd34-Ef'\n"
    assert len(chain) > 1_000_000
    started = time.process_time()
    spans = secret_scan.lexed_spans(chain)
    assert time.process_time() - started < 8
    at = chain.index("Ab12")
    assert spans == {(at, "literal", at + 12), (at, "constant", at + 12)}


def test_secret_scan(spark):
    rows = corpus() + [(8101, 'token=token:abcdefg "api_key" = "Zz9/+abc" é AKIA' + "A" * 16 + " " + "0f" * 12),
                       (8102, 'K = "s3cretValue99"\nconn.pwd = K\nother = "s3cretValue98"\n')]
    df = frame(spark, rows)
    got = collections.Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.scan(df).collect())
    assert got == collections.Counter((i, hashlib.sha256(brute_secrets(t or "").encode()).hexdigest()) for i, t in rows)
    assert secret_scan.find(rows[-1][1])[1] == [(5, "constant", 18)]
    assert secret_scan.redacted("a password=abcdef1 b") == "a [secret] b"
    red = secret_scan.redact(df).filter("doc_id = 8102").first()
    assert "s3cretValue99" not in red["text"] and "s3cretValue98" in red["text"] and red["key"] == "k"
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["ta", "lo", "mi", "re", "su", "na"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(5, 150))
        if i % 4 == 0:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["grumbolt", "grumvex", "Grumpad,"])
        rows.append((i, " ".join(words)))
    df = frame(spark, rows + AWKWARD)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(0, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df.filter("doc_id % 3 > 0"), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).select("doc_id", "score").collect()}
    held = [i for i, _ in rows if i % 3 == 0]
    right = sum((got[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    assert got[9001] == got[9002] == got[9006] == 0.0 and all(0 <= s <= 1 for s in got.values())
    nothing = toxicity.fit(df.limit(0), labels)
    assert toxicity.score(df, nothing).count() == len(rows) + len(AWKWARD)


def test_toxicity_windows_overlap_and_cover():
    text = " ".join(f"w{'x' * (k % 7)}" for k in range(500)).encode()
    raw = np.frombuffer(text, np.uint8)
    w = toxicity.Words(raw, np.array([0, len(raw)]))
    _, start, size = w.windows()
    seen = np.zeros(len(w.word), int)
    for s, n in zip(start, size):
        seen[s:s + n] += 1
    assert seen.min() >= 1 and seen.max() >= 2


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    word, gram = rng.integers(0, 50, (5, 3)), rng.integers(0, 50, (5, 3))
    fixed, y = rng.normal(size=(5, 3, 4)).astype(np.float32), np.array([1, 0, 1], np.float32)
    mask = np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    x = net.table(fixed, word, gram)
    grads = net.gradients(x, mask, word, gram, y)

    def loss():
        z = net.logits(net.table(fixed, word, gram), mask).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))
    for name in ("uf", "wb", "attend", "out", "cb"):
        p = net.p[name]
        at = tuple(rng.integers(0, s) for s in p.shape)
        keep, eps = p[at], 1e-2
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3


def brute_repeats(rows):
    first, out = {}, []
    named = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in named:
        for p in range(len(raw) - 99 if i is not None else 0):
            s = raw[p:p + 100]
            first[s] = min(first.get(s, (i, p)), (i, p))
    for i, raw in named:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99 if i is not None else 0):
            if first[raw[p:p + 100]] < (i, p):
                gone[p:p + 100] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_suffix_dedup(spark):
    rows = corpus()
    rows += [(7001, "ab" * 300), (7002, "x" * 99), (7003, "x" * 250), (7004, "é" * 80 + "\0" * 130), (7005, "z" + "é" * 80 + "\0" * 130),
             (7001, "other text under an id that repeats " * 5)]
    got = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_strings_around_a_common_line_are_dealt_one_by_one(spark):
    """A line in every document with other text around it: no part gets it whole, and the result is the same."""
    import pyarrow as pa
    rng = random.Random(8)
    line = "Licensed under the terms of the common notice, version 2.0, see the file."
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(150)) + line + "".join(rng.choice("abcdefgh ") for _ in range(150))) for k in range(200)]
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    wanted, grams = [], collections.Counter()
    for d in data:
        gram, at, lo, hi = suffix_dedup.anchors(d, np.array([0, len(d)]))
        wanted.append((at << 16 | (at - lo) << 8 | (at - hi)).tolist())
        grams.update(gram.tolist())
    common = np.array([g for g, n in grams.items() if n > 50], np.uint64)
    assert len(common)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows), pa.int64()),
                                        pa.array([t for _, t in rows]), pa.array(wanted, pa.list_(pa.int64()))], names=list("ikta"))
    held = collections.Counter()
    for sent in suffix_dedup._send_runs(iter([batch]), 8, common):
        for part, block in zip(sent.column(0).to_pylist(), sent.column(1).to_pylist()):
            arrays = suffix_dedup._unpack(block)
            held[part] += len(arrays[4]) if len(arrays[0]) == 2 else 0
    assert len(held) == 8 and max(held.values()) < 1.5 * min(held.values())

    rows += [(300 + k, t[100:300] + t[:140]) for k, t in rows[:20]]
    rows += [(7001, "ab" * 300), (7003, "x" * 250), (7004, "x" * 250), (7001, "other text under an id that repeats " * 5),
             (7005, line * 3), (7005, line * 3), (None, line * 3), (7006, None)]
    for many in (0, 30):
        got = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows), many=many).collect())
        assert got == brute_repeats(rows)


def test_long_texts_come_in_overlapping_pieces(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    import pyarrow as pa
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    pieces = list(suffix_dedup._pieces(pa.array([base, "short"])))
    found = set()
    for first, at, data, offsets in pieces:
        gram, place, lo, hi = suffix_dedup.anchors(data, offsets)
        found |= {(first, at + s) for a, b in zip(lo.tolist(), hi.tolist()) for s in range(a, b + 1)}
    assert found == {(0, s) for s in range(len(base) - 99)}


def test_loser_tree_merge():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))]

        def lcp(a, b):
            return next((i for i in range(6) if a[i] != b[i]), 6)
        order, shared = suffix_dedup.merge_runs(runs, [[0] + [lcp(x, y) for x, y in zip(r, r[1:])] for r in runs])
        out = [runs[r][i] for r, i in order]
        assert out == sorted(x for r in runs for x in r)
        assert shared[1:] == [lcp(x, y) for x, y in zip(out, out[1:])]


def shingles(text, width, pattern=None):
    words = regex.findall(pattern, (text or "").lower()) if pattern else [
        w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_decontaminate(spark):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pylist()]
    items += [(900, None), (901, ""), (902, "One, TWO!"), (903, "tiny item of just five words now"), (904, items[0][1])]
    rows = corpus() + [(8001, "start " + items[0][1].upper() + " end"), (8002, " ".join(items[1][1].split()[1:])),
                       (8003, "he said: tiny item of just five words now, and left")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, shingles int")
    got = {tuple(r) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    held = {i: shingles(t, 5, r"[\p{L}\p{N}]+") for i, t in items}
    want = set()
    for i, t in rows:
        own = shingles(t, 5, r"[\p{L}\p{N}]+")
        for j, s in held.items():
            if s and 100 * len(s & own) >= 80 * len(s):
                want.add((i, j, len(s & own), len(s), len(s & own) / len(s)))
    assert got == want and {(8001, 0), (8001, 904), (8003, 903)} <= {x[:2] for x in got}
    kept = decontaminate.without_contaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(
        i for i, _ in rows if i not in {x[0] for x in want})
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


def test_decontaminate_finds_scattered_items(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(4000)]
    items, rows = [], []
    for j in range(120):
        words = rng.sample(vocabulary, rng.randint(8, 64))
        items.append((j, " ".join(words)))
        cut = [words[k:k + 5] for k in range(len(words) - 4)]
        rng.shuffle(cut)
        keep = cut[:rng.randint(len(cut) * 7 // 10, len(cut))]
        text = " ".join(" ".join([*c, *rng.sample(["alpha", "beta", "gamma", "delta"], 3)]) for c in keep)
        rows.append((j, text))
    rows += [(500 + j, t) for j, t in rows[:20]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    held = {i: shingles(t, 5, r"[\p{L}\p{N}]+") for i, t in items}
    want = set()
    for i, t in rows:
        own = shingles(t, 5, r"[\p{L}\p{N}]+")
        want |= {(i, j, len(s & own), len(s)) for j, s in held.items() if 100 * len(s & own) >= 80 * len(s)}
    assert got == want and 60 < len(want) < 140
    clash = frame(spark, rows).withColumnRenamed("key", "_hit").withColumnRenamed("part", "row_key")
    kept = decontaminate.without_contaminated(clash, bench)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {w[0] for w in want}


def test_license_scan(spark):
    rows = corpus() + [(1, "MIT License. See the Apache-License; GNU General Public\nLicense, version 3"), (2, "license mit license license"),
                       (3, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (4, "mit\x80license mit éa license")]
    got = collections.Counter(tuple(r)[:6] for r in licenses.scan(frame(spark, rows)).collect())
    want = collections.Counter()
    for i, t in rows:
        words = re.findall(licenses.WORD, (t or "").translate(UPPER))
        at = [(k, label) for label, phrase in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
        want[(i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    assert got == want
    scored = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).filter("doc_id in (1, 3, 9001)").collect()}
    assert scored[3]["labels"] == "mit-text" and scored[3]["score"] > 0 and scored[9001]["score"] == 0
    assert "gpl-3.0" in scored[1]["labels"]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_language_id(spark):
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs] + [(None, "x", None), (1, None, "en")],
                               "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect() if r["doc_id"] is not None and r["lang_pred"] != "und"}
    held = [r for r in docs if r["doc_id"] % 3 == 1 and r["doc_id"] in got]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    odd = langid.predict(frame(spark, AWKWARD + [(1, "№ 12 ½"), (2, "漢字")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in odd}.items() >= {9001: True, 9002: True, 9003: True, 9006: True, 1: True, 2: False}.items()
    by_lang = {r["lang"]: r["text"] for r in docs if r["n_chars"] > 2000}
    if {"en", "fr"} <= set(by_lang):
        mixed = spark.createDataFrame([(1, by_lang["en"][:1500] + " " + by_lang["fr"][:1500])], "doc_id long, text string")
        shares = langid.predict(mixed, model).first()["proportions"]
        assert shares["en"] > 0.3 and shares["fr"] > 0.3
    empty = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_dedup(spark, width):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    common = rng.choices(words, k=40)
    rows = corpus()
    base = rng.choices(words, k=120)
    for k in range(30):
        near = list(base)
        for _ in range(k // 5):
            near[rng.randrange(120)] = rng.choice(words)
        rows.append((5000 + k, " ".join(near)))
        rows.append((6000 + k, " ".join(common + rng.choices(words, k=30))))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash_dedup.near_duplicates(frame(spark, rows), width=width).collect()}
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = components(ids, links)
    want = {(i, len(sets[i]), part[i], part[i] == i) for i in ids} | {(None, 1, None, True)}
    assert got == want
    assert minhash_dedup.near_duplicates(frame(spark, []), width=width).count() == 0


def test_minhash_of_ids_that_repeat(spark):
    """An id with several texts links by each of them, whichever row comes first."""
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(4)]
    near = [" ".join(w[:30] + ["other"] + w[30:]) for w in words]
    a, *b = (" ".join(w) for w in words)
    rows = [(1, a)] + [(1, t) for t in b] + [(k + 2, t) for k, t in enumerate(b)] + [(k + 5, t) for k, t in enumerate(near[1:])] + [(9, "far off " * 9)]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = minhash_dedup.near_duplicates(frame(spark, some), width=4).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {**{k: 1 for k in range(1, 8)}, 9: 9}
        assert len(got) == len(rows)


@pytest.mark.parametrize("edits", [3, 6])
def test_minhash_across_components(spark, edits):
    """Crowds at one shingle: independent and shared edits of a text, and a passage in other texts."""
    rng = random.Random(edits)
    words = [f"w{k}" for k in range(3000)]
    base, passage = rng.choices(words, k=100), rng.choices(words, k=70)
    changes = [(k, rng.choice(words)) for k in rng.sample(range(100), 12)]
    rows = []
    for k in range(40):
        alone, alike = list(base), list(base)
        for _ in range(rng.randrange(1, edits)):
            alone[rng.randrange(100)] = rng.choice(words)
        for at, word in rng.sample(changes, edits):
            alike[at] = word
        rows += [(1000 + k, " ".join(alone)), (2000 + k, " ".join(alike)), (4000 + k, " ".join(alone[rng.randrange(20):])),
                 (3000 + k, " ".join(passage + rng.choices(words, k=rng.randrange(2, 40))))]
    sets = {i: shingles(t, 5) for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    ids = sorted(first.values())
    docs = spark.createDataFrame([r for r in rows if r[0] in set(ids)], "doc_id long, text string")
    feats = docs.mapInArrow(partial(minhash_dedup._features, width=5, collections=20, rows=3), minhash_dedup._FEATURES)
    nodes = feats.selectExpr("doc_id as node", "doc_id as part", "n_shingles as n", "bits as x")
    held = docs.mapInArrow(partial(minhash_dedup._sets, width=5), minhash_dedup._SETS)
    scratch = Scratch(spark)
    got = minhash_dedup._across(scratch, scratch.write(nodes), scratch.write(held), 80, minhash_dedup._possible(80, 120)).collect()
    scratch.drop()
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got}
    assert links and found <= links
    assert components(ids, found) == components(ids, links)


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, ref = bpe.load(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "aaabcde  \n\t'st\x1c\x85\xa0 .,!?19²½éÉñß漢字ع🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "x" * 3000, "antidisestablishmentarianism" * 9]
    texts += [t for _, t in small_documents()[:60]]
    for text, ids in zip(texts, own.encode_all(texts)):
        enc = ref.encode(text, add_special_tokens=False).ids
        assert ids == enc and own.decode(ids) == ref.decode(enc, skip_special_tokens=False)
    df = frame(spark, [(1, "hello world"), (2, None), (None, "")])
    out = bpe.decode(bpe.encode(df.selectExpr("*", "1 AS IDS", "'x' AS decoded"), path), path)    # names that clash
    assert [(r["text"], r["decoded"]) for r in out.collect()] == [("hello world", "hello world"), (None, ""), ("", "")]
    assert bpe.digests(df.limit(0), path).count() == 0


def test_packing_is_lossless(spark):
    import tiktoken
    rows = [(i, t) for i, t in small_documents()[:80]] + [(9001, None), (9002, ""), (None, "lost")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    packed = packing.pack(frame(spark, rows), path, public_tokenizers.PATTERN, length=128, block=5000).cache()
    ranks = packing.load_ranks(path)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = collections.defaultdict(dict)
    for r in packing.unpack(packed).collect():
        parts[r["doc_id"]][r["part"]] = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in parts.items()} == {
        i: coder.encode_ordinary(t or "") + [50256] for i, t in rows}
    for r in packed.collect():
        assert len(r["ids"]) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128
        assert r["resets"] == [c for c in r["cu_seqlens"] if c < 128]
    assert packing.pack(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_best_fit_decreasing_matches_a_plain_search():
    rng = random.Random(8)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 50) - s)
    rows = packing.best_fit_decreasing(sizes, 50)
    assert sorted(k for r in rows for k in r) == list(range(400))
    assert sorted(50 - sum(sizes[k] for k in r) for r in rows) == sorted(rooms)


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()] == list(range(1, 11))
