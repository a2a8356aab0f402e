"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is its sequence of words (runs of letters, A-Z lowered). Each word enters
the network by word inputs (how its hashed form leans to toxic or clean labelled
documents, a learned vector) and by character inputs (the largest and the mean
lean of its four-byte grams, a learned vector of the gram that leans most). The
leans are document frequencies over the labelled training rows, summed by Spark:
all of them up to ``COUNTED``, above that those of the smallest hash draws. Only
their ids travel (a broadcast within that bound); no text is shuffled.

Two gated recurrent chains read a window of ``WINDOW`` words in both directions,
attention pools their states, and a logistic unit scores the window. Windows
start every ``STRIDE`` words, so they overlap and cover the whole text; a
document's score is that of its most toxic window.

Training is numpy on the driver, on a bounded sample (``SAMPLE`` documents of
each label with the smallest hashes, ``PICKED`` windows of each); the document's
own counts are left out of the leans it is trained with. Scoring is done in the
tasks that read the texts.

Null and empty texts, and texts without letters, score 0. Repeated labels of a
document count once (toxic if any row says so); null labels teach nothing. Each
row is scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm import common as C

WORD_BINS, GRAM_BINS = 1 << 16, 1 << 15
WINDOW, STRIDE = 64, 32
HIDDEN = 8
SAMPLE, PICKED = 1500, 3
COUNTED, DRAWS = 400_000, 4096   # labelled documents that the leans count at most; hash draws they are taken by
EPOCHS, LEAST_STEPS = 5, 250   # passes over the sample; more of a small one
PSEUDO = 4.0              # labelled documents of average toxicity added to every bin
VECTORS, WIDE = 4096, 2   # learned vectors of words and of grams
INPUT = 4 + 2 * WIDE

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = True
_gram_keys = np.random.default_rng(3).integers(0, GRAM_BINS, (4, 256)).astype(np.int64)


class Words:
    """The words of a run of documents: distinct words, their grams, and the sequence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = C.LOWER[data]
        starts, ends, self.doc = C.word_spans(low, offsets, _letters)
        hashes = C.span_hashes(low, starts, ends)
        _, at, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bin = (hashes[at] & np.uint64(WORD_BINS - 1)).astype(np.int64)
        size = ends[at] - starts[at]
        self.size = size
        grams = np.maximum(size - 3, 1)
        self.gram_at = np.r_[0, np.cumsum(grams)]
        place = np.arange(self.gram_at[-1]) - np.repeat(self.gram_at[:-1], grams) + np.repeat(starts[at], grams)
        stop = np.repeat(ends[at], grams)
        value = np.zeros(len(place), np.int64)
        for k in range(4):
            value ^= np.where(place + k < stop, _gram_keys[k][low[np.minimum(place + k, max(len(low) - 1, 0))]], 0)
        self.gram = value
        self.docs = len(offsets) - 1
        self.first = np.searchsorted(self.doc, np.arange(self.docs + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, number of words) of all overlapping windows."""
        n = np.diff(self.first)
        k = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        doc = np.repeat(np.arange(self.docs), k)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
        start = self.first[:-1][doc] + turn * STRIDE
        return doc, start, np.minimum(WINDOW, self.first[1:][doc] - start)


def _lean(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    return np.log((toxic + PSEUDO * rate) / (toxic + clean + PSEUDO) / rate)


@C.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of word and gram bins by label: (bin, toxic, clean)."""
    total = np.zeros((2, WORD_BINS + GRAM_BINS + 1), np.int64)
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in C.chunks(batch.column(1)):
            w = Words(data, offsets)
            y = label[first:last].astype(np.int64)
            pair = np.unique(w.doc * len(w.bin) + w.word) if len(w.word) else np.zeros(0, np.int64)
            doc, word = pair // max(1, len(w.bin)), pair % max(1, len(w.bin))
            n = np.diff(w.gram_at)[word]
            gram = w.gram[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.gram_at[:-1][word], n)] if len(word) else word
            size = WORD_BINS + GRAM_BINS
            seen = np.unique(np.r_[doc * size + w.bin[word], np.repeat(doc, n) * size + WORD_BINS + gram])
            np.add.at(total, (1 - y[seen // size], seen % size), 1)
            total[:, -1] += [y.sum(), (1 - y).sum()]
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])],
                                     names=["bin", "toxic", "clean"])


def _inputs(w: Words, leans: np.ndarray, gram_leans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[words, 4] fixed inputs and the bin of the gram that leans most, for given leans."""
    if not len(w.bin):
        return np.zeros((0, 4), np.float32), np.zeros(0, np.int64)
    top = np.maximum.reduceat(gram_leans, w.gram_at[:-1])
    mean = np.add.reduceat(gram_leans, w.gram_at[:-1]) / np.diff(w.gram_at)
    owner = np.repeat(np.arange(len(w.bin)), np.diff(w.gram_at))
    hit = np.flatnonzero(gram_leans == top[owner])
    which = np.zeros(len(w.bin), np.int64)
    which[owner[hit][::-1]] = w.gram[hit][::-1]
    return np.stack([leans, top, mean, np.minimum(w.size, 16) / 16], axis=1).astype(np.float32), which


@C.tidy
def _sampled(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """Training windows: fixed inputs, word bins and gram bins of the picked windows."""
    total = counts.value
    rate = total[0, -1] / max(1, total[:, -1].sum())
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for k, text in enumerate(batch.column(1).to_pylist()):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]))
            y = int(label[k])
            own = np.array([[y], [1 - y]])
            word = np.maximum(0, total[:, w.bin] - own)
            gram = np.maximum(0, total[:, WORD_BINS + w.gram] - own)
            fixed, which = _inputs(w, _lean(*word, rate), _lean(*gram, rate))
            _, start, size = w.windows()
            if not len(start):
                continue
            strong = fixed[:, 0] + fixed[:, 1]
            value = np.array([strong[w.word[s:s + n]].max() for s, n in zip(start, size)])
            for at in np.argsort(-value, kind="stable")[:PICKED]:
                seq = w.word[start[at]:start[at] + size[at]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(2).slice(k, 1).cast(pa.int64()), pa.array([y], pa.int32()),
                    pa.array([fixed[seq].tobytes()], pa.binary()),
                    pa.array([w.bin[seq].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([which[seq].astype(np.int32).tobytes()], pa.binary())],
                    names=["doc_id", "toxic", "fixed", "words", "grams"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes of the recurrent network; arrays are [time, window, unit]."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        p = {"words": rng.normal(0, 0.05, (VECTORS, WIDE)), "grams": rng.normal(0, 0.05, (VECTORS, WIDE)),
             "attend": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for side in "fb":
            p[f"w{side}"] = rng.normal(0, INPUT ** -0.5, (INPUT, 3 * h))
            p[f"u{side}"] = rng.normal(0, h ** -0.5, (h, 3 * h))
            p[f"c{side}"] = np.zeros(3 * h)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.shift = np.float32(0)

    def table(self, fixed: np.ndarray, word: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return np.concatenate([fixed, self.p["words"][word % VECTORS], self.p["grams"][gram % VECTORS]], axis=-1)

    def chain(self, gates, mask, side: str, keep: list | None = None) -> np.ndarray:
        """States of one chain; ``gates(t)`` are the input's parts of the gates at t."""
        u, h = self.p[f"u{side}"], HIDDEN
        steps, batch = mask.shape
        states = np.zeros((steps, batch, h), np.float32)
        state = np.zeros((batch, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g, a = gates(t), state @ u
            zr = _sigmoid(g[:, :2 * h] + a[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h:] + r * a[:, 2 * h:])
            new = state + mask[t][:, None] * (n + z * (state - n) - state)
            if keep is not None:
                keep.append((t, state, z, r, n, a[:, 2 * h:]))
            states[t] = state = new
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask > 0, states @ self.p["attend"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        context = (a[:, :, None] * states).sum(axis=0)
        return a, context, context @ self.p["out"] + self.p["bias"]

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Window logits of inputs [time, window, INPUT]."""
        sides = [self.chain(lambda t, s=s: x[t] @ self.p[f"w{s}"] + self.p[f"c{s}"], mask, s) for s in "fb"]
        return self.pool(np.concatenate(sides, axis=2), mask)[2]

    def gradients(self, x, mask, word, gram, y) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([
            self.chain(lambda t, s=s: x[t] @ p[f"w{s}"] + p[f"c{s}"], mask, s, kept[s]) for s in "fb"], axis=2)
        a, context, logit = self.pool(states, mask)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        out = {"bias": np.array([d.sum()]), "out": context.T @ d}
        dcontext = d[:, None] * p["out"]
        da = (states * dcontext).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        out["attend"] = (de[:, :, None] * states).sum(axis=(0, 1))
        dstates = a[:, :, None] * dcontext + de[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for k, s in enumerate("fb"):
            u, dgates = p[f"u{s}"], np.zeros((*mask.shape, 3 * h), np.float32)
            du, carry = np.zeros_like(u), np.zeros((mask.shape[1], h), np.float32)
            for t, before, z, r, n, an in reversed(kept[s]):
                dh = dstates[t, :, k * h:(k + 1) * h] + carry
                dnew, carry = mask[t][:, None] * dh, (1 - mask[t][:, None]) * dh
                dn = dnew * (1 - z) * (1 - n * n)
                dz, dr = dnew * (before - n) * z * (1 - z), dn * an * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                back = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ back
                carry = carry + dnew * z + back @ u.T
            out[f"u{s}"] = du
            out[f"w{s}"] = np.tensordot(x, dgates, axes=([0, 1], [0, 1]))
            out[f"c{s}"] = dgates.sum(axis=(0, 1))
            dx += dgates @ p[f"w{s}"].T
        for name, ids, at in (("words", word, 4), ("grams", gram, 4 + WIDE)):
            out[name] = np.zeros_like(p[name])
            np.add.at(out[name], ids % VECTORS, dx[:, :, at:at + WIDE] * mask[:, :, None])
        return out


def train(rows, rate: float, seed: int = 1) -> Network:
    """Network fitted on picked windows; a document's loss is that of its most toxic one."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(rows):
        net.p["bias"][:] = -6
        return net
    steps = WINDOW
    n = len(rows)
    fixed, word, gram = np.zeros((steps, n, 4), np.float32), np.zeros((steps, n), np.int64), np.zeros((steps, n), np.int64)
    mask = np.zeros((steps, n), np.float32)
    for k, r in enumerate(rows):
        ids = np.frombuffer(r["words"], np.int32)
        fixed[:len(ids), k] = np.frombuffer(r["fixed"], np.float32).reshape(-1, 4)
        word[:len(ids), k], gram[:len(ids), k], mask[:len(ids), k] = ids, np.frombuffer(r["grams"], np.int32), 1
    docs, owner = np.unique([r["doc_id"] for r in rows], return_inverse=True)
    label = np.zeros(len(docs), np.float32)
    label[owner] = [r["toxic"] for r in rows]
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(docs) + 1))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    turn = 0
    batch = 64
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(docs) // batch)))):
        shuffled = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            some = shuffled[at:at + batch]
            rows_of = [order[cut[d]:cut[d + 1]] for d in some]
            every = np.concatenate(rows_of)
            logit = net.logits(net.table(fixed[:, every], word[:, every], gram[:, every]), mask[:, every])
            bounds = np.cumsum([0, *map(len, rows_of)])
            worst = np.array([every[a + np.argmax(logit[a:b])] for a, b in zip(bounds, bounds[1:])])
            x = net.table(fixed[:, worst], word[:, worst], gram[:, worst])
            grads = net.gradients(x, mask[:, worst], word[:, worst], gram[:, worst], label[some])
            turn += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                step = first[k] / (1 - 0.9 ** turn) / (np.sqrt(second[k] / (1 - 0.99 ** turn)) + 1e-7)
                net.p[k] = (net.p[k] - 0.02 * step).astype(np.float32)
    seen = float(np.clip(label.mean(), 0.01, 0.99))
    rate = float(np.clip(rate, 0.001, 0.99))
    net.shift = np.float32(np.log(rate / (1 - rate)) - np.log(seen / (1 - seen)))
    return net


def _drawn(labelled: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of the lowest draws that stay within ``most`` (``COUNTED``) ids: a bound for their broadcast."""
    per_draw = {r["draw"]: r["n"] for r in labelled.groupBy("draw").agg(F.count("*").alias("n")).collect()}
    below, held = 0, 0
    for below in range(DRAWS + 1):
        held += per_draw.get(below, 0)
        if held > (COUNTED if most is None else most):
            break
    return labelled.filter(F.col("draw") < below).select("doc_id", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, np.ndarray]:
    """(network, counts) learned from ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``."""
    spark = C.ship(docs.sparkSession)
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    scratch = C.Scratch(spark)
    with_text = scratch.write(marked.join(texts.select("doc_id"), "doc_id", "left_semi").withColumn(
        "draw", F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS)).cast("int")))
    known = texts.join(F.broadcast(_drawn(with_text)), "doc_id").select("toxic", "text", "doc_id")   # COUNTED ids
    sums = known.select("toxic", "text").mapInArrow(_count, "bin int, toxic long, clean long").groupBy("bin").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    counts = np.zeros((2, WORD_BINS + GRAM_BINS + 1))
    counts[0, sums["bin"]], counts[1, sums["bin"]] = sums["toxic"], sums["clean"]
    rate = counts[0, -1] / max(1.0, counts[:, -1].sum())
    picked = with_text.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).unionByName(
        with_text.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)).select("doc_id", "toxic")
    sample = texts.join(F.broadcast(picked), "doc_id").select("toxic", "text", "doc_id")   # 2 * SAMPLE ids
    shared = spark.sparkContext.broadcast(counts)
    rows = sample.mapInArrow(partial(_sampled, counts=shared),
                             "doc_id long, toxic int, fixed binary, words binary, grams binary")
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["toxic"], r["words"]))
    scratch.drop()
    return train(rows, rate), counts


def _scores(w: Words, net: Network, leans: np.ndarray, gram_leans: np.ndarray) -> np.ndarray:
    """Score of each document of ``w``: that of its most toxic window, 0 without words."""
    fixed, which = _inputs(w, leans[w.bin], gram_leans[w.gram])
    table = net.table(fixed, w.bin, which)
    gates = {s: table @ net.p[f"w{s}"] + net.p[f"c{s}"] for s in "fb"}
    doc, start, size = w.windows()
    worst = np.full(w.docs, -np.inf, np.float32)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), 4096):
        some = order[at:at + 4096]
        steps = int(size[some].max())
        place = np.minimum(start[some][None, :] + np.arange(steps)[:, None], len(w.word) - 1)
        mask = (np.arange(steps)[:, None] < size[some][None, :]).astype(np.float32)
        word = w.word[place]
        states = [net.chain(lambda t, s=s: gates[s][word[t]], mask, s) for s in "fb"]
        np.maximum.at(worst, doc[some], net.pool(np.concatenate(states, axis=2), mask)[2])
    return np.where(np.isfinite(worst), _sigmoid(worst + net.shift), 0.0).astype(float)


@C.tidy
def _score(batches: Iterator[pa.RecordBatch], model, into: str) -> Iterator[pa.RecordBatch]:
    net, leans, gram_leans = model.value
    for batch in batches:
        for first, last, data, offsets in C.chunks(batch.column(1)):
            score = _scores(Words(data, offsets), net, leans, gram_leans)
            yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns), pa.array(score)],
                                             names=[*batch.schema.names, into])


def score(docs: DataFrame, model: tuple[Network, np.ndarray], text: str = "text",
          into: str = "score") -> DataFrame:
    """``docs`` with a column ``into`` of scores, 0 to 1; a column of that name is replaced."""
    net, counts = model
    rate = float(np.clip(counts[0, -1] / max(1.0, counts[:, -1].sum()), 0.001, 0.99))
    every = _lean(counts[0], counts[1], rate).astype(np.float32)
    shared = C.ship(docs.sparkSession).sparkContext.broadcast((net, every[:WORD_BINS], every[WORD_BINS:-1]))
    others = [c for c in docs.columns if c != text and c.lower() != into.lower()]
    rows = docs.select(others[0] if others else F.lit(0).alias("_row"), text, *others[1:])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(partial(_score, model=shared, into=into), f"{kinds}, `{into}` double")
