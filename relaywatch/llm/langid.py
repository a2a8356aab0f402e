"""Language identification by multilingual mixture inference.

Training counts byte trigrams (hashed to ``BINS``) of every training text for
each language value, in the tasks that read the texts; Spark sums them. A
document is then a mixture: each of its trigrams was drawn from language l with
probability pi_l. Expectation-maximisation estimates the proportions for a set
of languages; the set grows by the next likely language as long as the
penalised likelihood (a logarithm of the number of trigrams for each further
language) improves. The prediction is the language of the largest proportion,
the score that proportion.

A text without any letter (Unicode), an empty and a null text are ``und`` with
score 0, and so is every text when no language was learned. Null languages and
null texts teach nothing. Each row is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm import common as C

BINS = 1 << 15
SMOOTH = 0.5
ROUNDS = 10          # EM rounds for a set of languages
DEPENDENT = 3        # a byte lies in three trigrams: their likelihoods count a third each
HELD = 512           # languages a task counts at once before it sends its counts on

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = True
_plain = np.where(_letters, C.LOWER, np.uint8(32)).astype(np.uint8)
_keys = np.random.default_rng(11).integers(0, BINS, (3, 256)).astype(np.uint16)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around every letter byte: (bins, offsets by document)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    plain = _plain[data]
    before, after = np.empty_like(plain), np.empty_like(plain)
    before[1:], after[:-1] = plain[:-1], plain[1:]
    starts = offsets[:-1][np.diff(offsets) > 0]
    before[starts] = 32
    after[np.r_[starts[1:] - 1, n - 1]] = 32
    bins = _keys[0][before] ^ _keys[1][plain] ^ _keys[2][after]
    inside = plain != 32
    count = np.r_[0, np.cumsum(inside)]
    return bins[inside], count[offsets]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def send():
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bin", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, last, data, offsets in C.chunks(batch.column(1)):
            bins, at = trigrams(data, offsets)
            for k, lang in enumerate(langs[first:last]):
                if lang not in held:
                    if len(held) >= HELD:
                        yield from send()
                    held[lang] = np.zeros(BINS, np.int64)
                held[lang] += np.bincount(bins[at[k]:at[k + 1]], minlength=BINS)
    yield from send()


class Model:
    """log P(trigram | language) for the learned languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.prob = ((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BINS)).T.astype(np.float64)


def fit(docs: DataFrame) -> Model:
    """Model of ``docs(lang, text)``; rows with a null in either teach nothing."""
    C.ship(docs.sparkSession)
    rows = docs.select("lang", "text").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    total = np.zeros((len(langs), BINS))
    if langs:
        total[np.searchsorted(langs, counts["lang"].to_numpy(str)), counts["bin"].to_numpy()] = counts["n"].to_numpy()
    return Model(langs, total)


def _mixture(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """EM proportions and log likelihood of trigram counts n under the columns of ``like``."""
    pi = np.full(like.shape[1], 1 / like.shape[1])
    total = n.sum()
    if like.shape[1] > 1:
        for _ in range(ROUNDS):
            share = like * pi
            pi = (n / share.sum(axis=1)) @ share / total
    return pi, float(n @ np.log(like @ pi))


def infer(model: Model, bins: np.ndarray) -> dict[str, float]:
    """Languages of a document and their proportions."""
    count = np.bincount(bins, minlength=BINS)
    seen = np.flatnonzero(count)
    n = count[seen].astype(float)
    like = model.prob[seen]
    pi, _ = _mixture(like, n)
    order = np.argsort(-pi, kind="stable")
    price = np.log(max(2.0, n.sum()))
    best, best_pi = -np.inf, None
    for k in range(1, len(order) + 1):
        pi, ll = _mixture(like[:, order[:k]], n)
        value = ll / DEPENDENT - price * (k - 1)
        if value <= best:
            break
        best, best_pi = value, pi
    return {model.langs[order[k]]: float(p) for k, p in enumerate(best_pi)}


def _has_letter(raw: np.ndarray) -> bool:
    if (_letters[raw] & (raw < 128)).any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        for first, last, data, offsets in C.chunks(batch.column(1)):
            bins, at = trigrams(data, offsets)
            pred, score, mixed = [], [], []
            for k in range(last - first):
                own = bins[at[k]:at[k + 1]]
                if not m.langs or not len(own) or not _has_letter(data[offsets[k]:offsets[k + 1]]):
                    shares = {}
                else:
                    shares = infer(m, own)
                top = max(shares, key=shares.get, default="und")
                pred.append(top)
                score.append(min(1.0, shares.get(top, 0.0)))
                mixed.append(sorted(shares.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "proportions"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, proportions) of ``docs(doc_id, text)``."""
    shared = C.ship(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_predict, model=shared),
                           "doc_id long, lang_pred string, score double, proportions map<string,double>")
