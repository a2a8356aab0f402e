"""MinHash near-dedup with tensored banding.

A document's set holds its distinct shingles of ``width`` words (A-Z lowered,
words split at the six ASCII spaces; a shorter text is one shingle, an empty
or null one has the empty set and links with nothing). Documents link when
``100 * |a & b| >= percent * |a | b|``; the result gives each document the
smallest id reachable by links.

Tensored banding: instead of a separate band for each table, two groups of
``collections`` small hash collections (``rows`` minhashes each) are computed
and every pair (one of the first group, one of the second) is the key of a
table: collections**2 tables from 2 * collections * rows minhashes. A pair of
sets of similarity s meets in at least one table with probability
(1 - (1 - s**rows)**collections)**2, 0.9999988 at s = 0.8 with the defaults.

Only collection values that at least two sets share can form a shared key, so
values held by one set are left out before the keys are formed.

Bounded work in hot groups: equal sets are one node from the start. In a table
bucket every set is paired with the smallest id of the bucket only; those star
pairs are verified and merged first. Pairs of a bucket whose ends are connected
by then need no look. The nodes of buckets that still hold several components
are compared across components by their rarest shingles. Where more than
``DIRECT`` nodes of like size meet at a shingle they are not paired: each is
compared with one set there, its centre (the one whose shingles are the most
common), and two of them are paired only if they share rare elements of their
differences from the centre (see ``_by_centre``). A passage of
which many documents consist in part makes no pairs, and no link is lost. Every
link is confirmed on the full sets.

Rows with a null id come back with a null component and ``kept`` true. Rows
that repeat an id are one document each for ``n_shingles`` and for links; they
share the component of the id. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm import common as C
from relaywatch.llm.common import Scratch, tidy
from relaywatch.llm.components import connected_components

COLLECTIONS = 20   # hash collections in each of the two groups
ROWS = 3           # minhashes in a collection
WIDTH = 4          # words in a shingle of the contract query
PERCENT = 80
FINE = 256         # minhashes that tell pairs across components apart before their sets are read
DIRECT = 16        # nodes at a rare shingle that are paired directly; more go by their centre

_FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, near array<long>"
_SETS = "doc_id long, shingles array<long>, fine array<long>"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted: (hashes, offsets)."""
    low = C.LOWER[data]
    starts, ends, doc = C.word_spans(low, offsets, ~C.SPACE)
    words = C.span_hashes(low, starts, ends)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.r_[0, np.cumsum(count)]
    n = len(words)
    if n == 0:
        return words, np.zeros(n_docs + 1, np.int64)
    padded = np.r_[words, np.zeros(width, np.uint64)]
    inside = np.arange(n) - first[doc]
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            more = (inside + k < count[doc])
            step = np.where(more, padded[k:k + n], np.uint64(0))
            value = C.mix64(value * np.uint64(0x9E3779B97F4A7C15) + step + more)
    whole = inside + width <= count[doc]
    whole |= (inside == 0)
    value, doc = value[whole], doc[whole]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    value, doc = value[new], doc[new]
    return value, np.r_[0, np.cumsum(np.bincount(doc, minlength=n_docs))]


def minhashes(shingles: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """[documents, n] minima of n hash functions; rows of empty sets are zero."""
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 2**32, (n, 2), dtype=np.uint64).astype(np.uint32)
    low = shingles.astype(np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    if not len(some):
        return out
    at = offsets[some]
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (low ^ keys[k, 0]) * (keys[k, 1] | np.uint32(1))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[some, k] = np.minimum.reduceat(h, at)
    return out


def _collection_values(minima: np.ndarray, rows: int) -> np.ndarray:
    """[documents, collections] 64-bit value of each collection, distinct by collection."""
    docs, n = minima.shape
    value = np.arange(n // rows, dtype=np.uint64)[None, :].repeat(docs, 0)
    with np.errstate(over="ignore"):
        for k in range(rows):
            value = C.mix64(value * np.uint64(0x9E3779B97F4A7C15) + minima[:, k::rows].astype(np.uint64) + np.uint64(1))
    return value


def _sketch(minima: np.ndarray) -> pa.Array:
    """Four bits of each minhash, sixteen to a long."""
    docs, used = minima.shape
    bits = np.zeros((docs, -(-used // 16) * 16), np.uint8)
    bits[:, :used] = (minima >> np.uint32(16)) & 15
    longs = np.ascontiguousarray(bits[:, ::2] << 4 | bits[:, 1::2]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * longs.shape[1], pa.int32()), pa.array(longs.ravel()))


def _digest(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[2, documents] sums that name each set; zero for empty sets."""
    some = np.flatnonzero(np.diff(at))
    digest = np.zeros((2, len(at) - 1), np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            digest[0, some] = np.add.reduceat(C.mix64(shingles), at[some])
            digest[1, some] = np.add.reduceat(C.mix64(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)), at[some])
    return digest


@tidy
def _features(batches: Iterator[pa.RecordBatch], width: int, collections: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in C.chunks(batch.column(1)):
            shingles, at = shingle_hashes(data, offsets, width)
            n = np.diff(at)
            digest = _digest(shingles, at)
            minima = minhashes(shingles, at, 2 * collections * rows)
            values = _collection_values(minima, rows).view(np.int64)
            near = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.where(n > 0, values.shape[1], 0))], pa.int32()),
                pa.array(values[n > 0].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                 _sketch(minima), near],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "near"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sets of (doc_id, text); with columns set_a and set_b, only of the texts whose set has that digest."""
    for batch in batches:
        for first, last, data, offsets in C.chunks(batch.column(1)):
            shingles, at = shingle_hashes(data, offsets, width)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first).cast(pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shingles.view(np.int64))),
                 _sketch(minhashes(shingles, at, FINE))],
                names=["doc_id", "shingles", "fine"])
            if batch.num_columns > 2:
                named = np.stack([batch.column(k).slice(first, last - first).to_numpy() for k in (2, 3)])
                out = out.filter(pa.array((_digest(shingles, at).view(np.int64) == named).all(axis=0)))
            yield out


def _shared_keys(nodes: DataFrame, collections: int) -> DataFrame:
    """(key, node): table keys of collection values that two nodes or more hold."""
    values = nodes.select("node", F.posexplode("near").alias("c", "value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select("value")
    left = values.join(shared, "value").groupBy("node").agg(
        F.collect_list(F.when(F.col("c") < collections, F.col("value"))).alias("first"),
        F.collect_list(F.when(F.col("c") >= collections, F.col("value"))).alias("second"))
    return left.select("node", "second", F.explode("first").alias("a")).select(
        "node", "a", F.explode("second").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node")


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, node, head) for buckets of two nodes or more, head the smallest node."""
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head <> tail")
    return keys.join(heads.select("key", "head"), "key").select("key", "node", "head")


def _possible(percent: int, hashes: int) -> str:
    """SQL condition: sizes and four-bit minhashes of nodes a and b leave a link possible.

    Sizes are a sharp bound. Four-bit minhashes agree with probability
    J + (1 - J)/16; the bound lies 5 standard deviations below the threshold's.
    """
    p = percent / 100 + (1 - percent / 100) / 16
    bound = hashes * (1 - p) + 5 * (hashes * p * (1 - p)) ** 0.5
    differ = []
    for k in range(-(-hashes // 16)):
        e = f"(get(xa, {k}) ^ get(xb, {k}))"
        folded = " | ".join([e, *[f"shiftrightunsigned({e}, {i})" for i in (1, 2, 3)]])
        differ.append(f"bit_count(({folded}) & {0x1111111111111111}L)")
    return f"least(na, nb) * 100 >= greatest(na, nb) * {percent} and {' + '.join(differ)} <= {bound}D"


def _agreeing(pairs: DataFrame, sketch: DataFrame, possible: str) -> DataFrame:
    a = sketch.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa"))
    b = sketch.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb"))
    return pairs.join(a, "a").join(b, "b").filter(possible).select("a", "b", "na", "nb")


def _open_nodes(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, part) of the nodes that share a bucket with another component."""
    every = buckets.select("key", "node").unionByName(buckets.select("key", F.col("head").alias("node")))
    placed = every.join(parts, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("key")
    return placed.join(mixed, "key").select("node", "part").distinct()


def _rarest(rows: DataFrame, key: list[str], owner: list[str], element: str) -> DataFrame:
    """(owner, held): elements that several rows of ``key`` hold, rarest first."""
    shared = rows.groupBy(*key).agg(F.count("*").alias("f")).filter("f > 1")
    return rows.join(shared, key).groupBy(*owner).agg(
        F.array_sort(F.collect_list(F.struct("f", element))).alias("held"))


def _across(scratch: Scratch, nodes: DataFrame, sets: DataFrame, percent: int, possible: str) -> DataFrame:
    """Linked pairs (a, b) of ``nodes`` in different components; loses none that joins components.

    Of two sets similar enough, the ``n - ceil(n * percent / 100) + 1`` rarest
    shingles of each (rarest among these nodes) share one.
    """
    rows = sets.select(F.col("doc_id").alias("node"), F.explode("shingles").alias("s"))
    # shingles of one node only come first in the order; the rest of the prefix is taken from the shared ones
    prefix = nodes.join(_rarest(rows, ["s"], ["node"], "s"), "node").withColumn(
        "take", F.expr(f"cast(n - ceil(n * {percent} / 100) + 1 - (n - size(held)) as int)")).filter("take > 0")
    # linked sets lie in one size class or two neighbours: a group g at a shingle has those of classes g and g + 1
    step = 1.001 * max(0.01, math.log(100 / percent))
    prefix = prefix.selectExpr(
        "node", "part", "n", "x", "aggregate(held, 0D, (t, h) -> t + ln(h.f)) / n as common",
        f"cast(floor(ln(n) / {step}) as int) as class", "explode(slice(held, 1, take)) as h")
    prefix = scratch.write(prefix.selectExpr("node", "part", "n", "x", "common", "class", "h.s", "explode(array(class, class - 1)) as g"))
    meets = scratch.write(prefix.groupBy("s", "g").agg(
        F.count("*").alias("holders"), F.min("part").alias("p"), F.max("part").alias("q"), F.min("class").alias("low"),
        F.max(F.struct("common", "node")).alias("c")).filter("p <> q and low = g").select("s", "g", "holders", F.col("c.node").alias("c")))
    few = prefix.join(meets.filter(F.col("holders") <= DIRECT).select("s", "g"), ["s", "g"])
    a, b = (few.select("s", "g", F.col("node").alias(t), F.col("part").alias(f"p{t}"), F.col("n").alias(f"n{t}"),
                       F.col("class").alias(f"c{t}"), F.col("x").alias(f"x{t}")) for t in "ab")
    direct = a.join(b, ["s", "g"]).filter("a < b and pa <> pb and least(ca, cb) = g").filter(possible).select("a", "b")
    stars = prefix.select("s", "g", "node").join(
        meets.filter(F.col("holders") > DIRECT).select("s", "g", "c"), ["s", "g"])
    links, indirect = _by_centre(scratch, stars.filter("node <> c").select("node", "c").distinct(),
                                 nodes, sets, percent, possible)
    coarse = direct.unionByName(indirect).distinct()
    fine = nodes.select("node", "n").join(sets.select(F.col("doc_id").alias("node"), F.col("fine").alias("x")), "node")
    return links.unionByName(_confirmed(_agreeing(coarse, fine, _possible(percent, FINE)), sets, percent))


def _by_centre(scratch: Scratch, stars: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int,
               possible: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of nodes with their centres, and pairs (a, b) around a centre that may link.

    With t the threshold and k = (1 - t) / (1 + t), sets a and b link exactly if
    their symmetric difference has at most k (na + nb) elements. It has
    da + db - 2 o, where da and db count the differences from centre c and o the
    elements these two differences share. Two nodes that both link with c are
    connected already. If b does not, db > k (nb + nc), so a link needs
    o > (da - k na + k nc) / 2; and any b has db - k nb >= -k nc, so a link of an
    unlinked a needs o >= (da - k na - k nc) / 2, above zero. The rarest
    ``da - o + 1`` elements of either difference then share one.
    """
    left = stars.join(sets.select(F.col("doc_id").alias("node"), F.col("shingles").alias("sa")), "node")
    both = left.join(sets.select(F.col("doc_id").alias("c"), F.col("shingles").alias("sc")), "c")
    both = both.select("c", "node", F.size("sa").cast("long").alias("n"), F.size("sc").cast("long").alias("nc"),
                       F.concat(F.array_except("sa", "sc"), F.array_except("sc", "sa")).alias("apart"))
    up, down = 100 + percent, 100 - percent
    around = scratch.write(both.withColumn("d", F.size("apart").cast("long")).withColumn(
        "linked", F.expr(f"d * {up} <= (n + nc) * {down}")))
    links = around.filter("linked").select(F.col("node").alias("a"), F.col("c").alias("b"))

    elements = around.select("c", "node", F.explode("apart").alias("e"))
    rare = around.select("c", "node", "n", "nc", "d", "linked").join(
        _rarest(elements, ["c", "e"], ["c", "node"], "e"), ["c", "node"])
    rare = rare.selectExpr(
        "c", "node", "linked", "held",
        f"cast(size(held) - floor((d * {up} + (nc - n) * {down}) / {2 * up}) as int) as to_open",
        f"cast(size(held) + 1 - ceil((d * {up} - (nc + n) * {down}) / {2 * up}) as int) as to_linked")
    rare = rare.withColumn("take", F.when(F.col("linked"), F.col("to_open")).otherwise(
        F.greatest("to_open", "to_linked"))).filter("take > 0")
    rare = rare.select("c", "node", "linked", "to_open", F.posexplode(F.slice("held", F.lit(1), F.col("take"))).alias("at", "h"))
    rare = scratch.write(rare.select("c", "node", F.col("h.e").alias("e"), "linked", (F.col("at") < F.col("to_open")).alias("open"))
                         .join(nodes, "node"))
    a, b = (rare.select("c", "e", F.col("node").alias(t), F.col("linked").alias(f"l{t}"), F.col("open").alias(f"o{t}"),
                        F.col("part").alias(f"p{t}"), F.col("n").alias(f"n{t}"), F.col("x").alias(f"x{t}")) for t in "ab")
    pairs = a.filter("not la").join(b, ["c", "e"]).filter(
        "pa <> pb and (lb or (a < b and oa and ob))").filter(possible)
    return links, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets_of(scratch: Scratch, docs: DataFrame, wanted: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles, fine) of the nodes that ``wanted`` names, each node in the place of a doc_id."""
    named = wanted.join(heads.select("node", F.col("low").alias("doc_id"), "set_a", "set_b"), "node")
    texts = docs.join(named.hint("shuffle_hash"), "doc_id").select("node", "text", "set_a", "set_b")
    return scratch.write(texts.mapInArrow(partial(_sets, width=width), _SETS).dropDuplicates(["doc_id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full shingle sets are similar enough."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"))
    return both.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT,
                    collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = scratch.write(docs.mapInArrow(
        partial(_features, width=width, collections=collections, rows=rows), _FEATURES))

    # equal sets are one node; a repeated id may be the smallest of several, so nodes have names of their own
    member = feats.filter("doc_id is not null and n_shingles > 0")
    klass = ["n_shingles", "set_a", "set_b"]
    heads = scratch.write(member.groupBy(*klass).agg(F.min("doc_id").alias("low")).withColumn(
        "node", F.monotonically_increasing_id()))
    rows_of = member.select(F.col("doc_id").alias("low"), *klass, "bits", "near").dropDuplicates(["low", *klass])
    nodes = scratch.write(heads.join(rows_of, ["low", *klass]).select(
        "node", F.col("n_shingles").alias("n"), F.col("bits").alias("x"), "near"))
    sketch = nodes.select("node", "n", "x")
    possible = _possible(percent, 2 * collections * rows)

    buckets = scratch.write(_buckets(_shared_keys(nodes, collections)))
    stars = buckets.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    stars = scratch.write(_agreeing(stars, sketch, possible))
    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    links = scratch.write(_confirmed(stars, _sets_of(scratch, docs, ends, heads, width), percent))
    merged = scratch.write(connected_components(scratch, links))

    parts = merged.select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    left = scratch.write(_open_nodes(buckets, parts).join(sketch, "node"))
    sets = _sets_of(scratch, docs, left.select("node"), heads, width)
    more = scratch.write(_across(scratch, left, sets, percent, possible))

    # links across components, and the equal-set classes, complete the graph
    joined = merged.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    for end in "ab":
        low = heads.select(F.col("node").alias(end), "low")
        joined, more = (x.join(low, end).drop(end).withColumnRenamed("low", end) for x in (joined, more))
    named = member.join(heads, klass).select("doc_id", "low").distinct()
    graph = joined.unionByName(more).unionByName(
        named.select(F.col("doc_id").alias("a"), F.col("low").alias("b"))).filter("a <> b")
    label = connected_components(scratch, graph)
    out = feats.select("doc_id", "n_shingles").join(
        label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return scratch.keep(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group; all columns unchanged.

    Of rows that repeat an id every one stays or goes with the id.
    """
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
