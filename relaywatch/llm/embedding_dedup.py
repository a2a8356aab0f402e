"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Vectors link when their cosine (double precision) is at least ``cosine``.
Vectors that are null, empty, zero, or that hold a null or non-finite component
link with nothing; so do vectors of different lengths among themselves. Vectors
of every length are compared.

Cells: spherical k-means centres are fitted on a bounded sample (``SAMPLE``
vectors, the ones with the smallest hashes), for each length by itself; every
vector is then assigned to the centre of largest cosine. Two vectors of
different cells lie on different sides of the plane halfway between the two
centres, so if their angle is at most A, one of them is within A/2 of that
plane. Each vector is therefore also sent, as a guest, to every cell whose
halfway plane it is that close to; all linked pairs then meet in a cell, none is
lost. Vectors without structure in many dimensions are close to about half of
the planes, so cells are as large as a tile allows (``PER_CELL``): a vector is
then sent few times, and the work is the tiles' products.

Blocks: a cell's vectors are dealt over blocks of at most ``BLOCK`` rows, and
each pair of blocks is a tile, a task group of its own, so a cell that holds a
third of all vectors becomes many bounded tiles. A tile multiplies in single
precision and decides what lies within the rounding error of the threshold in
double precision. It returns one row per vector with links: how many, and the
smallest member of its connected part of the tile. Pairs are never sent out.
Equal vectors are one node with a weight from the start; vectors travel as their
own bytes, in the precision the table has.

Rows with a null id come back unlinked. Nodes have numbers of their own, so rows
that repeat an id with other vectors stay vectors of their own, each with its
own links; in a component they count with their id.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm.common import Scratch
from relaywatch.llm.components import connected_components

SAMPLE = 8192            # vectors the centres are fitted on, at least eight a cell
PER_CELL = 8192          # vectors wanted in a cell
BLOCK = 16384            # rows of a tile's side
BLOCK_BYTES = 64 << 20   # and bytes of it in double precision
SLICE = 256              # visitors multiplied at once

_HOMES = "node long, weight long, raw binary, width int, cell int, guest_of array<int>"
_TILE = "node long, links long, root long"


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit vectors: centres of unit length."""
    rng = np.random.default_rng(5)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        held = size > 1e-12
        centres[held] = total[held] / size[held, None]
    return centres


def _units(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(frames, centres: dict[int, np.ndarray], cosine: float):
    """Home cell and guest cells of every vector; a length without centres is one cell."""
    half = math.sin(math.acos(min(1.0, cosine)) / 2) + 1e-9
    gaps = {w: np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) for w, c in centres.items()}
    for pdf in frames:
        widths = pdf["embedding"].map(len).to_numpy()
        for w in np.unique(widths):
            part = pdf[widths == w]
            x = np.stack(part["embedding"].to_numpy())
            home, guests = np.zeros(len(x), "int32"), [np.zeros(0, "int32")] * len(x)
            if w in centres:
                dots = _units(x) @ centres[w].T
                home = dots.argmax(axis=1).astype("int32")
                near = dots[np.arange(len(x)), home][:, None] - dots <= half * gaps[w][home]
                near[np.arange(len(x)), home] = False
                guests = [np.flatnonzero(r).astype("int32") for r in near]
            yield pd.DataFrame({"node": part["node"].to_numpy(), "weight": part["weight"].to_numpy(),
                                "raw": [v.tobytes() for v in x], "width": np.full(len(x), w, "int32"),
                                "cell": home, "guest_of": guests})


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's connected part, for links a-b among n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _tile(pdf: pd.DataFrame, cosine: float, kind: str, cells: dict[int, int]) -> pd.DataFrame:
    """Links of one tile: of its home side with its visitors and, where it says ``inner``, within its home side.

    A guest's link is counted for both ends, in the smaller of the two cells if
    both vectors are guests of each other's cell.
    """
    empty = pd.DataFrame({"node": [], "links": [], "root": []})
    pdf = pd.concat([pdf[pdf["home_side"]], pdf[~pdf["home_side"]]])
    n_home = int(pdf["home_side"].sum())
    if not n_home or len(pdf) == n_home and not pdf["inner"].iloc[0]:
        return empty
    width, cell = int(pdf["width"].iloc[0]), int(pdf["to"].iloc[0])
    exact = _units(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(pdf), width))
    rough = exact.astype(np.float32)
    slack = 1.2e-7 * (width + 8)
    node, weight, came = pdf["node"].to_numpy(), pdf["weight"].to_numpy(), pdf["cell"].to_numpy()
    there = np.zeros((n_home, cells.get(width, 1)), bool)
    for k, of in enumerate(pdf["guest_of"].iloc[:n_home]):
        there[k, of] = True
    links, label = np.zeros(len(pdf)), np.arange(len(pdf))
    first = 0 if pdf["inner"].iloc[0] else n_home
    for at in range(first, len(pdf), SLICE):
        to = min(at + SLICE, len(pdf))
        dots = rough[at:to] @ rough[:n_home].T
        i, j = np.nonzero(dots >= cosine - slack)
        near = dots[i, j] < cosine + slack
        i += at
        keep = ~near
        doubt = np.flatnonzero(near)
        for d in range(0, len(doubt), 1 << 16):
            some = doubt[d:d + (1 << 16)]
            keep[some] = np.einsum("ij,ij->i", exact[i[some]], exact[j[some]]) >= cosine
        keep &= np.where(i < n_home, j < i, (came[i] >= cell) | ~there[j, np.where(came[i] < cell, came[i], 0)])
        i, j = i[keep], j[keep]
        links += np.bincount(i, weights=weight[j], minlength=len(pdf)) + np.bincount(j, weights=weight[i], minlength=len(pdf))
        a, b = label[i], label[j]
        new = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
        if new.size:
            label = _parts(len(pdf), *new)[label]
    some = np.flatnonzero(links)
    if not len(some):
        return empty
    low = np.full(len(pdf), np.iinfo(np.int64).max)
    np.minimum.at(low, label, node)
    return pd.DataFrame({"node": node[some], "links": links[some].astype("int64"), "root": low[label[some]]})


def _tiles(homes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every tile's rows: home block h of a cell against a later home block or a block of guests.

    The tiles of the first block of guests also compare the home block within itself.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = homes.withColumn("to", F.col("cell")).join(sizes, ["width", "to"]).withColumn("b", mine)
    hosts = own.withColumn("v", F.explode(F.expr("sequence(b + 1, blocks + guest_blocks - 1)"))).select(
        "*", F.col("b").alias("h"), F.lit(True).alias("home_side"))
    later = own.filter("b > 0").withColumn("h", F.explode(F.expr("sequence(0, b - 1)"))).select(
        "*", F.col("b").alias("v"), F.lit(False).alias("home_side"))
    guests = homes.withColumn("to", F.explode("guest_of")).join(sizes, ["width", "to"]).withColumn(
        "b", F.expr("cast(blocks + pmod(xxhash64(node), guest_blocks) as int)")).withColumn(
            "h", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
                "*", F.col("b").alias("v"), F.lit(False).alias("home_side"))
    empty = F.array().cast("array<int>")
    every = None
    for side, guest_of in ((hosts, F.col("guest_of")), (later, empty), (guests, empty)):
        side = side.select("width", "to", "h", "v", "home_side", (F.col("v") == F.col("blocks")).alias("inner"),
                           "node", "weight", "raw", "cell", guest_of.alias("guest_of"))
        every = side if every is None else every.unionByName(side)
    return every


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    sound = ("vec_id is not null and size(embedding) > 0 and not exists(embedding, v -> v is null or isnan(v) "
             "or abs(v) = double('infinity')) and exists(embedding, v -> v <> 0)")
    # 128 bits of hash stand for a vector; rows without a usable one get keys that meet nothing
    keyed = rows.select("*", F.expr(f"case when {sound} then xxhash64(embedding) end").alias("k1"),
                        F.expr(f"case when {sound} then xxhash64(1, embedding) else xxhash64(vec_id) end").alias("k2"))
    classes = scratch.write(keyed.filter("k1 is not null").groupBy("k1", "k2").agg(
        F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("weight")).withColumn(
            "node", F.monotonically_increasing_id()))
    widths = classes.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "w").limit(SAMPLE).collect()
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    centres = {}
    for w, n in widths:
        unit = [v for v in sample if len(v) == w]
        cells = min(-(-n // PER_CELL), len(unit) // 8)
        if cells > 1:
            centres[w] = fit_centres(_units(np.stack(unit)), cells)

    homes = scratch.write(classes.select("node", "weight", "embedding").mapInPandas(
        partial(_assign, centres=centres, cosine=cosine), _HOMES))
    held = homes.groupBy("width", F.col("cell").alias("to")).agg(F.count("*").alias("n"))
    guests = homes.select("width", F.explode("guest_of").alias("to")).groupBy("width", "to").agg(F.count("*").alias("g"))
    side = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("width"))))).cast("int")
    # one row a cell, written so that its size is known to the planner
    sizes = scratch.write(held.join(guests, ["width", "to"], "left").select(
        "width", "to", F.ceil(F.col("n") / side).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("g", F.lit(0)) / side)).cast("int").alias("guest_blocks")))
    counted = partial(_tile, cosine=cosine, kind="<f4" if single else "<f8", cells={w: len(c) for w, c in centres.items()})
    found = scratch.write(_tiles(homes, sizes).groupBy("width", "to", "h", "v").applyInPandas(counted, _TILE))

    label = connected_components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = classes.select("node", "k1", "k2", "weight", "low").join(
        found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(
            label.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component_id", "node"))
    lows = per_node.groupBy("part").agg(F.min("low").alias("least"))
    per_node = scratch.write(per_node.join(lows, "part").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least"))
    out = keyed.select("vec_id", "k1", "k2").join(per_node, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"))
    return scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def one_per_group(vectors: DataFrame, **options) -> DataFrame:
    """The vectors that represent their group, all columns unchanged."""
    gone = near_duplicate_vectors(vectors, **options).filter("not kept").select("vec_id").distinct()
    return vectors.join(gone, "vec_id", "left_anti").select(*vectors.columns)
