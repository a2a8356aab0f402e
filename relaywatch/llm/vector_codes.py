"""Vector code compression: product codes found by an equal-average search.

A vector's components become the integers floor(256 * x) and are cut into
``PARTS`` equal consecutive parts (if the width is no multiple, the first parts
are one longer). Each part position has a codebook of ``ENTRIES`` integer entries,
first that part of the vectors of the smallest ids; a round assigns every part to
its nearest entry (squared distance, ties to the lower index) and replaces each
used entry by the floor of its parts' mean.

Search: a codebook is sorted by the sum of its entries' components. By Cauchy and
Schwarz an entry whose sum lies ``gap`` from the part's is at least gap^2 / length
away, so the search walks outwards from the part's own sum on both sides and
leaves a side once gap^2 / length strictly exceeds the best distance. An equal gap
may hold a tie of a lower index, so it is still read.

A round is one scan of the vectors: each task sums its own parts by entry and only
those sums, a codebook's size, are shuffled and collected. Nothing is kept on the
executors between rounds, so a lost one repeats its tasks only. The driver holds
the codebooks (``ENTRIES`` times the width), never vectors.

Defined results: vectors that are null or hold a null or non-finite component are
dropped. An empty vector has zero codes and no error. Vectors of another width
have codebooks of their own. Repeated ids and equal vectors are rows of their own;
a null id starts no codebook unless ids run out. Components beyond 2^90 are taken
as 2^90, and errors beyond a long as the largest long; the search is exact at any
size. Equal labels share ``label_error``, nulls together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SMALL = 1 << 20      # components up to here are searched as 64-bit integers, larger ones as Python's
LARGEST = 1 << 90
LONG = (1 << 63) - 1
HOT = 1000           # labels above this share of the rows are joined by broadcast: no more than HOT of them

Book = list[np.ndarray]      # one array [entries, part length] for each part


def bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and last component of each part."""
    size, more = divmod(width, parts)
    cuts = [p * size + min(p, more) for p in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def quantize(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles, as int64 where all are small, else Python integers."""
    with np.errstate(over="ignore"):
        q = np.floor(x * SCALE)
    if not q.size or np.abs(q).max() <= SMALL:
        return q.astype(np.int64)
    held = [max(-LARGEST, min(LARGEST, int(v))) if np.isfinite(v) else LARGEST * (1 if v > 0 else -1) for v in q.ravel()]
    return np.array(held, object).reshape(q.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, by equal-average search."""
    n, length = x.shape
    if x.dtype == object or book.dtype == object:
        x, book, far = x.astype(object), book.astype(object), 1 << 400
        best = np.full(n, far, object)
    else:
        best = np.full(n, (1 << 62) // max(1, length), np.int64)
    total = book.sum(axis=1) if length else np.zeros(len(book), np.int64)
    order = np.argsort(total, kind="stable")
    total, entries = total[order], book[order]
    own = x.sum(axis=1) if length else np.zeros(n, np.int64)
    which = np.full(n, len(book), np.int64)
    start = np.searchsorted(total, own)
    sides = [(start - 1, -1, start > 0), (start.copy(), 1, start < len(book))]
    while any(walking.any() for _, _, walking in sides):
        for at, step, walking in sides:
            rows = np.flatnonzero(walking)
            gap = total[at[rows]] - own[rows]
            near = (gap * gap <= length * best[rows]).astype(bool)
            walking[rows[~near]] = False
            rows = rows[near]
            away = x[rows] - entries[at[rows]]
            away = (away * away).sum(axis=1) if length else np.zeros(len(rows), np.int64)
            index = order[at[rows]]
            better = ((away < best[rows]) | ((away == best[rows]) & (index < which[rows]))).astype(bool)
            best[rows[better]], which[rows[better]] = away[better], index[better]
            at[rows] += step
            walking[rows] = (at[rows] >= 0) & (at[rows] < len(book))
    return which, best


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, [rows, width] components) of the sound vectors of a batch, a width at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(-1))
    values = column.flatten()
    real = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for width in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == width)
        x = real[start[rows][:, None] + np.arange(width)[None, :]]
        sound = np.isfinite(x).all(axis=1)
        if sound.any():
            yield rows[sound], x[sound]


def _sums(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Count and component sums of the parts that each entry gets in this task."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in _by_width(batch.column(0)):
            width, q = x.shape[1], quantize(x)
            if width not in held:
                held[width] = [(np.zeros(len(b), np.int64), np.zeros(b.shape, object)) for b in model.value[width]]
            for (a, b), book, (count, total) in zip(bounds(width), model.value[width], held[width]):
                entry, _ = nearest(q[:, a:b], book)
                count += np.bincount(entry, minlength=len(book))
                part = np.zeros(book.shape, q.dtype)
                np.add.at(part, entry, q[:, a:b])
                total += part
    for width, parts in held.items():
        at = [(p, e, i) for p, (count, total) in enumerate(parts) for e in np.flatnonzero(count) for i in range(total.shape[1])]
        yield pa.RecordBatch.from_arrays([
            pa.array([width] * len(at), pa.int32()), *(pa.array([int(r[k]) for r in at], pa.int32()) for k in range(3)),
            pa.array([int(parts[p][0][e]) for p, e, _ in at], pa.int64()),
            pa.array([Decimal(int(parts[p][1][e, i])) for p, e, i in at], pa.decimal128(38, 0))],
            names=["width", "part", "entry", "place", "n", "total"])


def _coded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Sound rows with their code and error."""
    digits = np.array([f"{k:02x}" for k in range(256)], object)
    for batch in batches:
        for rows, x in _by_width(batch.column(0)):
            width, q = x.shape[1], quantize(x)
            found = [nearest(q[:, a:b], book) for (a, b), book in zip(bounds(width), model.value[width])]
            code = digits[np.stack([entry for entry, _ in found], axis=1)]
            error = sum(away.astype(object) for _, away in found)
            yield pa.RecordBatch.from_arrays([
                *(c.take(pa.array(rows)) for c in batch.columns[1:]), pa.array(["".join(c) for c in code], pa.string()),
                pa.array([min(LONG, int(e)) for e in error], pa.int64()), pa.array([width] * len(rows), pa.int32())],
                names=[*batch.schema.names[1:], "code", "error", "width"])


def _packed(book: list[list[list[int]]]) -> Book:
    """Entries as arrays, 64-bit where they are small."""
    out = []
    for part in book:
        entries = np.array(part, object).reshape(len(part), -1)
        small = not entries.size or max(abs(v) for v in entries.ravel()) <= SMALL
        out.append(entries.astype(np.int64) if small else entries)
    return out


def codebooks_text(book: Book) -> str:
    """Components by part, entry and place, decimal, joined by commas."""
    return ",".join(str(int(v)) for part in book for v in part.ravel())


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> dict[int, Book]:
    """Codebooks by width, learned from ``vectors(vec_id, embedding)``: every row is read in every round."""
    spark = vectors.sparkSession
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = x.filter("embedding is not null and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    widths = [r["width"] for r in sound.groupBy(F.size("embedding").alias("width")).agg(F.count("*")).collect()]
    books = {}
    for width in widths:
        first = sound.filter(F.size("embedding") == width).orderBy(
            F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
        q = quantize(np.array([r["embedding"] for r in first], float).reshape(len(first), width))
        books[width] = _packed([[[int(v) for v in row[a:b]] for row in q] for a, b in bounds(width)])
    for _ in range(rounds if books else 0):
        model = spark.sparkContext.broadcast(books)
        sums = x.select("embedding").mapInArrow(
            partial(_sums, model=model), "width int, part int, entry int, place int, n long, total decimal(38,0)").groupBy(
                "width", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        lists = {w: [[[int(v) for v in entry] for entry in part] for part in book] for w, book in books.items()}
        for r in sums:
            lists[r["width"]][r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
        books = {w: _packed(book) for w, book in lists.items()}
    return books


def encode(vectors: DataFrame, books: dict[int, Book]) -> DataFrame:
    """The sound rows of ``vectors(vec_id, embedding, label)``: vec_id, label, code, error, width."""
    model = Scratch(vectors.sparkSession).spark.sparkContext.broadcast(books)
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"), "label")
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(partial(_coded, model=model), f"vec_id long, label {kind}, code string, error long, width int")


def decode(code: str, book: Book) -> list[int]:
    """The integer vector that a code stands for."""
    return [int(v) for k, part in enumerate(book) for v in part[int(code[2 * k:2 * k + 2], 16)]]


def label_errors(scratch: Scratch, coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over the rows of a label.

    A label may hold a third of the rows: labels above 1 / ``HOT`` of them, at most
    ``HOT``, are joined by broadcast, all others by their label.
    """
    sums = scratch.write(coded.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")).select(
            F.col("label").alias("of"), F.least("total", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), "n"))
    rows = sums.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > rows
    hot, rest = F.broadcast(sums.filter(is_hot).drop("n")), sums.filter(~is_hot).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    return coded.join(hot, same).drop("of").unionByName(coded.join(hot, same, "left_anti").join(rest, same).drop("of"))


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the sound rows of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    books = fit(vectors)
    digest = {w: hashlib.sha256(codebooks_text(b).encode()).hexdigest() for w, b in books.items()}
    named = F.create_map(*[F.lit(v) for pair in digest.items() for v in pair]) if digest else F.create_map().cast("map<int,string>")
    coded = scratch.write(encode(vectors, books))
    out = label_errors(scratch, coded).select(
        "vec_id", "code", "error", "label_error", named[F.col("width")].alias("codebooks_sha256"))
    return scratch.keep(out)


def _nearest_sql(book: str) -> str:
    return f"""SELECT vec_id, p, e, d FROM (SELECT vec_id, p, e, sum((v - c) * (v - c)) AS d FROM x JOIN {book} USING (p, i)
    GROUP BY vec_id, p, e) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1"""


def _round_sql(k: int) -> str:
    return f"""a{k} AS MATERIALIZED ({_nearest_sql(f"b{k}")}),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS c FROM a{k} JOIN x USING (vec_id, p) GROUP BY p, e, i) m USING (p, e, i))"""


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda t: t IS NULL OR NOT isfinite(t))) = 0),
x AS MATERIALIZED (SELECT vec_id, CAST(floor((i - 1) / (n / {PARTS})) AS INT) AS p, i, CAST(floor(v * {SCALE}) AS BIGINT) AS v
    FROM (SELECT vec_id, len(v) AS n, unnest(v) AS v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, v AS c FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id) AS r FROM x) WHERE r <= {ENTRIES}),
{_round_sql(0)},
{_round_sql(1)},
a2 AS MATERIALIZED ({_nearest_sql("b2")}),
s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b2),
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN kept USING (vec_id), s
"""
