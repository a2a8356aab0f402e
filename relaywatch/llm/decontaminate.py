"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents. Items and documents are
sets of shingles of five words (letters and digits of the lower-cased text; a
shorter text is one shingle, an empty or null one has none and is in no
result). A document is contaminated by an item when it holds at least
``percent`` per cent of the item's shingles.

A MinHash of a whole long document says nothing about a short item in it, so
signatures are taken over sliding windows, and the window follows the item's
size. Items are partitioned by their number of shingles; a partition's window is
the longest run of consecutive shingles that an item of this size must keep when
words are changed at few places or its ends are cut off, but the containment
still holds: 1 below 4 shingles, 4 below 16, 8 from there on. The signature of a
text in a partition is the set of minima of all its windows. An item and a
document that share a run as long as the window share its minimum for certain.

Candidates then are equal minima (a join on hash values). An item whose shingles
stand singly, far apart, may share no such run. So that none is lost, the windows
of one shingle are looked up for all items: an item of n shingles of which t must
be held is also a candidate wherever one of its n - t + 1 shingles stands that
the fewest documents hold, since nobody can hold t of n without one of these.
Every candidate is verified by exact containment over the full shingle sets. Only
DataFrame functions are used. The items' signatures are broadcast when their
number is below ``BROADCAST_ROWS``; larger ones are joined by shuffle.

An item of fewer than five words is one shingle and equals only a text of the
same words; inside a longer text so few words are no evidence. Repeated rows give
the same pairs once; a null doc_id is carried. Other columns of both tables are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaywatch.llm.common import Scratch

WIDTH = 5
PERCENT = 80
BROADCAST_ROWS = 50_000                   # 16 bytes each: under a megabyte
PARTITIONS = ((1, 1), (4, 4), (16, 8))    # (least shingles of an item, window)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def with_shingles(df: DataFrame) -> DataFrame:
    """``words`` replaced by ``shingles``: the hash of each run of five words, in order."""
    return df.withColumn("shingles", F.expr(
        f"case when size(words) = 0 then array() when size(words) <= {WIDTH} then array(xxhash64(words)) "
        f"else transform(sequence(1, size(words) - {WIDTH - 1}), i -> xxhash64(slice(words, i, {WIDTH}))) end")).drop("words")


def _minima(window: int) -> str:
    if window == 1:
        return "array_distinct(shingles)"
    return (f"case when size(shingles) <= {window} then array_compact(array(array_min(shingles))) else array_distinct("
            f"transform(sequence(1, size(shingles) - {window - 1}), i -> array_min(slice(shingles, i, {window})))) end")


def _signatures(df: DataFrame, keep: list[str], windows: list[int]) -> DataFrame:
    """One row per minimum: ``keep``, window, h."""
    minima = F.array(*[F.struct(F.lit(w).alias("window"), F.expr(_minima(w)).alias("hs")) for w in windows])
    rows = df.select(*keep, F.explode(minima).alias("m"))
    return rows.select(*keep, "m.window", F.explode("m.hs").alias("h"))


def _running(df: DataFrame, key: str, windows: list[int]) -> DataFrame:
    """``key``, window, h of every window of a text, minima of wider ones made from two narrower ones.

    Windows that reach over the end give the minimum of what is left: more candidates, none fewer.
    """
    df, widest = df.withColumn("m1", F.col("shingles")), 1
    while widest < max(windows):
        df = df.withColumn(f"m{2 * widest}", F.expr(
            f"zip_with(m{widest}, slice(m{widest}, {widest + 1}, size(m{widest})), (a, b) -> least(a, b))"))
        widest *= 2
    minima = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"m{w}").alias("hs")) for w in windows])
    rows = df.select(key, F.explode(minima).alias("m"))
    return rows.select(key, "m.window", F.explode("m.hs").alias("h"))


def _rarest(items: DataFrame, hits: DataFrame, percent: int) -> DataFrame:
    """(item_key, h): the n - t + 1 shingles of each item that the fewest documents hold."""
    held = hits.filter("window = 1").groupBy("h").agg(F.count("*").alias("n_docs"))
    each = items.select("item_key", F.size("shingles").alias("n"), F.explode("shingles").alias("h")).join(held, "h", "left")
    by = Window.partitionBy("item_key").orderBy(F.coalesce("n_docs", F.lit(0)), "h")
    spare = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    return each.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= spare + 1).select("item_key", "h")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text_key: bool = False) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every contaminated pair.

    ``text_key`` adds ``row_key``, a hash of id and text that finds the row again.
    """
    scratch = Scratch(docs.sparkSession)
    ordered = with_shingles(benchmark.select("item_id", words(F.col("text")).alias("words"))).filter(
        "size(shingles) > 0").withColumn("item_key", F.xxhash64("item_id", "shingles"))
    items = scratch.write(ordered.select("item_id", "item_key", F.array_distinct("shingles").alias("shingles")).dropDuplicates(["item_key"]))
    n = F.size(F.array_distinct("shingles"))
    rule = F.lit(0)
    for least, window in PARTITIONS:
        rule = F.when(n >= least, window).otherwise(rule)
    sized = ordered.withColumn("size_window", rule).filter("size_window > 0")
    index = _signatures(sized, ["item_key", "size_window"], [w for _, w in PARTITIONS]).filter(
        "window = size_window").select("item_key", "window", "h").distinct()
    index = scratch.write(index)
    singles = items.select(F.lit(1).alias("window"), F.explode("shingles").alias("h"))
    looked_up = scratch.write(index.select("window", "h").union(singles).distinct())
    held = looked_up.agg(F.count("*").alias("n"), F.collect_set("window").alias("windows")).first()
    shape = "doc_id {}, item_id {}, n_shared long, n_item long, containment double, row_key long".format(
        docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    columns = ["doc_id", "item_id", "n_shared", "n_item", "containment", *["row_key"] * text_key]
    if not held["n"]:
        return scratch.keep(docs.sparkSession.createDataFrame([], shape).select(*columns))
    if held["n"] <= BROADCAST_ROWS:
        looked_up = F.broadcast(looked_up)

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    read = with_shingles(keyed.select("row_key", words(F.col("text")).alias("words")))
    hits = scratch.write(_running(read, "row_key", sorted(held["windows"])).join(looked_up, ["window", "h"]).distinct())
    candidates = scratch.write(hits.join(index, ["window", "h"]).select("row_key", "item_key").union(
        hits.filter("window = 1").join(_rarest(items, hits, percent), "h").select("row_key", "item_key")).distinct())

    again = keyed.join(candidates.select("row_key").distinct(), "row_key")
    again = with_shingles(again.select("row_key", "doc_id", words(F.col("text")).alias("words")))
    pairs = again.withColumnRenamed("shingles", "in_doc").join(candidates, "row_key").join(
        items.withColumnRenamed("shingles", "in_item"), "item_key")
    pairs = pairs.select("doc_id", "item_id", "row_key", F.size(F.array_intersect("in_doc", "in_item")).cast("long").alias("n_shared"),
                         F.size("in_item").cast("long").alias("n_item"))
    pairs = pairs.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn(
        "containment", F.col("n_shared") / F.col("n_item"))
    return scratch.keep(pairs.select(*columns).distinct())


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    hit = contaminated(docs, benchmark, percent, text_key=True).select("row_key").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"))
    return keyed.join(hit, "row_key", "left_anti").select("doc.*")


ORACLE_SQL = """
WITH d0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
d1 AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM d0),
b0 AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
b1 AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM b0),
n AS (SELECT item_id, count(*) AS n_item FROM b1 GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d1 JOIN b1 USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM j JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""
