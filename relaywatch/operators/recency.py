"""O5, O6 guided by counts: the newest rows of a window from the few dates that hold them.

A top-k over a long window has every scan task hand its k newest rows on, and
reads every date for it. The measures of the window (mostly rollup rows) already
say how many calls, or failed-over calls, each 300 s bucket holds. Counting down
from the newest bucket gives the bucket in which the k-th newest row lies; only
rows from its start on are scanned.

The bucket's start is a scalar subquery of the scan: nothing runs when the plan
is built, and the subquery's value prunes the dates and row groups when it does.
The counts of a window are one row a bucket (8,640 for 30 days), however many
calls there are. The rows in the span are at least the k newest, ties included,
so the ordinary top-k over them is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaywatch.operators import partials as P

GRAIN = 300


def newest(scoped_calls: DataFrame, measures: DataFrame, counted: str, k: int) -> DataFrame:
    """Calls from the start of the bucket that holds the ``k``-th newest on.

    ``measures`` covers the same window and scope; ``counted`` names the measure
    that counts the wanted rows (``calls``, ``failovers``). With fewer than ``k``
    of them, the span begins at the oldest one; with none, no row comes back.
    """
    buckets = measures.groupBy(P.bucket(GRAIN)).agg(F.sum(counted).alias("n")).where("n > 0")
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.timestamp_seconds(
        buckets.select("t", F.sum("n").over(down).alias("held"))
        .agg(F.coalesce(F.max(F.when(F.col("held") >= k, F.col("t"))), F.min("t")).alias("since")).scalar())
    recent = scoped_calls.where(F.col("ts") >= since)
    if "ts_date" in scoped_calls.columns:
        recent = recent.where(F.col("ts_date") >= F.to_date(since))
    return recent
