"""Time windows, bucket floors and the bucket axis.

Every query is anchored at an explicit instant ``as_of`` instead of the
wall clock (decision D1), so a result can be replayed. A window ``W`` covers
``(as_of - W, as_of]``; the previous window covers ``(as_of - 2W, as_of - W]``.

Buckets are epoch-aligned floors ``t - t mod s`` in UTC; the axis runs from
the floor of the window start up to ``as_of`` inclusive, i.e. ``W/s + 1``
buckets, the first one partial.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Window keys, their lengths and bucket widths in seconds.
WINDOW_SECONDS = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}
BUCKET_SECONDS = {"1h": 300, "24h": 3600, "7d": 21600, "30d": 86400}
DEFAULT_WINDOW = "24h"

UTC = dt.timezone.utc


def as_window(value: str | None) -> str:
    """A known window key, anything else is the default ``24h``."""
    return value if isinstance(value, str) and value in WINDOW_SECONDS else DEFAULT_WINDOW


def to_utc(ts: dt.datetime | str) -> dt.datetime:
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    return ts.replace(tzinfo=UTC) if ts.tzinfo is None else ts.astimezone(UTC)


@dataclass(frozen=True)
class TimeRange:
    """Half-open instant range ``(start, end]`` plus the bucket width."""

    start: dt.datetime
    end: dt.datetime
    bucket_seconds: int

    @property
    def start_epoch(self) -> int:
        return int(self.start.timestamp())

    @property
    def end_epoch(self) -> int:
        return int(self.end.timestamp() // 1)

    def axis_values(self) -> list[int]:
        s = self.bucket_seconds
        first = (self.start_epoch // s) * s
        return list(range(first, self.end_epoch + 1, s))

    def predicate(self, ts: str = "ts", date_col: str | None = "ts_date") -> Column:
        """P2/P3 as a Column, with the date bounds that prune partitions.

        Spark does not derive a ``ts_date`` partition filter from a ``ts``
        filter, so the date bounds are added explicitly; on a table without
        the column pass ``date_col=None``.
        """
        cond = (F.col(ts) > F.lit(self.start)) & (F.col(ts) <= F.lit(self.end))
        if date_col:
            cond = (F.col(date_col) >= F.lit(self.start.date())) & \
                   (F.col(date_col) <= F.lit(self.end.date())) & cond
        return cond


def current(window: str, as_of: dt.datetime | str) -> TimeRange:
    """``(as_of - W, as_of]``."""
    w = as_window(window)
    end = to_utc(as_of)
    return TimeRange(end - dt.timedelta(seconds=WINDOW_SECONDS[w]), end, BUCKET_SECONDS[w])


def previous(window: str, as_of: dt.datetime | str) -> TimeRange:
    """``(as_of - 2W, as_of - W]``, same bucket width."""
    w = as_window(window)
    end = to_utc(as_of) - dt.timedelta(seconds=WINDOW_SECONDS[w])
    return TimeRange(end - dt.timedelta(seconds=WINDOW_SECONDS[w]), end, BUCKET_SECONDS[w])


def bucket_floor(ts: Column, seconds: int) -> Column:
    """Epoch-second floor of ``ts`` to a multiple of ``seconds``.

    ``unix_seconds`` floors toward minus infinity (also before 1970), and
    ``pmod`` keeps the remainder non-negative, so this is a true floor.
    """
    e = F.unix_seconds(ts)
    return e - F.pmod(e, F.lit(seconds).cast("bigint"))


def axis(spark: SparkSession, rng: TimeRange) -> DataFrame:
    """The bucket axis as a one-column DataFrame ``t BIGINT``.

    Its size is ``W/s + 1`` (at most 31 rows for the fixed windows), bounded
    by construction, which is what makes broadcasting it safe.
    """
    s = rng.bucket_seconds
    first = (rng.start_epoch // s) * s
    n = (rng.end_epoch - first) // s + 1
    return spark.range(0, n, 1, numPartitions=1).select((F.lit(first) + F.col("id") * s).alias("t"))
