"""Status classification and presentation-free derived columns
(X9-X20): every rule is a ``when`` chain evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed thresholds of the dashboard's health rules.
PROJECT_DOWN_FAIL_RATE = 0.005      # leaked share above this: down
PROJECT_WARN_FAILOVER_RATE = 0.03   # failover share above this: warn
ATTEMPT_OK_BELOW = 0.02             # attempt fail rate below this: ok
ATTEMPT_WARN_BELOW = 0.15           # below this: warn, else down
FLAT_CHANGE = 0.005                 # |change| below this is flat
CAUGHT_GOOD = 0.99                  # caught share above this is good
DRIFT_THRESHOLD = 0.2               # |ratio - 1| above this is drift
DRIFT_BAD = 1.0                     # |ratio - 1| above this is bad


def project_status(calls: Column, failures: Column, failovers: Column) -> Column:
    """``none`` without traffic, else down / warn / ok by strict limits."""
    c = calls.cast("double")
    return (F.when(F.coalesce(calls, F.lit(0)) == 0, F.lit("none"))
             .when(failures.cast("double") / c > PROJECT_DOWN_FAIL_RATE, F.lit("down"))
             .when(failovers.cast("double") / c > PROJECT_WARN_FAILOVER_RATE, F.lit("warn"))
             .otherwise(F.lit("ok")))


def attempt_status(attempts: Column, fails: Column) -> Column:
    """``none`` without attempts; fail rate < 2% ok, < 15% warn, else down."""
    r = fails.cast("double") / attempts.cast("double")
    return (F.when(F.coalesce(attempts, F.lit(0)) == 0, F.lit("none"))
             .when(r < ATTEMPT_OK_BELOW, F.lit("ok"))
             .when(r < ATTEMPT_WARN_BELOW, F.lit("warn"))
             .otherwise(F.lit("down")))


def change(cur: Column, prev: Column) -> Column:
    """Relative change vs the previous window, null when prev <= 0."""
    return F.when(prev > 0, (cur - prev) / prev)


def direction(cur: Column, prev: Column) -> Column:
    """``flat`` below 0.5%, else ``up`` / ``down``; null when prev <= 0."""
    d = (cur - prev) / prev
    return (F.when(~(prev > 0), F.lit(None).cast("string"))
             .when(F.abs(d) < FLAT_CHANGE, F.lit("flat"))
             .when(d > 0, F.lit("up"))
             .otherwise(F.lit("down")))


def caught_share(caught: Column, failovers: Column) -> Column:
    """Caught / failovers, null when nothing failed over."""
    return F.when(failovers > 0, caught.cast("double") / failovers.cast("double"))


def caught_good(share: Column) -> Column:
    return share > CAUGHT_GOOD


def failover_flag(rate: Column) -> Column:
    """Failover rate tone: ``warn`` at 3% and above, never ``down``."""
    return F.when(rate >= PROJECT_WARN_FAILOVER_RATE, F.lit("warn"))


def leaked_flag(failures: Column) -> Column:
    """Any leaked call is ``down``."""
    return F.when(failures > 0, F.lit("down"))


def save_flag(save_rate: Column) -> Column:
    """A positive save rate is ``ok``; never red."""
    return F.when(save_rate > 0, F.lit("ok"))


def drift_severity(r: Column) -> Column:
    """``bad`` when off by more than 100%, else ``warn``."""
    return F.when(F.abs(r - 1) > DRIFT_BAD, F.lit("bad")).otherwise(F.lit("warn"))


def strip_counts(buckets: Column) -> tuple[Column, Column]:
    """Number of ``down`` and ``warn`` entries of a status array."""
    return (F.size(F.filter(buckets, lambda b: b == "down")),
            F.size(F.filter(buckets, lambda b: b == "warn")))


def strip_summary(down: Column, warn: Column) -> Column:
    """Text by the worst status present."""
    return (F.when(down > 0, F.concat(down.cast("string"), F.lit(" interval(s) leaked")))
             .when(warn > 0, F.concat(warn.cast("string"), F.lit(" interval(s) elevated failover")))
             .otherwise(F.lit("healthy")))


def reliability(attempts: Column, fail_rate: Column) -> Column:
    """Success share ``1 - fail_rate``; null without attempts."""
    return F.when(attempts > 0, F.lit(1.0) - fail_rate)


def reliability_tone(attempts: Column, fail_rate: Column) -> Column:
    """Same limits as X10."""
    return (F.when(~(attempts > 0), F.lit(None).cast("string"))
             .when(fail_rate < ATTEMPT_OK_BELOW, F.lit("ok"))
             .when(fail_rate < ATTEMPT_WARN_BELOW, F.lit("warn"))
             .otherwise(F.lit("down")))


def ok_count(attempts: Column, fail_rate: Column) -> Column:
    """Attempts that succeeded, rounded half away from zero."""
    return F.round((F.lit(1.0) - fail_rate) * attempts.cast("double")).cast("bigint")


def unit_cost(modality: Column, spent: Column, seconds: Column, outputs: Column) -> tuple[Column, Column]:
    """X11: per-second price of video, per-output price of images, else null."""
    video = (modality == "video") & (seconds > 0)
    image = (modality == "image") & (outputs > 0)
    usd = F.when(video, spent / seconds).when(image, spent / outputs)
    label = F.when(video, F.lit("/s")).when(image, F.lit("/img"))
    return usd, label


def failure_reasons(attempts: Column) -> Column:
    """Attempts whose ``ok`` is falsy, as ``provider errorClass`` text."""
    failed = F.filter(attempts, lambda a: ~F.coalesce(a["ok"], F.lit(False)))
    return F.array_join(
        F.transform(failed, lambda a: F.concat_ws(" ", F.coalesce(a["provider"], F.lit("undefined")),
                                                  F.coalesce(a["error_class"], F.lit("error")))),
        ", ")


def event_outcome(ok: Column) -> Column:
    """``caught`` when the call still succeeded, else ``leaked``."""
    return F.when(ok, F.lit("caught")).otherwise(F.lit("leaked"))


def served_by(ok: Column, winner: Column) -> Column:
    """Who caught the call, or ``all failed``."""
    return F.when(ok, winner).otherwise(F.lit("all failed"))
