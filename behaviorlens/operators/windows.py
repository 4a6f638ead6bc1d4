"""Behaviour windows: metric means and event counts by host and tumbling window, and their join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.functions.columns import window_start

# The event types that count, in their order.
EVENT_TYPES = (
    "process_started", "process_stopped", "authentication_success", "authentication_failure", "session_started", "session_ended",
    "privilege_elevation", "package_installed", "package_removed", "package_updated", "collector_error",
)
COUNTS = [f"event_{t}_count" for t in EVENT_TYPES]
DISTINCTS = {
    "event_unique_processes": ("process_name", ("", "unknown")), "event_unique_users": ("user_name", ("", "unknown")),
    "event_unique_remote_sources": ("remote", ("", "unknown", "local")),
}
KEYS = ["host", "window_start"]


def with_window(df: DataFrame, seconds: int) -> DataFrame:
    """Rows with a usable epoch_us, with their host ('unknown' where it is missing) and window_start."""
    host = F.coalesce(F.nullif(F.col("host"), F.lit("")), F.lit("unknown"))
    return df.where("epoch_us is not null").withColumn("host", host).withColumn("window_start", window_start(F.col("epoch_us"), seconds))


def metric_windows(metrics: DataFrame, features: Sequence[str], seconds: int = 60, order: str | None = None) -> DataFrame:
    """Count and means by window; a missing or bad value counts as 0 in the mean.

    The last bits of a sum of doubles depend on the order of its terms.  With the name of a column as order they are added in its order,
    one after the other, so that a mean is the same in any run; a window's rows then pass one task as a sorted stream.  Without, they are added as they come."""
    rows = with_window(metrics, seconds)
    numbers = {f: F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) for f in features}
    if order is None:
        return rows.groupBy(*KEYS).agg(F.count("*").alias("metric_sample_count"), *[(F.sum(x) / F.count("*")).alias(f) for f, x in numbers.items()])
    upto = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*KEYS, F.count("*").over(upto).alias("n"), F.struct(*[F.sum(x).over(upto).alias(f) for f, x in numbers.items()]).alias("sums"))
    whole = sums.groupBy(*KEYS).agg(F.max("n").alias("metric_sample_count"), F.max_by("sums", "n").alias("sums"))
    return whole.select(*KEYS, "metric_sample_count", *[(F.col("sums")[f] / F.col("metric_sample_count")).alias(f) for f in features])


def event_windows(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Counts of each counting type, exact distinct names and totals by window."""
    counted = with_window(events, seconds).where(F.col("event_type").isin(*EVENT_TYPES))
    counts = [F.count_if(F.col("event_type") == t).alias(c) for t, c in zip(EVENT_TYPES, COUNTS, strict=True)]
    names = [
        F.count_distinct(F.when(~F.col(c).isin(*out), F.col(c))).alias(k) for k, (c, out) in DISTINCTS.items()
    ]
    return counted.groupBy(*KEYS).agg(*counts, *names, F.count("*").alias("event_total_count"))


def combined_windows(metrics: DataFrame, events: DataFrame, features: Sequence[str], seconds: int = 60, order: str | None = None) -> DataFrame:
    """Metric windows with the events of the same host and window; windows without events have zeros.  order is that of metric_windows."""
    joined = metric_windows(metrics, features, seconds, order).join(event_windows(events, seconds), KEYS, "left")
    return joined.fillna(0, [*COUNTS, *DISTINCTS, "event_total_count"])


def window_labels(metrics: DataFrame, label: str, seconds: int = 60, order: str = "epoch_us") -> DataFrame:
    """The most common label of each window, the first seen of equals."""
    counted = with_window(metrics, seconds).where(F.col(label).isNotNull()).groupBy(*KEYS, label).agg(
        F.count("*").alias("n"), F.min(order).alias("first")
    )
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("n"), "first"))
    return counted.withColumn("r", best).where("r = 1").select(*KEYS, label)
