"""Continuous forms: completed-window features, stateful detectors and alert cooldown."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from behaviorlens.operators.rules import fuse
from behaviorlens.operators.windows import COUNTS, EVENT_TYPES


def stream_windows(events: DataFrame, seconds: int, delay: str = "60 seconds") -> DataFrame:
    """Completed windows by host with event counts and the mean value; rows later than the watermark are dropped.

    events has ts, host, event_type, value."""
    counts = [F.count_if(F.col("event_type") == t).alias(c) for t, c in zip(EVENT_TYPES, COUNTS, strict=True)]
    grouped = events.withWatermark("ts", delay).groupBy("host", F.window("ts", f"{seconds} seconds"))
    return grouped.agg(F.count("*").alias("metric_sample_count"), F.avg("value").alias("value"), *counts).select(
        "host", F.unix_seconds("window.start").alias("window_start"), "metric_sample_count", "value", *COUNTS
    )


def stream_scores(metrics: DataFrame, events: DataFrame, feature: str, full: float, seconds: int, thresholds: Mapping[str, int] | None = None, delay: str = "60 seconds") -> DataFrame:
    """Scored windows of metrics (ts, host, feature) and events (ts, host, event_type): both kinds are counted in one grouped stream, the model's ratio
    is the feature's mean over ``full``, rules and severity follow; windows without metrics are none.  Rows with is_anomaly are the alerts."""
    value = metrics.select("ts", "host", F.col(feature).cast("double").alias("x"), F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("metric"))
    kind = events.select("ts", "host", F.lit(None).cast("double").alias("x"), "event_type", F.lit(False).alias("metric"))
    counts = [F.count_if(F.col("event_type") == t).alias(c) for t, c in zip(EVENT_TYPES, COUNTS, strict=True)]
    grouped = value.unionByName(kind).withWatermark("ts", delay).groupBy("host", F.window("ts", f"{seconds} seconds"))
    mean = F.sum(F.when(F.col("metric"), F.coalesce("x", F.lit(0.0)))) / F.count_if("metric")
    found = grouped.agg(F.count_if("metric").alias("metric_sample_count"), mean.alias(feature), *counts).where("metric_sample_count > 0")
    found = found.select("host", F.unix_seconds("window.start").alias("window_start"), "metric_sample_count", feature, *COUNTS)
    return fuse(found, F.col(feature) / full, thresholds)


def stream_ewma(events: DataFrame, key: str, value: str, threshold: float, alpha: float = 0.05, floor: float = 1e-6) -> DataFrame:
    """Each row's z against its key's running mean and variance, which only normal rows update; order column is ts.

    A trigger's rows of a key come in several frames; they are put in order together, as many as one trigger holds for one key."""

    def run(k, frames, state: GroupState):
        mean, var = state.get if state.exists else (None, floor)
        for frame in [pd.concat(list(frames)).sort_values("ts", kind="stable")]:
            scores = []
            for x in frame[value].astype(float):
                mean = x if mean is None else mean
                z = abs(x - mean) / max(var**0.5, 0.01 * abs(mean), floor)
                scores.append(z)
                if z < threshold:
                    diff = x - mean
                    mean += alpha * diff
                    var = max((1 - alpha) * (var + alpha * diff * diff), floor)
            yield pd.DataFrame({key: frame[key], "ts": frame["ts"], "score": scores, "is_anomaly": [z >= threshold for z in scores]})
        if mean is not None:
            state.update((mean, var))

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, ts timestamp, score double, is_anomaly boolean", "mean double, var double", "append", GroupStateTimeout.NoTimeout
    )


def stream_cooldown(alerts: DataFrame, key: str, seconds: float) -> DataFrame:
    """Alerts of a key at least ``seconds`` after its last emitted one; alerts has ts."""

    def run(k, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for frame in [pd.concat(list(frames)).sort_values("ts", kind="stable")]:
            keep = []
            for t in frame["ts"].astype("int64") / 1e9 if str(frame["ts"].dtype).startswith("datetime64[ns") else frame["ts"].map(lambda x: x.timestamp()):
                emit = last is None or t - last >= seconds
                last = t if emit else last
                keep.append(emit)
            yield frame.loc[keep, [key, "ts"]]
        if last is not None:
            state.update((float(last),))

    kind = dict(alerts.dtypes)[key]
    return alerts.select(key, "ts").groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout
    )
