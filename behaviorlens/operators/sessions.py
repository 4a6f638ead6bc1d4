"""Gaps, coverage, sessions of signals, order checks and first-wins deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.functions.columns import severity_name, severity_of_rank, severity_rank


def sessionise(df: DataFrame, keys: Sequence[str], gap_us: int, time: str = "epoch_us", ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """df with session, from 0 in each key: a new one begins when more than gap_us has passed."""
    order = Window.partitionBy(*keys).orderBy(time, *ties)
    starts = F.coalesce((F.col(time) - F.lag(time).over(order) > gap_us).cast("int"), F.lit(0))
    return df.withColumn("__new", starts).withColumn("session", F.sum("__new").over(order)).drop("__new")


def group_alerts(alerts: DataFrame, cooldown_us: int = 300_000_000, evidence: int = 20) -> DataFrame:
    """Alerts of one fingerprint within the cooldown: count, span, highest severity, first evidence.

    alerts has fingerprint, host, epoch_us, event_id (of any type), event_type and severity; severities that are not known are informational."""
    grouped = sessionise(alerts, ["fingerprint"], cooldown_us)
    # The first rows of a session are chosen by rank, so that no array outgrows ``evidence``.
    nth = F.row_number().over(Window.partitionBy("fingerprint", "session").orderBy("epoch_us", "event_id"))
    ranked = grouped.withColumn("__n", nth)
    items = F.array_sort(F.collect_list(F.when(F.col("__n") <= evidence, F.struct("epoch_us", "event_id"))))
    return ranked.groupBy("fingerprint", "session").agg(
        F.min("host").alias("host"), F.count("*").alias("count"), F.min("epoch_us").alias("first_us"), F.max("epoch_us").alias("last_us"),
        severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.min_by("event_type", F.struct("epoch_us", "event_id")).alias("event_type"), F.transform(items, lambda x: x["event_id"]).alias("evidence"),
    )


def correlate_incidents(signals: DataFrame, gap_us: int = 900_000_000) -> DataFrame:
    """Signals of one host within the gap: count, kinds, highest severity, and the counts by event type."""
    sessions = sessionise(signals.withColumn("severity", severity_name(F.col("severity"))), ["host"], gap_us)
    kinds = sessions.groupBy("host", "session", "event_type").agg(
        F.count("*").alias("n"), F.min("epoch_us").alias("first_us"), F.max("epoch_us").alias("last_us"),
        F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), (-F.col("epoch_us")).alias("t"), F.col("severity").alias("severity"))).alias("top"),
    )
    return kinds.groupBy("host", "session").agg(
        F.sum("n").alias("signal_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("top")["severity"].alias("severity"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("event_types"),
    )


def incident_timelines(signals: DataFrame, gap_us: int = 900_000_000, summaries: Sequence[str] = ("description", "explanation", "scenario")) -> DataFrame:
    """The signals of every incident in order, as rows: incident_id, host, place (from 1), epoch_us, timestamp, type, severity and summary.

    A row a signal is the timeline at any length: an incident of a million signals is no array in one cell.  The id has the host, the first signal's
    timestamp and the number of signals, as ``incident_records`` has it.  A signal's summary is the first of the named columns that is not empty."""
    sessions = sessionise(signals, ["host"], gap_us)
    own = Window.partitionBy("host", "session")
    order = own.orderBy("epoch_us", "event_id")
    held = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in summaries if c in signals.columns]
    placed = sessions.withColumn("place", F.row_number().over(order)).withColumn("__n", F.count("*").over(own)).withColumn("__first", F.first("timestamp").over(order))
    return placed.select(
        F.concat_ws(":", "host", "__first", F.col("__n").cast("string")).alias("incident_id"), "host", "place", "epoch_us", "timestamp",
        F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit("anomaly")).alias("type"), severity_name(F.col("severity")).alias("severity"), F.coalesce(*held, F.lit("security signal")).alias("summary"),
    )


def incident_records(signals: DataFrame, gap_us: int = 900_000_000, shown: int = 100) -> DataFrame:
    """One record an incident: incident_id, host, first_timestamp, last_timestamp, severity, signal_count, event_types and the first ``shown`` entries of its timeline,
    the rest of which stands in ``incident_timelines``.  Chosen by rank before they are gathered, so no cell outgrows the bound."""
    lines = incident_timelines(signals, gap_us)
    entry = F.struct("place", "timestamp", "type", "severity", "summary")
    kinds = lines.groupBy("incident_id", "host", "type").agg(
        F.count("*").alias("n"), F.min_by("timestamp", "place").alias("first"), F.min("place").alias("p"), F.max_by("timestamp", "place").alias("last"), F.max("place").alias("q"),
        F.max(F.struct(severity_rank(F.col("severity")).alias("r"), F.col("severity").alias("s"))).alias("top"), F.collect_list(F.when(F.col("place") <= shown, entry)).alias("some"),
    )
    return kinds.groupBy("incident_id", "host").agg(
        F.min_by("first", "p").alias("first_timestamp"), F.max_by("last", "q").alias("last_timestamp"), F.max("top")["s"].alias("severity"), F.sum("n").alias("signal_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("event_types"), F.array_sort(F.flatten(F.collect_list("some"))).alias("timeline"),
    )


def window_gaps(windows: DataFrame, seconds: int) -> DataFrame:
    """Gaps between neighbouring windows of a host: gap_start, gap_end, gap_seconds, missing_windows."""
    distinct = windows.select("host", "window_start").distinct()
    after = F.lead("window_start").over(Window.partitionBy("host").orderBy("window_start"))
    gaps = distinct.withColumn("gap_end", after).withColumn("gap_seconds", F.col("gap_end") - F.col("window_start")).where(F.col("gap_seconds") > seconds)
    return gaps.select(
        "host", F.col("window_start").alias("gap_start"), "gap_end", "gap_seconds", (F.floor(F.col("gap_seconds") / seconds) - 1).alias("missing_windows")
    )


def coverage(windows: DataFrame, seconds: int) -> DataFrame:
    """Observed and expected windows of each host and their ratio."""
    span = (F.col("last") - F.col("first")) / seconds + 1
    found = windows.groupBy("host").agg(F.count_distinct("window_start").alias("observed"), F.min("window_start").alias("first"), F.max("window_start").alias("last"))
    return found.withColumn("expected", span.cast("long")).withColumn("coverage", F.col("observed") / F.col("expected"))


def behind_running_max(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]) -> Column:
    """Whether a row's time lies before the latest one seen in its key so far."""
    seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col(time) < F.max(time).over(seen), F.lit(False))


#: Rows of the global order that a task compares with their neighbours.
PART_ROWS = 100_000


def behind_previous(df: DataFrame, time: str, pos: str = "pos") -> DataFrame:
    """df with out_of_order: the time lies before that of the row at the position before.  Positions go in parts of bounded size, each of which knows the last time before it."""
    part = F.floor(F.col(pos) / PART_ROWS)
    ends = df.groupBy((part + 1).alias("__part")).agg(F.max_by(F.struct(time), pos).alias("__end"))
    rows = df.withColumn("__part", part).join(ends, "__part", "left")
    order = Window.partitionBy("__part").orderBy(pos)
    before = F.when(F.col(pos) % PART_ROWS > 0, F.lag(time).over(order)).otherwise(F.col("__end")[time])
    return rows.withColumn("out_of_order", F.coalesce(F.col(time) < before, F.lit(False))).drop("__part", "__end")


def first_wins(df: DataFrame, identity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each identity, with the number of rows it stands for."""
    own = Window.partitionBy(*identity)
    ranked = df.withColumn("__r", F.row_number().over(own.orderBy(*order))).withColumn("copies", F.count("*").over(own))
    return ranked.where("__r = 1").drop("__r")


def counter_rate(df: DataFrame, keys: Sequence[str], counter: str, time: str = "epoch_us", ties: Sequence[str] = ("event_id",)) -> Column:
    """Increase of a counter a second since the row before; falls and first rows are 0."""
    order = Window.partitionBy(*keys).orderBy(time, *ties)
    seconds = (F.col(time) - F.lag(time).over(order)) / 1e6
    rate = (F.col(counter) - F.lag(counter).over(order)) / F.when(seconds > 0, seconds)
    return F.coalesce(F.greatest(rate, F.lit(0.0)), F.lit(0.0))
