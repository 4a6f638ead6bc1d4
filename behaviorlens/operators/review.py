"""Alert identities, review rows and their checks, and summaries of what detectors found."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of a review, and the columns of its rows.
LABELS = ("unreviewed", "benign", "suspicious", "confirmed_attack")
ROWS = ("alert_id", "event_timestamp", "severity", "category", "ratio", "model_ratio", "rules", "top_features", "label", "analyst_note")


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as \\uXXXX."""
    escaped = F.transform(
        F.regexp_extract_all(text, F.lit("(?s)(.)"), 1),
        lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(....)", r"\\u$1"))).otherwise(c),
    )
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(escaped, "")).otherwise(text)


def alert_id(timestamp: Column, host: Column, category: Column, rules: Column, features: Column) -> Column:
    """hwa- and 16 hex digits of the SHA-256 of the alert's identity as canonical JSON: keys in order, no spaces, nulls kept, ASCII.
    rules and features are arrays of names; rules are put in order, features are taken as they stand."""
    identity = F.struct(
        category.alias("category"), features.alias("features"), host.alias("host"), F.array_sort(rules).alias("rules"), timestamp.alias("timestamp")
    )
    return F.concat(F.lit("hwa-"), F.substring(F.sha2(ascii_json(F.to_json(identity, {"ignoreNullFields": "false"})), 256), 1, 16))


def six_digits(value: Column) -> Column:
    """A double with six digits behind the point, rounded by its exact binary value as C and Python do; format_string rounds its shortest decimal form, and halves up."""
    @F.arrow_udf("string")
    def printed(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "%.6f" % v for v in x.to_pylist()], pa.string())

    return printed(value)


def review_rows(alerts: DataFrame) -> DataFrame:
    """Rows for analysts, all strings; alerts has event_timestamp, host, category, severity, ratio, model_ratio, rules and features (arrays of names)."""
    plain = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    names = lambda c: F.array_join(F.filter(c, lambda x: x != ""), ";")
    number = lambda *c: six_digits(F.coalesce(*[F.col(x).cast("double") for x in c], F.lit(0.0)))
    return alerts.select(
        alert_id(F.col("event_timestamp"), F.col("host"), F.col("category"), F.col("rules"), F.col("features")).alias("alert_id"), plain("event_timestamp", "").alias("event_timestamp"),
        plain("severity", "unknown").alias("severity"), plain("category", "unknown").alias("category"), number("ratio").alias("ratio"), number("model_ratio", "ratio").alias("model_ratio"),
        names("rules").alias("rules"), names("features").alias("top_features"), F.lit("unreviewed").alias("label"), F.lit("").alias("analyst_note"),
    )


def review_faults(rows: DataFrame) -> DataFrame:
    """(alert_id, fault) of review rows that must not be used: without an id, with an id that stands twice, or with another label."""
    own = F.trim(F.coalesce("alert_id", F.lit("")))
    named = rows.select(own.alias("alert_id"), "label")
    missing = named.where("alert_id = ''").select("alert_id", F.lit("missing alert_id").alias("fault"))
    twice = named.where("alert_id != ''").groupBy("alert_id").agg(F.count("*").alias("n")).where("n > 1").select("alert_id", F.lit("duplicate alert_id").alias("fault"))
    label = named.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).select("alert_id", F.lit("unsupported label").alias("fault"))
    return missing.unionByName(twice).unionByName(label)


def checked_reviews(rows: DataFrame) -> DataFrame:
    """rows, or a ValueError that names a fault of them."""
    fault = review_faults(rows).first()
    if fault:
        raise ValueError(f"{fault['fault']}: {fault['alert_id']!r}")
    return rows


def signal_timestamp(df: DataFrame, names: Sequence[str] = ("timestamp", "event_timestamp", "sample.timestamp", "detected_at")) -> Column:
    """The first of the named times that is not empty; names that df lacks are skipped."""
    held = [n for n in names if n.split(".")[0] in df.columns]
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in held], F.lit(None).cast("string"))


def category_summary(alerts: DataFrame, order: str) -> DataFrame:
    """(category, alerts) by falling count, of equal counts the first seen first; the column order tells what was seen first."""
    counted = alerts.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("alerts"), F.min(order).alias("__first"))
    return counted.orderBy(F.desc("alerts"), "__first").select("category", "alerts")


def demo_metrics(scores: DataFrame) -> DataFrame:
    """One row of figures of scored rows with scenario and is_anomaly: counts, recall, false positive rate, and detections by scenario."""
    normal, hit = F.col("scenario").eqNullSafe(F.lit("normal")), F.coalesce("is_anomaly", F.lit(False))
    by = scores.where(hit).groupBy(F.coalesce("scenario", F.lit("None")).alias("s")).agg(F.count("*").alias("n"))
    named = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"].cast("string"))), ",").alias("detected_by_scenario"))
    row = scores.agg(
        F.count("*").alias("samples"), F.count_if(normal).alias("normal_samples"), F.count_if(~normal).alias("injected_anomalies"), F.count_if(~normal & hit).alias("true_positives"),
        F.count_if(normal & hit).alias("false_positives"), F.count_if(~normal & ~hit).alias("false_negatives"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    row = row.withColumn("recall", share("true_positives", "injected_anomalies")).withColumn("false_positive_rate", share("false_positives", "normal_samples"))
    return row.crossJoin(F.broadcast(named))  # one row each


def metric_trends(metrics: DataFrame) -> DataFrame:
    """Rows for a chart of metrics: percentages, processes, kB/s of the network and MB/s of the disks; what is missing or no finite number is 0."""
    def number(name: str) -> Column:
        x = F.col(name).try_cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))

    return metrics.select(
        "timestamp", number("cpu_percent").alias("cpu"), number("memory_percent").alias("memory"), number("process_count").alias("processes"),
        ((number("net_bytes_sent_per_sec") + number("net_bytes_recv_per_sec")) / 1024).alias("network_kbps"),
        ((number("disk_read_bytes_per_sec") + number("disk_write_bytes_per_sec")) / (1024 * 1024)).alias("disk_mbps"),
    )
