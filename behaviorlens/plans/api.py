"""Whole flows over JSON-lines data: what a user calls in place of single operators.

Paths go to Spark's readers only, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.functions.columns import iso_z, parse_timestamp
from behaviorlens.operators import detectors, evaluation, ordering, quality, rules, sessions, windows
from behaviorlens.sources import files
from behaviorlens.sources.store import stored

# The metric features in their order, and those that are percentages.
FEATURES = [
    "cpu_percent", "memory_percent", "swap_percent", "loadavg_1m", "process_count", "user_process_count", "thread_count", "net_bytes_sent_per_sec",
    "net_bytes_recv_per_sec", "net_packets_sent_per_sec", "net_packets_recv_per_sec", "net_errin_per_sec", "net_errout_per_sec", "net_dropin_per_sec",
    "net_dropout_per_sec", "disk_read_bytes_per_sec", "disk_write_bytes_per_sec", "tcp_established", "tcp_listen", "tcp_syn_sent", "tcp_close_wait",
    "unique_remote_ports",
]
PERCENTS = FEATURES[:3]
MODEL_FEATURES = [*FEATURES, *windows.COUNTS, *windows.DISTINCTS, "event_total_count"]
METRIC_SCHEMA = "timestamp string, host string, scenario string, " + ", ".join(f"{f} string" for f in FEATURES)
EVENT_SCHEMA = (
    "event_id string, timestamp string, host string, category_name string, class_name string, activity_name string, event_type string, source string, status string, "
    "severity string, schema_version string, data struct<process: struct<name: string>, actor: struct<user: struct<name: string>>, source_endpoint: struct<ip: string, hostname: string>>"
)


def load_metrics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    rows = files.read_jsonl(spark, paths, METRIC_SCHEMA, strict=False)
    return rows.withColumn("epoch_us", F.round(parse_timestamp(F.col("timestamp")) * 1e6).cast("long"))


def load_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Events with the names that windows count: an endpoint's address, where it is not empty, before its host name."""
    rows = files.read_jsonl(spark, paths, EVENT_SCHEMA, strict=False)
    return rows.select(
        "event_id", "host", "event_type", "severity", "status", "timestamp", F.round(parse_timestamp(F.col("timestamp")) * 1e6).cast("long").alias("epoch_us"),
        F.coalesce("data.process.name", F.lit("")).alias("process_name"), F.coalesce("data.actor.user.name", F.lit("")).alias("user_name"),
        F.coalesce(F.nullif(F.col("data.source_endpoint.ip"), F.lit("")), "data.source_endpoint.hostname", F.lit("")).alias("remote"),
    )


def build_combined(metrics: DataFrame, events: DataFrame, seconds: int = 60) -> DataFrame:
    """Combined windows with the majority label of their metric rows."""
    combined = windows.combined_windows(metrics, events, FEATURES, seconds)
    labels = windows.window_labels(metrics, "scenario", seconds)
    return combined.join(labels, windows.KEYS, "left").withColumn("window_seconds", F.lit(seconds)).withColumn("timestamp", iso_z(F.col("window_start") * 1_000_000))


def train(combined: DataFrame, features: Sequence[str] = MODEL_FEATURES, epochs: int = 220, seed: int = 42) -> detectors.Autoencoder:
    """An autoencoder of all normal windows (labelled ones are left out as the guard says)."""
    return train_on(evaluation.poisoning_guard(combined, "scenario"), features, epochs, seed)


def train_on(normal: DataFrame, features: Sequence[str] = MODEL_FEATURES, epochs: int = 220, seed: int = 42) -> detectors.Autoencoder:
    return detectors.Autoencoder.fit_windows(normal, features, epochs, seed=seed)


def score(combined: DataFrame, model: detectors.Autoencoder, thresholds: Mapping[str, int] | None = None) -> DataFrame:
    """Windows with error, top features, rules, fused ratio, severity and category."""
    out = rules.fuse(model.apply(combined), F.col("model_ratio"), thresholds)
    return out.withColumn("category", rules.category(F.col("top_features")))


def anomalies(scored: DataFrame) -> DataFrame:
    """The anomalous windows as signals for grouping."""
    ids = F.array_sort("rules.rule_id")
    return scored.where("is_anomaly").select(
        "host", (F.col("window_start") * 1_000_000).alias("epoch_us"), F.xxhash64("host", "window_start").alias("event_id"), F.col("category").alias("event_type"), "severity",
        F.concat_ws("|", "host", F.coalesce(F.nullif(F.array_join(ids, ","), F.lit("")), F.array_join(F.array_sort(F.slice("top_features.feature", 1, 3)), ","))).alias("fingerprint"),
    )


def audit(metrics: DataFrame, events: DataFrame, seconds: int = 60, least: int = 1440, full: int = 10080) -> dict[str, DataFrame]:
    """The parts of a data-quality audit; each is a small table by host, feature, rule or split."""
    combined = build_combined(metrics, events, seconds)
    scored = combined.withColumn("rules", rules.security_rules())
    windowed = windows.with_window(metrics, seconds)
    return {
        "timestamps": quality.timestamp_audit(metrics.withColumn("event_id", F.concat_ws("\x1f", "host", "timestamp"))),
        "features": quality.feature_audit(metrics, FEATURES), "coverage": sessions.coverage(windowed, seconds),
        "gaps": sessions.window_gaps(windowed, seconds).orderBy(F.desc("gap_seconds"), "host", "gap_start").limit(100),
        "event_types": events.groupBy(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("missing")).alias("event_type")).count(), "noisy_rules": quality.noisy_rules(scored),
        "splits": ordering.chronological_split(combined, "window_start", ["host"]).groupBy("split").agg(F.count("*").alias("rows"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")),
    }


def compare_detectors(combined: DataFrame, features: Sequence[str] = MODEL_FEATURES, quantile: float = 0.995, epochs: int = 80, seed: int = 42, evaluation_rows: DataFrame | None = None) -> DataFrame:
    """(method, threshold, windows, anomalies, confusion metrics) of the autoencoder, robust z-scores and EWMA.

    In time order the first 70 % fit, the next 15 % set all three thresholds, the last 15 % are judged; with rows of their own to judge, 85 % fit and the rest set the
    thresholds.  Labelled attacks neither fit nor calibrate.  Fewer than 20 rows are refused."""
    n = combined.count()
    if n < 20:
        raise ValueError("need at least 20 rows for model comparison")
    if evaluation_rows is None:
        rows = stored(ordering.chronological_split(combined, "window_start", ["host"], "cuts"), "compare-rows")
        test = rows.where("split = 'test'")
    else:
        cut = max(1, int(n * 0.85))
        placed = ordering.with_position(combined, "window_start", ["host"])
        rows = stored(placed.withColumn("split", F.when(F.col("pos") < cut, "train").otherwise("validation")), "compare-rows")
        test = evaluation_rows
    fit, calm = (evaluation.clean_rows(rows.where(F.col("split") == x), "scenario") for x in ("train", "validation"))
    order = ["window_start", "host"]
    model = train_on(fit, features, epochs, seed).calibrated(calm, quantile)
    robust = detectors.Robust.fit(fit, features).calibrated(calm, quantile)
    ewma = detectors.Ewma.fit(fit, features, order).calibrated(calm, quantile)
    attack = F.when(F.col("scenario").isNotNull(), F.col("scenario") != "normal")
    judged = {"autoencoder": (model.apply(test), F.col("model_ratio") >= 1, model), "robust_zscore": (test, robust.score() >= robust.threshold, robust), "ewma": (ewma.predict(test), F.col("ewma_score") >= ewma.threshold, ewma)}
    parts = [evaluation.method_metrics(df, attack, flag, None).select(F.lit(name).alias("method"), F.lit(float(m.threshold)).alias("threshold"), "*") for name, (df, flag, m) in judged.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def evaluate_combined(combined: DataFrame, features: Sequence[str] = MODEL_FEATURES, epochs: int = 220, quantile: float = 0.995, rule_quantile: float = 0.995, seed: int = 42, model: detectors.Autoencoder | None = None) -> dict[str, DataFrame]:
    """A whole evaluation in time order: train on 70 %, calibrate model and rules, judge the last 15 % by the model, the rules and both.

    Gives 'dataset' (rows by split and how many of them trained and calibrated), 'rules' (calibrated thresholds), 'methods' (confusion metrics), 'disagreement',
    'delays' (runs of attacks and windows until each method saw them; no rows without labels), and 'scores' (the judged windows).  A given model is only calibrated.
    Fewer than 10 windows are refused; without normal windows to calibrate on, the whole validation split calibrates."""
    rows = stored(ordering.chronological_split(combined, "window_start", ["host"]), "evaluate-rows")
    labelled = F.col("scenario").isNotNull() & (F.col("scenario") != "")
    head = rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(labelled).alias("labelled"), F.count_if(F.col("scenario") == "normal").alias("normal")).collect()
    counts = {r["split"]: r for r in head}
    if sum(r["rows"] for r in head) < 10:
        raise ValueError("need at least 10 combined windows for chronological evaluation")
    any_label = any(r["labelled"] for r in head)
    normal = lambda split: rows.where(F.col("split") == split) if not any_label else rows.where((F.col("split") == split) & (F.col("scenario") == "normal"))
    usable = lambda split: counts[split]["normal"] if any_label else counts[split]["rows"]
    if not usable("train"):
        raise ValueError("the training split contains no normal windows")
    calm = normal("validation") if usable("validation") else rows.where("split = 'validation'")
    model = (model or train_on(normal("train"), features, epochs, seed)).calibrated(calm, quantile)
    thresholds = rules.calibrate_rules(normal("train"), rule_quantile)
    limits = {r["rule_id"]: r["threshold"] for r in thresholds.select("rule_id", "threshold").collect()}
    scored = rules.fuse(model.apply(rows.where("split = 'test'")), F.col("model_ratio"), limits)
    label = F.when(labelled, F.col("scenario") != "normal")
    flags = {"ml": F.col("model_ratio") >= 1, "rules": F.size("rules") > 0, "combined": F.col("is_anomaly")}
    scored = stored(scored.withColumns({"attack": label, **{f"{k}_flag": v for k, v in flags.items()}}), "evaluate-scores")
    one = functools.reduce(DataFrame.unionByName, [evaluation.method_metrics(scored, F.col("attack"), F.col(f"{k}_flag"), 0.0).select(F.lit(k).alias("method"), "*") for k in flags])
    hits = functools.reduce(DataFrame.unionByName, [
        evaluation.detection_delay(scored, F.coalesce("attack", F.lit(False)), F.col(f"{k}_flag"), "window_start", ["host"]).agg(
            F.count("*").alias("attack_runs"), F.count("delay").alias("detected_runs"), F.count_if(F.col("delay").isNull()).alias("missed_runs"), F.avg("delay").alias("mean_delay"), F.max("delay").alias("max_delay"),
        ).select(F.lit(k).alias("method"), "*") for k in flags
    ])
    used = rows.groupBy("split").agg(F.count("*").alias("rows"), (F.count("*") if not any_label else F.count_if(F.col("scenario") == "normal")).alias("normal_rows"))
    return {"dataset": used, "rules": thresholds, "methods": one, "disagreement": evaluation.disagreement(scored, F.col("ml_flag"), F.col("rules_flag")), "delays": hits.where(F.lit(any_label)), "scores": scored}


def retrain_reviewed(
    combined: DataFrame, alerts: DataFrame, reviews: DataFrame, current: detectors.Autoencoder | None = None, maximum_unreviewed: int = 0, features: Sequence[str] = MODEL_FEATURES,
    epochs: int = 220, rule_quantile: float = 0.995, seed: int = 42,
) -> dict[str, object]:
    """A model and rule thresholds of the windows that no alert under suspicion covers: 'model', 'rules' (a table, None if blocked), 'selection' (its figures) and 'accepted'.

    alerts has alert_id, host and window_start; reviews alert_id, label and analyst_note.  Alerts of one window may be many; a missing host is 'unknown' on both sides.  The gate
    refuses reviews of unknown alerts, more alerts without a review than ``maximum_unreviewed`` and an empty baseline: then the current model stays, and without one it raises."""
    host = F.coalesce(F.nullif(F.col("host"), F.lit("")), F.lit("unknown"))
    keys = ["host", "window_start"]
    rows, merged = stored(combined.withColumn("host", host), "reviewed-windows"), stored(evaluation.merge_reviews(alerts.withColumn("host", host), reviews), "reviewed-alerts")
    selection = evaluation.review_selection(rows, merged, keys, maximum_unreviewed).head().asDict()
    selection["unknown_reviews"] = evaluation.unknown_reviews(alerts, reviews).count()
    if selection["blocked"] or selection["unknown_reviews"]:
        if current is None:
            raise ValueError(f"review gate failed: {selection}")
        return {"model": current, "rules": None, "selection": selection, "accepted": False}
    baseline = stored(evaluation.reviewed_baseline(rows, merged, keys), "reviewed-baseline")
    return {"model": train_on(baseline, features, epochs, seed), "rules": rules.calibrate_rules(baseline, rule_quantile), "selection": selection, "accepted": True}


def release_gate(evidence: Mapping[str, float | bool | None]) -> dict[str, bool]:
    """Mandatory controls from collected figures; a figure that is missing fails its control, a missing false positive rate counts as 0."""
    e = dict(evidence)
    at_least = lambda k, v: e.get(k) is not None and e[k] >= v
    return {
        "event format": bool(e.get("events_valid")), "validity": bool(e.get("records_valid")), "quality": at_least("quality", 95), "coverage": at_least("coverage", 0.95) and at_least("clean_windows", 10_080),
        "detection": at_least("recall", 0.90) and (e.get("false_positive_rate") or 0.0) <= 0.10, "throughput": at_least("windows_per_second", 1000), "memory": e.get("peak_mb") is not None and e["peak_mb"] <= 256,
    }


def save_model(model: detectors.Autoencoder) -> str:
    """The model as JSON text."""
    return json.dumps({
        "features": model.features, "scaler": {k: list(v) for k, v in model.scaler.items()}, "w1": model.w1.tolist(), "b1": list(map(float, model.b1)),
        "w2": model.w2.tolist(), "b2": list(map(float, model.b2)), "threshold": model.threshold,
    }, sort_keys=True)


def load_model(text: str) -> detectors.Autoencoder:
    import numpy as np

    m = json.loads(text)
    return detectors.Autoencoder(m["features"], {k: tuple(v) for k, v in m["scaler"].items()}, np.array(m["w1"]), np.array(m["b1"]), np.array(m["w2"]), np.array(m["b2"]), m["threshold"])
