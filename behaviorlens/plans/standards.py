"""Envelopes of whole records, their audit, and windows scored on a replayed stream; each with its DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.operators import detectors, envelopes, evaluation, review
from behaviorlens.plans.behaviour import DAY, EV, LIMITS, REVIEWS, combined, ev_norm, reviews
from behaviorlens.plans.records import pick
from behaviorlens.sources.store import shared_dir
from behaviorlens.streaming import replay

CLASSES = ("Process Activity", "File System Activity", "Logon Session", "Network Activity", "Software Inventory Info", "Device Config State", "Security Finding", "Odd")
ACTIVITIES = ("launch", "Open", "logon", "", "Collect")
STATUSES = ("success", "FAILURE", "odd")
#: Tasks that work on lines, for each core.
TASKS_A_CORE = 4


def records(spark, sf_dir) -> DataFrame:
    """Events as lines of JSON: most are records without an envelope, every fifth has one of its own, and some are blank, broken or no objects."""
    i, k = F.col("event_id"), F.col("k")
    host = F.when(i % 6 > 0, F.col("host"))
    data = F.struct(
        F.struct(F.nullif("process_name", F.lit("p3")).alias("name"), k.alias("pid"), F.array(F.lit("run"), F.concat(F.lit("-"), k)).alias("command_line")).alias("process"),
        F.when(i % 3 == 0, F.struct(F.concat(F.lit("/f/"), k).alias("path"))).alias("file"), F.when(i % 4 == 0, F.struct(F.col("remote").alias("ip_hash"), F.when(i % 8 == 0, "x").otherwise(k.cast("string")).alias("port"))).alias("dst_endpoint"),
        F.struct(F.when(i % 3 == 1, F.struct(F.col("remote").alias("id"))).alias("user"), F.lit("a1").alias("id")).alias("actor"), F.struct(F.lit("o1").alias("id")).alias("object"), F.col("remote").alias("name"),
    )
    plain = F.to_json(F.struct(
        i.cast("string").alias("event_id"), fn.iso_z(F.col("epoch_us")).alias("timestamp"), host.alias("host"), F.when(i % 7 == 0, "dataset.optc").otherwise("agent").alias("source"), F.col("event_type"),
        pick(CLASSES, k).alias("class_name"), pick(ACTIVITIES, i).alias("activity_name"), pick(STATUSES, k).alias("status"), data.alias("data"),
    ))
    ms = F.floor(F.col("epoch_us") / 1000)
    uid = F.when(k % 2 == 0, 4001).otherwise(1007)
    meta = F.struct(F.lit("1.8.0").alias("version"), F.when(k % 3 > 0, i.cast("string")).alias("uid"), (ms + (k % 5 == 0).cast("int")).alias("logged_time"), F.struct(F.lit("p").alias("name")).alias("product"))
    own = F.struct(
        F.lit(1).alias("activity_id"), F.lit("Open").alias("activity_name"), F.lit(4).alias("category_uid"), F.lit("Network Activity").alias("category_name"), uid.alias("class_uid"), F.lit("Network Activity").alias("class_name"),
        F.lit(1).alias("severity_id"), F.lit(1).alias("status_id"), ms.alias("time"), (uid * 100 + 1).alias("type_uid"), meta.alias("metadata"), F.when(k % 4 == 0, F.struct(F.lit("h").alias("hostname"))).alias("src_endpoint"),
    )
    native = F.to_json(F.struct(i.cast("string").alias("event_id"), own.alias("ocsf")))
    line = F.when(i % 29 == 0, '{"event_id": ').when(i % 31 == 0, "[1]").when(i % 37 == 0, " \t").when(i % 5 == 0, native).otherwise(plain)
    # The narrow events are dealt out first, since a compact file is few tasks; filters on the lines do not pass the explode, so none is built before that.
    dealt = ev_norm(spark, sf_dir).repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "event_id")
    return dealt.select(i, F.explode(F.array(line)).alias("value"))


def q_envelope_upgrade(spark, sf_dir):
    rows = records(spark, sf_dir).select("event_id", F.try_parse_json("value").alias("record")).where(F.schema_of_variant("record").startswith("OBJECT"))
    found = envelopes.upgrade(rows, "record", "behaviorlens", F.lit(0))
    at = lambda path, kind: F.try_variant_get("envelope", f"$.{path}", kind).alias(path.replace(".", "_"))
    whole = [at(n, "long") for n in ("class_uid", "type_uid", "time", "severity_id", "status_id", "process.pid", "dst_endpoint.port", "device.type_id", "file.type_id", "finding_info.created_time")]
    text = ("activity_name", "category_name", "status", "metadata.uid", "process.name", "process.uid", "process.cmd_line", "actor.id", "actor.process.uid", "file.name", "file.path", "user.name", "user.id", "dst_endpoint.hostname", "src_endpoint.hostname",
            "device.hostname", "package.name", "finding_info.title", "unmapped.legacy_class_name")
    return found.select("event_id", "native", *whole, *[at(n, "string") for n in text])


def q_envelope_audit(spark, sf_dir):
    return envelopes.audit_lines(records(spark, sf_dir), "behaviorlens", fallback_ms=F.lit(0))


def q_review_selection(spark, sf_dir):
    merged = evaluation.merge_reviews(*reviews(spark, sf_dir))
    return evaluation.review_selection(combined(spark, sf_dir), merged, ["host", "window_start"], 3).drop("alert_precision")


def q_metric_trends(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    odd = F.when(F.col("k") % 7 == 0, "nan").when(F.col("k") % 7 == 1, "bad").otherwise(F.col("k").cast("string"))
    rows = ev.select(
        "event_id", fn.iso_z(F.col("epoch_us")).alias("timestamp"), F.col("value").alias("cpu_percent"), odd.alias("memory_percent"), F.col("k").alias("process_count"), F.col("value").alias("net_bytes_sent_per_sec"),
        F.when(F.col("k") % 3 > 0, F.col("k")).alias("net_bytes_recv_per_sec"), (F.col("value") * 1000).alias("disk_read_bytes_per_sec"), F.lit(None).cast("double").alias("disk_write_bytes_per_sec"),
    )
    return review.metric_trends(rows)


STREAM_FEATURES = ("value", "event_process_started_count", "event_unique_processes", "event_total_count")
STREAM_SCALER = {"value": (50.0, 40.0), "event_process_started_count": (1.0, 2.0), "event_unique_processes": (2.0, 1.5), "event_total_count": (4.0, 2.5)}
STREAM_W1 = np.array([[0.3, -0.2, 0.1, 0.4], [-0.5, 0.2, 0.6, 0.1]])
STREAM_W2 = np.array([[0.4, -0.3], [0.2, 0.5], [-0.6, 0.1], [0.3, 0.7]])
STREAM_LIMIT = 2.0


def _replayed(spark, sf_dir):
    """Events as a stream in which every tenth stands twice, scored by a stated model and the rules; the last windows are closed."""
    model = detectors.Autoencoder(list(STREAM_FEATURES), STREAM_SCALER, STREAM_W1, np.zeros(2), STREAM_W2, np.zeros(4), STREAM_LIMIT)
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    rows = ev_norm(spark, sf_dir).withColumn("ts", F.timestamp_micros("epoch_us")).select("event_id", "host", "ts", "event_type", "process_name", "user_name", "remote", "value")
    rows.unionByName(rows.where("event_id % 10 = 0")).write.parquet(f"{folder}/in")

    def build(stream):
        wide = replay.stream_combined(stream.withColumn("event_id", F.concat(F.lit("m"), "event_id")), stream.withColumn("event_id", F.concat(F.lit("e"), "event_id")), ["value"], DAY)
        return replay.scored(wide, model, LIMITS)

    return replay.replay(spark, f"{folder}/in", build, folder, 2 * DAY)


def q_stream_model_scores(spark, sf_dir):
    scores, _ = _replayed(spark, sf_dir)
    return scores.select("host", "window_start", "metric_sample_count", F.round("value", 6).alias("value"), "event_unique_processes", "event_total_count", F.round("model_ratio", 6).alias("model_ratio"),
                         F.round("ratio", 6).alias("ratio"), F.array_join("rules.rule_id", ",").alias("rules"), F.col("top_features")[0]["feature"].alias("top_feature"), "severity")


def q_stream_alerts(spark, sf_dir):
    _, alerts = _replayed(spark, sf_dir)
    return alerts.groupBy("host", "severity").agg(F.count("*").alias("alerts"), F.min("window_start").alias("first"), F.max("window_start").alias("last"))


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_RECORDS = EV + f"""
    , n AS (SELECT *, event_id AS i, CASE WHEN event_id % 6 > 0 THEN host ELSE 'unknown' END AS dev, {_LIST(CLASSES)}[k % 8 + 1] AS cls, [1007, 1001, 3002, 4001, 5020, 5001, 2004, 0][k % 8 + 1] AS cu,
        nullif({_LIST(ACTIVITIES)}[event_id % 5 + 1], '') AS act, {_LIST(STATUSES)}[k % 3 + 1] AS st, CASE WHEN event_id % 7 = 0 THEN 'dataset.optc' ELSE 'agent' END AS src,
        trunc(us::DOUBLE / 1e6 * 1000)::BIGINT AS ms, us // 1000 AS ms_own, event_id % 5 = 0 AS native FROM ev
        WHERE event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0),
    u AS (SELECT *, src = 'dataset.optc' AND cu IN (1007, 1001) AS g, CASE WHEN cu IN (5001, 5020) THEN 2 WHEN cu = 2004 THEN 1 WHEN cu = 1007 THEN CASE lower(act) WHEN 'launch' THEN 1 WHEN 'open' THEN 3 ELSE 99 END
        WHEN cu = 3002 THEN CASE lower(act) WHEN 'logon' THEN 1 ELSE 99 END WHEN cu = 4001 THEN CASE lower(act) WHEN 'open' THEN 1 ELSE 99 END ELSE 99 END AS ai FROM n)
"""
_STREAMED = EV + f"""
    , c AS (SELECT *, [(value - 50) / 40, (ps - 1) / 2::DOUBLE, (up - 2) / 1.5::DOUBLE, (n - 4) / 2.5::DOUBLE] AS z FROM w),
    h AS (SELECT *, [tanh(0.3 * z[1] - 0.2 * z[2] + 0.1 * z[3] + 0.4 * z[4]), tanh(-0.5 * z[1] + 0.2 * z[2] + 0.6 * z[3] + 0.1 * z[4])] AS h FROM c),
    d AS (SELECT *, [power(0.4 * h[1] - 0.3 * h[2] - z[1], 2), power(0.2 * h[1] + 0.5 * h[2] - z[2], 2), power(-0.6 * h[1] + 0.1 * h[2] - z[3], 2), power(0.3 * h[1] + 0.7 * h[2] - z[4], 2)] AS e FROM h),
    r AS (SELECT *, list_sum(e) / 4 / {STREAM_LIMIT} AS model_ratio, fx >= 2 AS f1, pi >= 2 AS f2, ps >= 3 AS f3, pe >= 2 AS f4 FROM d),
    s AS (SELECT host, window_start, n AS metric_sample_count, value, up AS event_unique_processes, n AS event_total_count, model_ratio,
        greatest(model_ratio, CASE WHEN f1 THEN CASE WHEN sx > 0 THEN 2.5 ELSE 1.0 END ELSE 0 END, CASE WHEN f2 OR f4 THEN 1.0 ELSE 0 END, CASE WHEN f3 THEN 2.5 ELSE 0 END)::DOUBLE AS ratio,
        concat_ws(',', CASE WHEN f1 THEN 'authentication_failure_burst' END, CASE WHEN f2 THEN 'package_change_burst' END, CASE WHEN f3 THEN 'process_start_burst' END, CASE WHEN f4 THEN 'privilege_elevation_burst' END) AS rules,
        {_LIST(STREAM_FEATURES)}[list_position(e, list_max(e))] AS top_feature FROM r),
    y AS (SELECT *, CASE WHEN ratio >= 5 THEN 'critical' WHEN ratio >= 2.5 THEN 'high' WHEN ratio >= 1 THEN 'medium' ELSE 'normal' END AS severity FROM s)
"""
CATALOGUE = {
    "review_selection": (q_review_selection, REVIEWS + """
        , g AS (SELECT count(*) AS alerts, count(*) FILTER (label <> 'unreviewed') AS reviewed, count(*) FILTER (label = 'benign') AS benign, count(*) FILTER (label = 'suspicious') AS suspicious,
            count(*) FILTER (label = 'confirmed_attack') AS confirmed_attack FROM rv),
        l AS (SELECT count(*) AS input_windows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rv WHERE rv.host = w.host AND rv.window_start = w.window_start AND label IN ('suspicious', 'confirmed_attack'))) AS selected_windows FROM w)
        SELECT *, input_windows - selected_windows AS excluded_windows, alerts - reviewed AS unreviewed, alerts - reviewed > 3 OR selected_windows = 0 AS blocked FROM l, g"""),
    "envelope_upgrade": (q_envelope_upgrade, _RECORDS + """
        SELECT i AS event_id, native, CASE WHEN native THEN CASE WHEN k % 2 = 0 THEN 4001 ELSE 1007 END ELSE cu END::BIGINT AS class_uid, CASE WHEN native THEN CASE WHEN k % 2 = 0 THEN 400101 ELSE 100701 END ELSE cu * 100 + ai END::BIGINT AS type_uid,
            CASE WHEN native THEN ms_own ELSE ms END AS time, 1::BIGINT AS severity_id,
            CASE WHEN native OR cu = 2004 THEN 1 ELSE CASE st WHEN 'success' THEN 1 WHEN 'FAILURE' THEN 2 ELSE 99 END END::BIGINT AS status_id,
            CASE WHEN NOT native AND cu = 1007 AND NOT g THEN k END AS process_pid, CASE WHEN NOT native AND cu IN (3002, 4001) AND i % 4 = 0 AND i % 8 <> 0 THEN k END AS dst_endpoint_port,
            CASE WHEN NOT native AND g THEN 0 END::BIGINT AS device_type_id, CASE WHEN NOT native AND g AND cu = 1001 THEN 0 END::BIGINT AS file_type_id, CASE WHEN NOT native AND cu = 2004 THEN ms END AS finding_info_created_time,
            CASE WHEN native THEN 'Open' WHEN cu IN (5001, 5020) THEN 'Collect' WHEN cu = 2004 THEN 'Create' WHEN cu = 1007 AND ai = 1 THEN 'Launch' WHEN cu = 3002 AND ai = 1 THEN 'Logon' ELSE coalesce(act, 'Other') END AS activity_name,
            CASE WHEN native OR cu = 4001 THEN 'Network Activity' ELSE CASE cu // 1000 WHEN 1 THEN 'System Activity' WHEN 2 THEN 'Findings' WHEN 3 THEN 'Identity & Access Management' WHEN 5 THEN 'Discovery' ELSE 'Uncategorized' END END AS category_name,
            CASE WHEN native THEN NULL WHEN cu = 2004 THEN 'New' ELSE upper(st[1]) || lower(st[2:]) END AS status, CASE WHEN NOT native OR k % 3 > 0 THEN i::VARCHAR END AS metadata_uid,
            CASE WHEN native OR cu <> 1007 THEN NULL WHEN g THEN 'unknown' ELSE coalesce(nullif(process_name, 'p3'), 'unknown') END AS process_name, CASE WHEN NOT native AND g AND cu = 1007 THEN 'o1' END AS process_uid,
            CASE WHEN NOT native AND NOT g AND cu = 1007 THEN 'run -' || k END AS process_cmd_line, CASE WHEN NOT native AND NOT g AND cu = 1007 THEN 'a1' END AS actor_id, CASE WHEN NOT native AND g THEN 'a1' END AS actor_process_uid,
            CASE WHEN NOT native AND g AND cu = 1001 THEN 'unknown' END AS file_name, CASE WHEN NOT native AND NOT g AND cu = 1001 THEN CASE WHEN i % 3 = 0 THEN '/f/' || k ELSE 'unknown' END END AS file_path,
            CASE WHEN NOT native AND cu = 3002 AND i % 3 <> 1 THEN 'unknown' END AS user_name, CASE WHEN NOT native AND cu = 3002 AND i % 3 = 1 THEN remote END AS user_id,
            CASE WHEN native THEN NULL WHEN cu = 3002 AND i % 4 <> 0 THEN dev WHEN cu = 4001 AND i % 4 = 0 THEN remote END AS dst_endpoint_hostname,
            CASE WHEN native THEN CASE WHEN k % 4 = 0 THEN 'h' END WHEN cu = 4001 AND i % 4 <> 0 THEN dev END AS src_endpoint_hostname, CASE WHEN NOT native AND (g OR cu IN (5001, 5020)) THEN dev END AS device_hostname,
            CASE WHEN NOT native AND cu = 5020 THEN remote END AS package_name, CASE WHEN NOT native AND cu = 2004 THEN coalesce(act, event_type) END AS finding_info_title, CASE WHEN NOT native THEN cls END AS unmapped_legacy_class_name FROM u"""),
    "envelope_audit": (q_envelope_audit, _RECORDS + """
        , f AS (SELECT CASE WHEN event_id % 29 = 0 THEN 'malformed JSON' WHEN event_id % 31 = 0 THEN 'record is not an object' END AS name FROM ev WHERE event_id % 29 = 0 OR event_id % 31 = 0),
        b AS (SELECT *, native AND (k % 2 = 1 OR k % 3 = 0 OR k % 5 = 0 OR k % 4 <> 0) AS bad FROM u),
        x AS (SELECT 'issue' AS kind, name FROM f
            UNION ALL SELECT 'issue', unnest(list_filter([CASE WHEN k % 3 = 0 THEN 'metadata.uid is required' END, CASE WHEN k % 5 = 0 THEN 'metadata.logged_time must equal time' END,
                CASE WHEN k % 2 = 1 THEN 'category_uid must be 1 for class_uid 1007' END, CASE WHEN k % 2 = 1 THEN 'class_name must be Process Activity for class_uid 1007' END, CASE WHEN k % 2 = 1 THEN 'process is required for class_uid 1007' END,
                CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 'Network Activity requires src_endpoint or dst_endpoint' END], lambda v: v IS NOT NULL)) FROM b WHERE native
            UNION ALL SELECT 'class', CASE WHEN native OR cu = 4001 THEN 'Network Activity' ELSE CASE cu WHEN 3002 THEN 'Authentication' WHEN 5001 THEN 'Device Inventory Info' WHEN 2004 THEN 'Detection Finding' WHEN 0 THEN 'Base Event' ELSE cls END END FROM b),
        t AS (SELECT count(*) AS records, count(*) FILTER (native) AS native_envelopes, count(*) FILTER (NOT native) AS legacy_records_migrated, count(*) FILTER (bad) + (SELECT count(*) FROM f) AS invalid_records FROM b)
        SELECT kind, name, count(*) AS n FROM x GROUP BY ALL
        UNION ALL SELECT 'total', name, n FROM (SELECT *, (records > 0 AND invalid_records = 0)::BIGINT AS valid FROM t) UNPIVOT (n FOR name IN (records, native_envelopes, legacy_records_migrated, invalid_records, valid))"""),
    "metric_trends": (q_metric_trends, EV + """
        SELECT CASE WHEN us % 1000000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') END AS timestamp, value AS cpu,
            CASE WHEN k % 7 < 2 THEN 0 ELSE k END::DOUBLE AS memory, k::DOUBLE AS processes, (value + CASE WHEN k % 3 > 0 THEN k ELSE 0 END) / 1024 AS network_kbps, value * 1000 / 1048576 AS disk_mbps FROM ev"""),
    "stream_model_scores": (q_stream_model_scores, _STREAMED + """
        SELECT host, window_start, metric_sample_count, round(value, 6) AS value, event_unique_processes, event_total_count, round(model_ratio, 6) AS model_ratio, round(ratio, 6) AS ratio, rules, top_feature, severity FROM y"""),
    "stream_alerts": (q_stream_alerts, _STREAMED + "SELECT host, severity, count(*) AS alerts, min(window_start) AS first, max(window_start) AS last FROM y WHERE ratio >= 1 GROUP BY host, severity"),
}
