"""Whole reports over the driver's tables, each with its DuckDB SQL: combined evaluation at full width, comparison, incidents, nested redaction, survivors, lines."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.operators import detectors, quality, sessions
from behaviorlens.plans import api
from behaviorlens.plans.behaviour import DAY, EV, SESSION, alerts, combined, ev_norm, read
from behaviorlens.plans.records import _redacted
from behaviorlens.sources import files
from behaviorlens.sources.store import shared_dir

WIDE = api.MODEL_FEATURES
SCALER = {f: (10.0 + i, 5.0 + i) for i, f in enumerate(WIDE)}
W1 = np.array([[((i * 7 + j * 3) % 11 - 5) / 20 for i in range(len(WIDE))] for j in range(12)])
W2 = np.array([[((i * 5 + j * 2) % 9 - 4) / 20 for j in range(12)] for i in range(len(WIDE))])


def wide(spark, sf_dir) -> DataFrame:
    """Day windows with all 37 features: the 22 metrics follow from the means of value and k; every third day is an attack."""
    metric = {f: F.col("value") * ((i + 1) / 22) + F.col("k") / (i + 2) for i, f in enumerate(api.FEATURES)}
    day = F.floor(F.col("window_start") / DAY) % 3
    return combined(spark, sf_dir).withColumns(metric).withColumn("scenario", F.when(day == 0, "attack").otherwise("normal"))


def q_combined_evaluation(spark, sf_dir):
    """Splits, calibration, the three methods, their agreement and their delays, by a model of stated weights that the validation split calibrates."""
    model = detectors.Autoencoder(WIDE, SCALER, W1, np.zeros(12), W2, np.zeros(len(WIDE)))
    found = api.evaluate_combined(wide(spark, sf_dir), model=model)
    methods = found["methods"].join(found["delays"], "method")
    both = found["disagreement"].groupBy().agg(F.sum(F.when(F.col("model_flag") & ~F.col("rule_flag"), F.col("windows")).otherwise(0)).alias("model_only"), F.sum(F.when(~F.col("model_flag") & F.col("rule_flag"), F.col("windows")).otherwise(0)).alias("rules_only"))
    rounded = ("anomaly_rate", "precision", "recall", "false_positive_rate", "accuracy", "mean_delay")
    return methods.crossJoin(F.broadcast(both)).select(  # one row
        "method", "windows", "anomalies", "labelled_windows", "tp", "fp", "tn", "fn", "attack_runs", "detected_runs", "missed_runs", "max_delay", "model_only", "rules_only", *[F.round(c, 6).alias(c) for c in rounded],
    )


def q_evaluation_splits(spark, sf_dir):
    model = detectors.Autoencoder(WIDE, SCALER, W1, np.zeros(12), W2, np.zeros(len(WIDE)))
    return api.evaluate_combined(wide(spark, sf_dir), model=model)["dataset"]


def q_detector_comparison(spark, sf_dir):
    """Autoencoder, robust z-scores and EWMA, fitted, calibrated and judged in time order."""
    found = api.compare_detectors(wide(spark, sf_dir), ["value", "k", "event_process_started_count", "event_process_stopped_count", "event_total_count"], epochs=8)
    return found.select("method", "windows", "anomalies", "labelled_windows", "tp", "fp", "tn", "fn")


def signals(spark, sf_dir):
    """Alerts with string ids, some severities in capitals, missing or unknown."""
    i = F.col("event_id")
    level = F.when(i % 7 == 0, "weird").when(i % 5 == 0, F.upper("severity")).when(i % 11 == 0, F.lit(None)).otherwise(F.col("severity"))
    note = F.when(i % 3 == 0, F.concat(F.lit("saw "), "event_type"))
    return alerts(spark, sf_dir).withColumn("severity", level).withColumn("description", note).withColumn("timestamp", fn.iso_z(F.col("epoch_us"))).withColumn("event_id", F.format_string("e%010d", i))


def q_incident_records(spark, sf_dir):
    found = sessions.incident_records(signals(spark, sf_dir), DAY * 1_000_000, 20)
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("event_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    lines = F.array_join(F.transform("timeline", lambda t: F.concat_ws("|", t["timestamp"], t["type"], t["severity"], t["summary"])), ";")
    return found.select("incident_id", "host", "first_timestamp", "last_timestamp", "severity", "signal_count", kinds.alias("event_types"), lines.alias("timeline"))


def q_alert_groups_text(spark, sf_dir):
    groups = sessions.group_alerts(signals(spark, sf_dir), 2 * DAY * 1_000_000)
    return groups.select("fingerprint", "session", "count", "severity", F.array_join("evidence", ",").alias("evidence"))


def nested(spark, sf_dir):
    """Documents as records with structs, lists and maps, some of whose names and texts are secrets."""
    i = F.col("doc_id")
    auth = F.struct(F.when(i % 3 == 0, F.concat(F.lit("t"), i)).when(i % 3 == 1, "").alias("api-key"), F.col("lang").alias("user"))
    steps = F.array(F.struct(F.col("source").alias("name"), F.when(i % 4 == 0, F.concat(F.lit("pwd="), i)).otherwise("ok").alias("args")), F.struct(F.lit("x").alias("name"), F.lit("token: [REDACTED]").alias("args")))
    tags = F.create_map(F.lit("session_id"), F.when(i % 5 == 0, "[REDACTED]").otherwise(i.cast("string")), F.lit("kind"), F.lit("k"))
    return read(spark, sf_dir, "documents").select("doc_id", F.struct(auth.alias("auth"), steps.alias("steps"), tags.alias("tags"), F.coalesce("text", F.lit("")).alias("body")).alias("record"))


def q_nested_exposures(spark, sf_dir):
    return quality.nested_exposures(nested(spark, sf_dir), "doc_id", "record")


def q_nested_redaction(spark, sf_dir):
    df = nested(spark, sf_dir)
    r = df.select("doc_id", fn.redact_nested(F.col("record"), df.schema["record"].dataType).alias("r"))
    return r.select("doc_id", F.col("r.auth.api-key").alias("api_key"), F.col("r.steps")[0]["args"].alias("args"), F.col("r.tags")["session_id"].alias("session_id"), F.sha2("r.body", 256).alias("body"))


def q_survivors(spark, sf_dir):
    """Mail addresses of any document that still stand in a redacted text."""
    docs = read(spark, sf_dir, "documents")
    mail = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)"), 1)).alias("value"))
    return quality.survivors(mail, docs.select("doc_id", fn.redact_text(F.col("text")).alias("text")), "doc_id", "text")


def q_line_diagnostics(spark, sf_dir):
    """Events as lines of JSON, some of them blank, broken or no objects, written to files and scanned."""
    i = F.col("event_id")
    line = F.when(i % 17 == 0, '{"id": ').when(i % 19 == 0, "  ").when(i % 23 == 0, "[1, 2]").otherwise(F.concat(F.lit('{"id": '), i, F.lit("}")))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return files.scan_diagnostics(spark, path + "/*.txt").drop("segments")


_Z = [f"((value * {(i + 1) / 22!r}::DOUBLE + k / {i + 2}) - {SCALER[f][0]!r}::DOUBLE) / {SCALER[f][1]!r}::DOUBLE" for i, f in enumerate(api.FEATURES)]
_C = dict(zip(WIDE[len(api.FEATURES):], ("ps", "pt", "sx", "fx", "0", "0", "pe", "pi", "0", "0", "0", "up", "0", "ur", "n"), strict=True))
_Z += [f"({c} - {SCALER[f][0]!r}::DOUBLE) / {SCALER[f][1]!r}::DOUBLE" for f, c in _C.items()]
_SUM = lambda xs, ws: " + ".join(f"{x} * {float(w)!r}::DOUBLE" for x, w in zip(xs, ws, strict=True))
_RANK = lambda v, q: f"max({v}) FILTER (r = round_even((m - 1) * {q}, 0))"
_EVALUATED = EV + f"""
    , x AS (SELECT host, window_start, CASE WHEN (window_start // 86400) % 3 = 0 THEN 'attack' ELSE 'normal' END AS scenario, fx, sx, pi, ps, pe, [{', '.join(_Z)}] AS z FROM w),
    h AS (SELECT *, [{', '.join('tanh(' + _SUM([f'z[{i + 1}]' for i in range(len(WIDE))], w) + ')' for w in W1)}] AS h FROM x),
    o AS (SELECT host, window_start, scenario, fx, sx, pi, ps, pe, ({' + '.join('power(' + _SUM([f'h[{j + 1}]' for j in range(12)], w) + f' - z[{i + 1}], 2)' for i, w in enumerate(W2))}) / {len(WIDE)} AS error FROM h),
    p AS (SELECT *, row_number() OVER (ORDER BY window_start, host) - 1 AS pos, count(*) OVER () AS n FROM o),
    s AS (SELECT *, CASE WHEN pos < n - 2 * greatest(1, floor(n * 0.15)) THEN 'train' WHEN pos < n - greatest(1, floor(n * 0.15)) THEN 'validation' ELSE 'test' END AS split FROM p)
"""
_LIMITS = ", ".join(
    f"greatest({d}, (SELECT {_RANK('v', 0.995)} FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS m FROM s WHERE split = 'train' AND scenario = 'normal')) + 1) AS l{c}"
    for c, d in (("fx", 5), ("pi", 3), ("ps", 20), ("pe", 3))
)
_METHODS = _EVALUATED + f"""
    , v AS (SELECT error, row_number() OVER (ORDER BY error) - 1 AS r, count(*) OVER () AS m FROM s WHERE split = 'validation' AND scenario = 'normal'),
    t AS (SELECT greatest({_RANK('error', 0.995)}, avg(error) + 3 * stddev_pop(error), 1e-9) AS threshold FROM v), l AS (SELECT {_LIMITS}),
    f AS (SELECT row_number() OVER (ORDER BY pos) AS i, scenario <> 'normal' AS attack, error / threshold >= 1 AS ml, fx >= lfx OR pi >= lpi OR ps >= lps OR pe >= lpe AS rules FROM s, t, l WHERE split = 'test'),
    d AS (SELECT count(*) FILTER (ml AND NOT rules)::BIGINT AS model_only, count(*) FILTER (rules AND NOT ml)::BIGINT AS rules_only FROM f),
    m AS (SELECT i, attack, method, flag FROM (SELECT i, attack, ml, rules, ml OR rules AS combined FROM f) UNPIVOT (flag FOR method IN (ml, rules, combined))),
    c AS (SELECT method, count(*) AS windows, count(*) FILTER (flag) AS anomalies, count(*) AS labelled_windows, count(*) FILTER (flag AND attack) AS tp, count(*) FILTER (flag AND NOT attack) AS fp,
          count(*) FILTER (NOT flag AND NOT attack) AS tn, count(*) FILTER (NOT flag AND attack) AS fn FROM m GROUP BY method),
    g AS (SELECT method, i, flag, i - row_number() OVER (PARTITION BY method ORDER BY i) AS run FROM m WHERE attack),
    u AS (SELECT method, run, min(i) FILTER (flag) - min(i) AS delay FROM g GROUP BY ALL),
    y AS (SELECT method, count(*) AS attack_runs, count(delay) AS detected_runs, count(*) FILTER (delay IS NULL) AS missed_runs, max(delay) AS max_delay, round(avg(delay), 6) AS mean_delay FROM u GROUP BY method)
    SELECT method, windows, anomalies, labelled_windows, tp, fp, tn, fn, attack_runs, detected_runs, missed_runs, max_delay, mean_delay, model_only, rules_only, round(anomalies / windows, 6) AS anomaly_rate,
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate, round((tp + tn) / windows, 6) AS accuracy
    FROM c JOIN y USING (method), d"""

_SIGNALS = SESSION + """
    , a1 AS (SELECT * EXCLUDE (rk), CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 5 = 0 THEN rk WHEN event_id % 11 = 0 THEN 0 ELSE rk END AS rk, format('e{:010d}', event_id) AS eid,
        CASE WHEN us % 1000000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') END AS ts, CASE WHEN event_id % 3 = 0 THEN 'saw ' || event_type ELSE 'security signal' END AS summary FROM a0)
"""
_NAME = "['informational', 'low', 'medium', 'high', 'critical'][{} + 1]"
CATALOGUE = {
    "combined_evaluation": (q_combined_evaluation, _METHODS),
    "evaluation_splits": (q_evaluation_splits, _EVALUATED + "SELECT split, count(*) AS rows, count(*) FILTER (scenario = 'normal') AS normal_rows FROM s GROUP BY split"),
    "detector_comparison": (q_detector_comparison, None),
    "incident_records": (q_incident_records, EV + _SIGNALS + f"""
        , i0 AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY host ORDER BY us, eid) > 86400000000)::INT, 0) AS new FROM a1),
        i1 AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY us, eid) AS session FROM i0),
        i2 AS (SELECT *, row_number() OVER (PARTITION BY host, session ORDER BY us, eid) AS place FROM i1),
        i3 AS (SELECT host, session, count(*) AS signal_count, min_by(ts, place) AS first_timestamp, max_by(ts, place) AS last_timestamp, max(rk) AS rk,
            string_agg(ts || '|' || event_type || '|' || {_NAME.format('rk')} || '|' || summary, ';' ORDER BY place) FILTER (place <= 20) AS timeline FROM i2 GROUP BY host, session),
        i4 AS (SELECT host, session, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS event_types FROM (SELECT host, session, event_type, count(*) AS n FROM i2 GROUP BY ALL) GROUP BY ALL)
        SELECT host || ':' || first_timestamp || ':' || signal_count AS incident_id, host, first_timestamp, last_timestamp, {_NAME.format('rk')} AS severity, signal_count, event_types, timeline FROM i3 JOIN i4 USING (host, session)"""),
    "alert_groups_text": (q_alert_groups_text, EV + _SIGNALS + f"""
        , g0 AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY fp ORDER BY us, eid) > 172800000000)::INT, 0) AS new FROM a1),
        g1 AS (SELECT *, sum(new) OVER (PARTITION BY fp ORDER BY us, eid) AS session FROM g0)
        SELECT fp AS fingerprint, session::BIGINT AS session, count(*) AS count, {_NAME.format('max(rk)')} AS severity, array_to_string(list(eid ORDER BY us, eid)[1:20], ',') AS evidence FROM g1 GROUP BY fp, session"""),
    "nested_exposures": (q_nested_exposures, f"""
        SELECT doc_id, '$.auth.api-key' AS path, 'unredacted sensitive field' AS reason FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, '$.steps[0].args', 'secret-like text' FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, '$.tags.session_id', 'unredacted sensitive field' FROM documents WHERE doc_id % 5 <> 0
        UNION ALL SELECT doc_id, '$.body', 'secret-like text' FROM documents WHERE {_redacted("coalesce(text, '')")} <> coalesce(text, '')"""),
    "nested_redaction": (q_nested_redaction, f"""
        SELECT doc_id, '[REDACTED]' AS api_key, CASE WHEN doc_id % 4 = 0 THEN 'pwd=[REDACTED]' ELSE 'ok' END AS args, '[REDACTED]' AS session_id, sha256({_redacted("coalesce(text, '')")}) AS body FROM documents"""),
    "privacy_survivors": (q_survivors, f"""
        WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS value FROM documents), r AS (SELECT doc_id, {_redacted('text')} AS text FROM documents)
        SELECT DISTINCT doc_id, value FROM r JOIN v ON length(value) >= 8 AND contains(text, value)"""),
    "line_diagnostics": (q_line_diagnostics, """
        WITH l AS (SELECT CASE WHEN event_id % 17 = 0 THEN '{"id": ' WHEN event_id % 19 = 0 THEN '  ' WHEN event_id % 23 = 0 THEN '[1, 2]' ELSE '{"id": ' || event_id || '}' END AS line,
            CASE WHEN event_id % 17 = 0 THEN 1 WHEN event_id % 19 = 0 THEN 2 WHEN event_id % 23 = 0 THEN 3 ELSE 4 END AS kind FROM events)
        SELECT sum(strlen(line) + 1)::BIGINT AS bytes, count(*) AS total, count(*) FILTER (kind = 2) AS blank, count(*) FILTER (kind = 1) AS malformed, count(*) FILTER (kind = 3) AS non_object,
            0::BIGINT AS trailing_partial, count(*) FILTER (kind = 4) AS valid FROM l"""),
}
