"""Behaviour queries over the driver's tables, each with its DuckDB SQL.

Views, in both engines: ``ev_norm`` reads events as normalised host events with metrics value and
k; windows are days of one host; ``item`` reads lineitem as a four-feature metric.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.operators import detectors, evaluation, ordering, quality, rules, sessions, windows
from behaviorlens.sources.store import stored

DAY = 86_400
#: Rule thresholds at which days of these tables fire.
LIMITS = {"authentication_failure_burst": 2, "package_change_burst": 2, "process_start_burst": 3, "privilege_elevation_burst": 2}
ITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(-?\d+)", 1).cast("long")
    kind = (
        F.when(F.col("event_type") == "click", "process_started").when(F.col("event_type") == "view", "process_stopped")
        .when(F.col("event_type") == "error", "authentication_failure").when(F.col("event_type") == "signup", "authentication_success")
        .when(F.col("value") >= 100, "privilege_elevation").otherwise("package_installed")
    )
    e = read(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("host"), fn.epoch_micros(F.col("ts")).alias("epoch_us"), kind.alias("event_type"),
        F.when(F.col("k") % 10 == 0, "unknown").otherwise(F.concat(F.lit("p"), F.col("k") % 10)).alias("process_name"), F.lit("unknown").alias("user_name"),
        F.when(F.col("k") % 5 == 0, "local").otherwise(F.concat(F.lit("r"), F.col("k") % 5)).alias("remote"), "value", "k",
    )


EV = r"""
    WITH e0 AS (SELECT *, CAST(regexp_extract(props, '(-?\d+)', 1) AS BIGINT) AS k FROM events),
    ev AS (SELECT event_id, 'u' || user_id AS host, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s,
        CASE WHEN event_type = 'click' THEN 'process_started' WHEN event_type = 'view' THEN 'process_stopped'
             WHEN event_type = 'error' THEN 'authentication_failure' WHEN event_type = 'signup' THEN 'authentication_success'
             WHEN value >= 100 THEN 'privilege_elevation' ELSE 'package_installed' END AS event_type,
        CASE WHEN k % 10 = 0 THEN 'unknown' ELSE 'p' || (k % 10) END AS process_name,
        CASE WHEN k % 5 = 0 THEN 'local' ELSE 'r' || (k % 5) END AS remote, value, k FROM e0),
    w AS (SELECT host, s - s % 86400 AS window_start, count(*) AS n, sum(value) / count(*) AS value, sum(k) / count(*) AS k,
        count(*) FILTER (event_type = 'process_started') AS ps, count(*) FILTER (event_type = 'process_stopped') AS pt,
        count(*) FILTER (event_type = 'authentication_success') AS sx, count(*) FILTER (event_type = 'authentication_failure') AS fx,
        count(*) FILTER (event_type = 'privilege_elevation') AS pe, count(*) FILTER (event_type = 'package_installed') AS pi,
        count(DISTINCT process_name) FILTER (process_name <> 'unknown') AS up, count(DISTINCT remote) FILTER (remote <> 'local') AS ur
        FROM ev GROUP BY ALL)
"""
RULES = """
    , r AS (SELECT *, fx >= 2 AS f1, pi >= 2 AS f2, ps >= 3 AS f3, pe >= 2 AS f4, value / 100 AS model_ratio FROM w),
    z AS (SELECT *, greatest(model_ratio, CASE WHEN f1 THEN CASE WHEN sx > 0 THEN 2.5 ELSE 1.0 END ELSE 0 END, CASE WHEN f2 OR f4 THEN 1.0 ELSE 0 END,
        CASE WHEN f3 THEN 2.5 ELSE 0 END) AS ratio,
        concat_ws(',', CASE WHEN f1 THEN 'authentication_failure_burst' END, CASE WHEN f2 THEN 'package_change_burst' END,
                  CASE WHEN f3 THEN 'process_start_burst' END, CASE WHEN f4 THEN 'privilege_elevation_burst' END) AS rules FROM r)
"""


def combined(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    return windows.combined_windows(ev, ev, ["value", "k"], DAY, "event_id")


def scored(spark, sf_dir):
    return rules.fuse(combined(spark, sf_dir), F.col("value") / 100, LIMITS)


def q_combined_windows(spark, sf_dir):
    return combined(spark, sf_dir).select(
        "host", "window_start", "metric_sample_count", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"), "event_process_started_count",
        "event_process_stopped_count", "event_authentication_failure_count", "event_package_installed_count", "event_unique_processes",
        "event_unique_users", "event_unique_remote_sources", "event_total_count",
    )


def q_label_mode(spark, sf_dir):
    ev = ev_norm(spark, sf_dir).withColumn("scenario", F.concat(F.lit("s"), F.col("k") % 3))
    return windows.window_labels(ev, "scenario", DAY, "event_id")


def q_security_rules(spark, sf_dir):
    return combined(spark, sf_dir).select("host", "window_start", F.explode(rules.security_rules(LIMITS)).alias("r")).select("host", "window_start", "r.*")


def q_scored_windows(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "host", "window_start", F.array_join("rules.rule_id", ",").alias("rules"), F.round("ratio", 6).alias("ratio"), "is_anomaly", "severity"
    )


def q_rule_calibration(spark, sf_dir):
    found = rules.calibrate_rules(combined(spark, sf_dir), 0.995)
    return found.select("rule_id", "quantile", "p50", "p95", "p99", "threshold", F.round("default_exceedance", 6).alias("default_exceedance"), F.round("calibrated_exceedance", 6).alias("calibrated_exceedance"))


def q_quantiles(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"))
    return ordering.quantiles_by(items, "supplier", "price", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def q_global_quantile(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_extendedprice")
    return spark.createDataFrame([(q, ordering.order_statistic(items, "l_extendedprice", q)) for q in (0.5, 0.995)], "q double, price double")


def q_scaler_fit(spark, sf_dir):
    scaler = detectors.fit_scaler(read(spark, sf_dir, "lineitem"), ITEM)
    return spark.createDataFrame([(f, round(m, 6), round(s, 6)) for f, (m, s) in scaler.items()], "feature string, mean double, std double")


def q_standardised(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    z = detectors.standardise(ITEM, detectors.fit_scaler(items, ITEM))
    return items.withColumn("z", z).groupBy("l_suppkey").agg(*[F.round(F.sum(F.col("z")[i]), 4).alias(f"z_{f}") for i, f in enumerate(ITEM)])


def robust_profile(items):
    return {r["feature"]: (r["center"], r["scale"]) for r in detectors.fit_robust(items, ITEM).collect()}


def q_robust_fit(spark, sf_dir):
    return detectors.fit_robust(read(spark, sf_dir, "lineitem"), ITEM).select("feature", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


def q_robust_scores(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.round(detectors.robust_score(ITEM, robust_profile(items)), 6).alias("score"))


def halves(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    late = F.year(F.col("l_shipdate").cast("timestamp")) >= 1997
    return items.where(~late), items.where(late)


def q_drift(spark, sf_dir):
    found = detectors.drift_compare(*halves(spark, sf_dir), ITEM)
    return found.select("feature", *[F.round(c, 6).alias(c) for c in ("reference_median", "current_median", "robust_shift")], "drifted")


def fixed_model() -> detectors.Autoencoder:
    """A small model with stated weights, so that its scores can be checked elsewhere."""
    w1 = np.array([[0.5, -0.25, 0.125, 0.0], [0.0, 0.5, -0.5, 0.25]])
    w2 = np.array([[0.5, 0.0], [-0.25, 0.5], [0.125, -0.5], [0.0, 0.25]])
    scaler = dict(zip(ITEM, [(25.0, 15.0), (40000.0, 25000.0), (0.05, 0.03), (0.04, 0.025)], strict=True))
    return detectors.Autoencoder(ITEM, scaler, w1, np.zeros(2), w2, np.zeros(4), threshold=2.0)


def q_autoencoder_score(spark, sf_dir):
    out = fixed_model().apply(read(spark, sf_dir, "lineitem"), 2)
    return out.select("l_orderkey", "l_linenumber", F.round("model_error", 6).alias("error"), F.col("top_features")[0]["feature"].alias("top_feature"), fn.severity(F.col("model_ratio")).alias("severity"))


def q_category(spark, sf_dir):
    c = lambda name: F.struct(F.lit(f"event_{name}").alias("feature"), F.col(f"event_{name}").cast("double").alias("contribution"))
    top = F.array(*[c(n) for n in ("process_started_count", "process_stopped_count", "authentication_failure_count", "authentication_success_count", "package_installed_count")])
    return combined(spark, sf_dir).select("host", "window_start", rules.category(top).alias("category"))


def alerts(spark, sf_dir):
    """Elevations, failures and installs as alerts."""
    ev = ev_norm(spark, sf_dir).where(F.col("event_type").isin("authentication_failure", "privilege_elevation", "package_installed"))
    level = F.when(F.col("value") >= 150, "critical").when(F.col("value") >= 100, "high").when(F.col("value") >= 50, "medium").otherwise("low")
    return ev.withColumn("severity", level).withColumn("fingerprint", fn.fingerprint(F.col("host"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.col("event_type")))


def q_alert_groups(spark, sf_dir):
    groups = sessions.group_alerts(alerts(spark, sf_dir), 2 * DAY * 1_000_000)
    return groups.select("fingerprint", "session", "count", "first_us", "last_us", "severity", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


def incident_rows(found):
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("event_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.select("host", "session", "signal_count", "first_us", "last_us", "severity", kinds.alias("event_types"))


def q_incidents(spark, sf_dir):
    return incident_rows(sessions.correlate_incidents(alerts(spark, sf_dir), DAY * 1_000_000))


def q_grouped_incidents(spark, sf_dir):
    groups = sessions.group_alerts(alerts(spark, sf_dir), 2 * DAY * 1_000_000)
    signals = groups.select("host", F.col("first_us").alias("epoch_us"), F.col("evidence")[0].alias("event_id"), "event_type", "severity")
    return incident_rows(sessions.correlate_incidents(signals, DAY * 1_000_000))


def q_coverage(spark, sf_dir):
    found = sessions.coverage(windows.with_window(ev_norm(spark, sf_dir), DAY), DAY)
    return found.select("host", "observed", "expected", F.round("coverage", 6).alias("coverage"))


def q_gaps(spark, sf_dir):
    return sessions.window_gaps(windows.with_window(ev_norm(spark, sf_dir), DAY), DAY)


def q_top_gaps(spark, sf_dir):
    return q_gaps(spark, sf_dir).orderBy(F.desc("gap_seconds"), "host", "gap_start").limit(100)


def shuffled(spark, sf_dir):
    """Events with a row number in an order that is not that of time."""
    return ev_norm(spark, sf_dir).withColumn("row_no", F.pmod(F.col("event_id") * 7919, F.lit(1_000_003)))


def q_out_of_order_prev(spark, sf_dir):
    placed = ordering.with_position(shuffled(spark, sf_dir), "row_no", ["event_id"])
    return sessions.behind_previous(placed, "epoch_us").where("out_of_order").select("event_id", "pos")


def q_out_of_order_max(spark, sf_dir):
    rows = shuffled(spark, sf_dir)
    late = sessions.behind_running_max(rows, ["host"], "epoch_us", ["row_no"])
    return rows.withColumn("late", late).groupBy("host").agg(F.count_if("late").alias("late"), F.count("*").alias("events"))


def doubled(spark, sf_dir):
    """Events of which every tenth comes twice."""
    ev = shuffled(spark, sf_dir)
    return ev.unionByName(ev.where("event_id % 10 = 0").withColumn("row_no", F.col("row_no") + 2_000_003))


def q_replay_dedup(spark, sf_dir):
    return sessions.first_wins(doubled(spark, sf_dir), ["event_id"], ["epoch_us", "row_no"]).select("event_id", "row_no", "copies")


def corrupted(spark, sf_dir):
    """Doubled events with textual timestamps and values, some of them missing or bad."""
    ev = doubled(spark, sf_dir)
    i = F.col("event_id")
    stamp = F.when(i % 17 == 0, "").when(i % 19 == 0, "soon").otherwise(fn.iso_z(F.col("epoch_us")))
    value = F.when(i % 13 == 0, F.lit(None)).when(i % 29 == 0, "many").when(i % 31 == 0, "Infinity").when(i % 37 == 0, "-5").otherwise(F.floor("value").cast("string"))
    note = F.when(i % 41 == 0, F.concat(F.lit("token = x"), i)).otherwise("nothing")
    return ev.select("event_id", F.when(i % 23 == 0, "").otherwise(F.col("host")).alias("host"), stamp.alias("timestamp"), value.alias("value"), F.col("k").cast("string").alias("k"), "row_no", note.alias("note"))


def q_timestamp_audit(spark, sf_dir):
    return quality.timestamp_audit(corrupted(spark, sf_dir)).select("host", "rows", "missing", "invalid", "usable", "duplicates", F.floor("first").alias("first"), F.floor("last").alias("last"))


def q_feature_audit(spark, sf_dir):
    return quality.feature_audit(corrupted(spark, sf_dir), ["value", "k"])


def issues(spark, sf_dir):
    return quality.record_issues(corrupted(spark, sf_dir), ["host"], ["value", "k"], ["value"], "row_no", ["note"])


def q_record_issues(spark, sf_dir):
    found = quality.issue_summary(issues(spark, sf_dir))
    return found.select("level", "code", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def q_quality_score(spark, sf_dir):
    found = issues(spark, sf_dir).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    rows = corrupted(spark, sf_dir).agg(F.count("*").alias("rows"))
    score = quality.quality_score(F.col("rows"), F.col("errors"), F.col("warnings"))
    return rows.crossJoin(F.broadcast(found)).withColumn("quality", F.round(score, 6))


def q_noisy_rules(spark, sf_dir):
    return quality.noisy_rules(scored(spark, sf_dir)).select("rule_id", "windows", F.round("ratio", 6).alias("ratio"), "noisy")


def q_readiness(spark, sf_dir):
    w = scored(spark, sf_dir)
    noisy = [r["rule_id"] for r in quality.noisy_rules(w).where("noisy").collect()]
    clean = quality.clean_windows(w, noisy).groupBy("host").agg(F.count("*").alias("clean"))
    found = w.groupBy("host").agg(F.count("*").alias("windows"), F.sum(F.size("rules").cast("long")).alias("hits")).join(clean, "host", "left").fillna(0, ["clean"])
    return found.withColumn("state", quality.readiness(F.col("clean"), F.lit(0), F.col("windows") - F.col("clean"), 5, 20))


def q_split(formula):
    def run(spark, sf_dir):
        found = ordering.chronological_split(ev_norm(spark, sf_dir), "epoch_us", ["host", "event_id"], formula)
        return found.groupBy("split").agg(F.count("*").alias("rows"), F.min("epoch_us").alias("first_us"), F.max("epoch_us").alias("last_us"))

    return run


def judged(spark, sf_dir):
    """Labels as attack flags with two predictions: length of the text and its number of exclamation marks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    loud = F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", (F.col("quality") == 0).alias("attack"), (loud > 5).alias("loud"), (F.col("n_chars") > 2000).alias("long"))


def q_confusion(empty):
    def run(spark, sf_dir):
        found = evaluation.confusion(judged(spark, sf_dir), F.col("attack"), F.col("loud"), empty, ["lang"])
        return found.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate", "accuracy")])

    return run


def q_disagreement(spark, sf_dir):
    return evaluation.disagreement(judged(spark, sf_dir), F.col("loud"), F.col("long"))


def q_detection_delay(spark, sf_dir):
    ev = ev_norm(spark, sf_dir)
    return evaluation.detection_delay(ev, F.col("event_type").startswith("process"), F.col("value") >= 60, "epoch_us", ["event_id"])


def q_poisoning_guard(spark, sf_dir):
    label = F.when(F.col("k") % 3 == 0, "normal").when(F.col("k") % 3 == 1, "attack")
    kept = evaluation.poisoning_guard(ev_norm(spark, sf_dir).withColumn("scenario", label), "scenario")
    return kept.groupBy("host").agg(F.count("*").alias("rows"), F.sum("k").alias("k"))


def reviews(spark, sf_dir):
    found = scored(spark, sf_dir).where("is_anomaly").select("host", "window_start", F.sha2(F.concat_ws("|", "host", "window_start"), 256).alias("alert_id"))
    day = (F.col("window_start") / DAY).cast("long") % 4
    labels = found.withColumn("label", F.when(day == 0, "benign").when(day == 1, "suspicious").when(day == 2, "confirmed_attack")).where("label is not null")
    return found, labels.select("alert_id", "label", F.lit("seen").alias("analyst_note"))


def q_review_merge(spark, sf_dir):
    return evaluation.merge_reviews(*reviews(spark, sf_dir)).select("host", "window_start", "alert_id", "label", "analyst_note")


def q_review_precision(spark, sf_dir):
    return evaluation.review_summary(evaluation.merge_reviews(*reviews(spark, sf_dir))).withColumn("alert_precision", F.round("alert_precision", 6))


def q_reviewed_baseline(spark, sf_dir):
    merged = evaluation.merge_reviews(*reviews(spark, sf_dir))
    return evaluation.reviewed_baseline(combined(spark, sf_dir), merged, ["host", "window_start"]).groupBy("host").agg(F.count("*").alias("windows"))


def q_snapshot_diff(spark, sf_dir):
    ev = ev_norm(spark, sf_dir).withColumn("half", F.col("epoch_us") < 1_705_276_800_000_000)
    state = ev.groupBy("half", "host", "process_name").agg(F.max("k").alias("version"))
    return evaluation.snapshot_diff(state.where("half"), state.where("not half"), ["host", "process_name"], "version")


def q_counter_rate(spark, sf_dir):
    rate = sessions.counter_rate(ev_norm(spark, sf_dir), ["host"], "k")
    return ev_norm(spark, sf_dir).withColumn("rate", F.round(rate, 9)).groupBy("host").agg(F.round(F.sum("rate"), 6).alias("rate"), F.count_if(F.col("rate") > 0).alias("rises"))


def q_health(spark, sf_dir):
    ev, w = ev_norm(spark, sf_dir), scored(spark, sf_dir)
    found = quality.health_report(ev, ev, w, alerts(spark, sf_dir), 600.0, now=1_800_000_000.0)
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "largest_gap", "latest_age", "ratio_p50", "ratio_p95", "ratio_max")})


def q_downsample(spark, sf_dir):
    return ordering.systematic_sample(ev_norm(spark, sf_dir), "epoch_us", ["event_id"]).select("event_id", "pos")


def q_ewma(spark, sf_dir):
    ev = ev_norm(spark, sf_dir).select("host", "epoch_us", "event_id", "value")
    return detectors.ewma_scores(ev, "host", ["value"], ["epoch_us", "event_id"])[0].select("event_id", F.round("ewma_score", 4).alias("ewma_score"))


def q_autoencoder_train(spark, sf_dir):
    """Trains on all windows, which are written once, and reports how its flags and the rules agree over all."""
    w = stored(combined(spark, sf_dir), "windows")
    features = ["value", "k", "event_process_started_count", "event_process_stopped_count", "event_total_count"]
    model = detectors.Autoencoder.fit_windows(w, features)
    out = rules.fuse(model.apply(w, 5), F.col("model_ratio"), LIMITS)
    return evaluation.disagreement(out, F.col("model_ratio") >= 1, F.size("rules") > 0)


ITEM_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, l_shipdate FROM lineitem" for f in ITEM)
RECURSIVE = EV.replace("WITH e0", "WITH RECURSIVE e0", 1)
SESSION = """
    , a0 AS (SELECT *, CASE WHEN value >= 150 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 ELSE 1 END AS rk, host || '|' || event_type AS fp
             FROM ev WHERE event_type IN ('authentication_failure', 'privilege_elevation', 'package_installed'))
"""
GROUPS = """
    , g0 AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY fp ORDER BY us, event_id) > 172800000000)::INT, 0) AS new FROM a0),
    g1 AS (SELECT *, sum(new) OVER (PARTITION BY fp ORDER BY us, event_id) AS session FROM g0),
    g AS (SELECT fp, session, min(host) AS host, count(*) AS n, min(us) AS first_us, max(us) AS last_us, max(rk) AS rk,
          list(event_id ORDER BY us, event_id)[1:20] AS ev, min(event_type) AS event_type FROM g1 GROUP BY fp, session)
"""
LEVEL = "CASE {} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


def _incidents(source: str) -> str:
    return f"""
    , i0 AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY host ORDER BY us, event_id) > 86400000000)::INT, 0) AS new FROM {source}),
    i1 AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY us, event_id) AS session FROM i0),
    i2 AS (SELECT host, session, event_type, count(*) AS n, min(us) AS f, max(us) AS l, max(rk) AS rk FROM i1 GROUP BY ALL)
    SELECT host, session::BIGINT AS session, sum(n)::BIGINT AS signal_count, min(f) AS first_us, max(l) AS last_us, {LEVEL.format('max(rk)')} AS severity,
           string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS event_types FROM i2 GROUP BY host, session"""


DOUBLED = """
    , s0 AS (SELECT *, (event_id * 7919) % 1000003 AS row_no FROM ev),
    d AS (SELECT * FROM s0 UNION ALL SELECT * REPLACE (row_no + 2000003 AS row_no) FROM s0 WHERE event_id % 10 = 0),
    c AS (SELECT event_id, row_no, us, s, k, CASE WHEN event_id % 23 = 0 THEN '' ELSE host END AS host,
        event_id % 17 = 0 AS tm, event_id % 17 <> 0 AND event_id % 19 = 0 AS ti, event_id % 41 = 0 AS secret,
        CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 29 = 0 THEN 'text' WHEN event_id % 31 = 0 THEN 'inf' WHEN event_id % 37 = 0 THEN 'neg'
             WHEN floor(value) > 100 THEN 'big' WHEN floor(value) < 0 THEN 'neg' ELSE 'ok' END AS v,
        row_number() OVER (PARTITION BY event_id ORDER BY row_no) AS nth FROM d)
"""
ISSUES = """
    , t AS (SELECT *, CASE WHEN tm OR ti THEN NULL ELSE us END AS u FROM c),
    l AS (SELECT *, u < max(u) OVER (PARTITION BY host ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM t),
    i AS (SELECT row_no, 'error' AS level, 'invalid_timestamp' AS code FROM l WHERE u IS NULL
        UNION ALL SELECT row_no, 'error', 'missing_host' FROM l WHERE host = ''
        UNION ALL SELECT row_no, 'error', 'missing_feature' FROM l WHERE v = 'missing' UNION ALL SELECT row_no, 'error', 'non_numeric_feature' FROM l WHERE v = 'text'
        UNION ALL SELECT row_no, 'error', 'non_finite_feature' FROM l WHERE v = 'inf' UNION ALL SELECT row_no, 'warning', 'negative_feature' FROM l WHERE v = 'neg'
        UNION ALL SELECT row_no, 'warning', 'negative_feature' FROM l WHERE k < 0 UNION ALL SELECT row_no, 'warning', 'percent_out_of_range' FROM l WHERE v = 'big'
        UNION ALL SELECT row_no, 'error', 'secret_exposure' FROM l WHERE secret UNION ALL SELECT row_no, 'warning', 'out_of_order' FROM l WHERE late
        UNION ALL SELECT row_no, 'warning', 'duplicate_identity' FROM l WHERE nth > 1)
"""
ROBUST = f"""
    WITH x AS ({ITEM_ROWS}), x1 AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM x),
    m AS (SELECT feature, max(value) AS med FROM x1 WHERE r = round_even((n - 1) * 0.5, 0) GROUP BY feature),
    y AS (SELECT feature, med, abs(value - med) AS d FROM x JOIN m USING (feature)),
    y1 AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM y),
    p AS (SELECT feature, max(med) AS center, greatest(1.4826 * max(d), abs(max(med)) * 0.01, 1e-6) AS scale FROM y1 WHERE r = round_even((n - 1) * 0.5, 0) GROUP BY feature)
"""
POINTS = ", ".join(f"({f} - {m}) / {s} AS z{i}" for i, (f, m, s) in enumerate(zip(ITEM, ("25.0::DOUBLE", "40000.0::DOUBLE", "0.05::DOUBLE", "0.04::DOUBLE"), ("15.0::DOUBLE", "25000.0::DOUBLE", "0.03::DOUBLE", "0.025::DOUBLE"), strict=True)))
JUDGED = """
    WITH j AS (SELECT d.lang, l.quality = 0 AS a, length(text) - length(replace(text, '!', '')) > 5 AS p, n_chars > 2000 AS long FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def _confusion(empty: str) -> str:
    r = lambda up, down: f"coalesce(round(({up}) / nullif(({down})::DOUBLE, 0), 6), {empty})"
    return JUDGED + f""", q AS (SELECT lang, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (NOT a AND NOT p) AS tn,
        count(*) FILTER (a AND NOT p) AS fn FROM j WHERE a IS NOT NULL GROUP BY lang)
    SELECT lang, tp, fp, tn, fn, {r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('2 * tp', '2 * tp + fp + fn')} AS f1,
           {r('fp', 'fp + tn')} AS false_positive_rate, {r('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM q"""


def _split(first: str, second: str) -> str:
    return EV + f""", o AS (SELECT us, row_number() OVER (ORDER BY us, host, event_id) - 1 AS pos, count(*) OVER () AS n FROM ev),
    b AS (SELECT us, CASE WHEN pos < {first} THEN 'train' WHEN pos < {second} THEN 'validation' ELSE 'test' END AS split FROM o)
    SELECT split, count(*) AS rows, min(us) AS first_us, max(us) AS last_us FROM b GROUP BY split"""


def _calibration() -> str:
    values = {"authentication_failure_burst": ("fx", 5), "package_change_burst": ("pi", 3), "process_start_burst": ("ps", 20), "privilege_elevation_burst": ("pe", 3)}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, {c} AS v, {d} AS d FROM w" for k, (c, d) in values.items())
    return EV + f""", x AS ({rows}), y AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY rule_id) AS n FROM x),
    q AS (SELECT rule_id, max(v) FILTER (r = round_even((n - 1) * 0.995, 0)) AS q, max(v) FILTER (r = round_even((n - 1) * 0.5, 0)) AS p50, max(v) FILTER (r = round_even((n - 1) * 0.95, 0)) AS p95,
        max(v) FILTER (r = round_even((n - 1) * 0.99, 0)) AS p99, max(d) AS d FROM y GROUP BY rule_id)
    SELECT rule_id, q::DOUBLE AS quantile, max(p50)::DOUBLE AS p50, max(p95)::DOUBLE AS p95, max(p99)::DOUBLE AS p99, greatest(max(q.d), max(q) + 1)::INT AS threshold, round(avg((v >= x.d)::INT), 6) AS default_exceedance,
           round(avg((v >= greatest(q.d, q + 1))::INT), 6) AS calibrated_exceedance FROM x JOIN q USING (rule_id) GROUP BY rule_id, q"""


REVIEWS = EV + RULES + """
    , al AS (SELECT host, window_start, sha256(host || '|' || window_start) AS alert_id, (window_start // 86400) % 4 AS d FROM z WHERE ratio >= 1),
    rv AS (SELECT host, window_start, alert_id, CASE d WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'confirmed_attack' ELSE 'unreviewed' END AS label FROM al)
"""
SEVERITY = "CASE WHEN {0} >= 5 THEN 'critical' WHEN {0} >= 2.5 THEN 'high' WHEN {0} >= 1 THEN 'medium' ELSE 'normal' END"

CATALOGUE = {
    "combined_windows": (q_combined_windows, EV + """
        SELECT host, window_start, n AS metric_sample_count, round(value, 6) AS value, round(k, 6) AS k, ps AS event_process_started_count, pt AS event_process_stopped_count,
               fx AS event_authentication_failure_count, pi AS event_package_installed_count, up AS event_unique_processes, 0::BIGINT AS event_unique_users,
               ur AS event_unique_remote_sources, n AS event_total_count FROM w"""),
    "combined_windows_label_mode": (q_label_mode, EV + """
        , c AS (SELECT host, s - s % 86400 AS window_start, 's' || (k % 3) AS scenario, count(*) AS n, min(event_id) AS f FROM ev GROUP BY ALL)
        SELECT host, window_start, scenario FROM c QUALIFY row_number() OVER (PARTITION BY host, window_start ORDER BY n DESC, f) = 1"""),
    "security_rules": (q_security_rules, EV + RULES + """
        SELECT host, window_start, 'authentication_failure_burst' AS rule_id, CASE WHEN sx > 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN sx > 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS ratio_floor FROM r WHERE f1
        UNION ALL SELECT host, window_start, 'package_change_burst', 'medium', 1.0 FROM r WHERE f2
        UNION ALL SELECT host, window_start, 'process_start_burst', 'high', 2.5 FROM r WHERE f3
        UNION ALL SELECT host, window_start, 'privilege_elevation_burst', 'medium', 1.0 FROM r WHERE f4"""),
    "scored_windows": (q_scored_windows, EV + RULES + f"SELECT host, window_start, rules, round(ratio, 6) AS ratio, ratio >= 1 AS is_anomaly, {SEVERITY.format('ratio')} AS severity FROM z"),
    "rule_calibration": (q_rule_calibration, _calibration()),
    "nearest_rank_quantiles": (q_quantiles, """
        WITH o AS (SELECT l_suppkey AS supplier, l_extendedprice AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
        SELECT supplier, max(n) AS n, max(p) FILTER (r = round_even((n - 1) * 0.5, 0)) AS p50, max(p) FILTER (r = round_even((n - 1) * 0.95, 0)) AS p95,
               max(p) FILTER (r = round_even((n - 1) * 0.99, 0)) AS p99 FROM o GROUP BY supplier"""),
    "global_quantiles": (q_global_quantile, """
        WITH o AS (SELECT l_extendedprice AS p, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem)
        SELECT 0.5::DOUBLE AS q, max(p) AS price FROM o WHERE r = round_even((n - 1) * 0.5, 0) UNION ALL SELECT 0.995, max(p) FROM o WHERE r = round_even((n - 1) * 0.995, 0)"""),
    "scaler_fit": (q_scaler_fit, f"SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({ITEM_ROWS}) GROUP BY feature"),
    "standardised_vectors": (q_standardised, "WITH s AS (SELECT " + ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(ITEM)) + " FROM lineitem) SELECT l_suppkey, "
        + ", ".join(f"round(sum(({f} - m{i}) / s{i}), 4) AS z_{f}" for i, f in enumerate(ITEM)) + " FROM lineitem, s GROUP BY l_suppkey"),
    "robust_fit": (q_robust_fit, ROBUST + "SELECT feature, round(center, 6) AS center, round(scale, 6) AS scale FROM p"),
    "robust_scores": (q_robust_scores, ROBUST + ", k AS (SELECT " + ", ".join(f"max(center) FILTER (feature = '{f}') AS c{i}, max(scale) FILTER (feature = '{f}') AS s{i}" for i, f in enumerate(ITEM))
        + " FROM p), v AS (SELECT l_orderkey, l_linenumber, list_reverse_sort([" + ", ".join(f"abs(({f} - c{i}) / s{i})" for i, f in enumerate(ITEM))
        + "]) AS z FROM lineitem, k) SELECT l_orderkey, l_linenumber, round((z[1] + z[2] + z[3]) / 3, 6) AS score FROM v"),
    "drift_compare": (q_drift, f"""
        WITH x AS (SELECT *, year(l_shipdate) >= 1997 AS late FROM ({ITEM_ROWS})), m AS (SELECT feature, late, median(value) AS med FROM x GROUP BY ALL),
        d AS (SELECT feature, median(abs(value - med)) AS mad FROM x JOIN m USING (feature, late) WHERE NOT late GROUP BY feature),
        j AS (SELECT feature, o.med AS a, n.med AS b, abs(n.med - o.med) / greatest(mad * 1.4826, abs(o.med) * 0.01, 1e-6) AS shift
              FROM m o JOIN m n USING (feature) JOIN d USING (feature) WHERE NOT o.late AND n.late)
        SELECT feature, round(a, 6) AS reference_median, round(b, 6) AS current_median, round(shift, 6) AS robust_shift, shift >= 4 AS drifted FROM j"""),
    "autoencoder_score_fixed": (q_autoencoder_score, f"""
        WITH z AS (SELECT l_orderkey, l_linenumber, {POINTS} FROM lineitem),
        h AS (SELECT *, tanh(0.5 * z0 - 0.25 * z1 + 0.125 * z2) AS h0, tanh(0.5 * z1 - 0.5 * z2 + 0.25 * z3) AS h1 FROM z),
        o AS (SELECT *, [(0.5 * h0 - z0) ** 2, (-0.25 * h0 + 0.5 * h1 - z1) ** 2, (0.125 * h0 - 0.5 * h1 - z2) ** 2, (0.25 * h1 - z3) ** 2] AS c FROM h),
        e AS (SELECT *, (c[1] + c[2] + c[3] + c[4]) / 4 AS error FROM o)
        SELECT l_orderkey, l_linenumber, round(error, 6) AS error, ['{ITEM[0]}', '{ITEM[1]}', '{ITEM[2]}', '{ITEM[3]}'][list_position(c, list_max(c))] AS top_feature,
               {SEVERITY.format('(error / 2)')} AS severity FROM e"""),
    "anomaly_category": (q_category, EV + """
        SELECT host, window_start, CASE WHEN greatest(ps + pt, fx + sx, pi) = 0 THEN 'generic_behavior_anomaly' WHEN ps + pt >= greatest(fx + sx, pi) THEN 'process_activity_anomaly'
            WHEN fx + sx >= pi THEN 'identity_activity_anomaly' ELSE 'software_change_anomaly' END AS category FROM w"""),
    "alert_groups": (q_alert_groups, EV + SESSION + GROUPS + f"""
        SELECT fp AS fingerprint, session::BIGINT AS session, n AS count, first_us, last_us, {LEVEL.format('rk')} AS severity, array_to_string(ev, ',') AS evidence FROM g"""),
    "incidents": (q_incidents, EV + SESSION + _incidents("a0")),
    "grouped_incidents": (q_grouped_incidents, EV + SESSION + GROUPS + ", gs AS (SELECT host, first_us AS us, ev[1] AS event_id, event_type, rk FROM g)" + _incidents("gs")),
    "coverage": (q_coverage, EV + """
        SELECT host, count(DISTINCT window_start) AS observed, (max(window_start) - min(window_start)) // 86400 + 1 AS expected,
               round(count(DISTINCT window_start) / ((max(window_start) - min(window_start)) // 86400 + 1), 6) AS coverage FROM w GROUP BY host"""),
    "gaps": (q_gaps, (GAP := EV + """
        , g AS (SELECT host, window_start AS gap_start, lead(window_start) OVER (PARTITION BY host ORDER BY window_start) AS gap_end FROM w)
        SELECT host, gap_start, gap_end, gap_end - gap_start AS gap_seconds, (gap_end - gap_start) // 86400 - 1 AS missing_windows FROM g WHERE gap_end - gap_start > 86400""")),
    "top_gaps": (q_top_gaps, GAP + " ORDER BY gap_seconds DESC, host, gap_start LIMIT 100"),
    "out_of_order_prev": (q_out_of_order_prev, EV + """
        , o AS (SELECT event_id, us, row_number() OVER (ORDER BY (event_id * 7919) % 1000003, event_id) - 1 AS pos, lag(us) OVER (ORDER BY (event_id * 7919) % 1000003, event_id) AS p FROM ev)
        SELECT event_id, pos FROM o WHERE us < p"""),
    "out_of_order_max": (q_out_of_order_max, EV + """
        , o AS (SELECT host, us < max(us) OVER (PARTITION BY host ORDER BY (event_id * 7919) % 1000003 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM ev)
        SELECT host, count(*) FILTER (late) AS late, count(*) AS events FROM o GROUP BY host"""),
    "replay_dedup": (q_replay_dedup, EV + DOUBLED + "SELECT event_id, min(row_no) AS row_no, count(*) AS copies FROM d GROUP BY event_id"),
    "timestamp_audit": (q_timestamp_audit, EV + DOUBLED + """
        SELECT host, count(*) AS rows, count(*) FILTER (tm) AS missing, count(*) FILTER (ti) AS invalid, count(*) FILTER (NOT tm AND NOT ti) AS usable,
               count(*) FILTER (nth > 1) AS duplicates, min(s) FILTER (NOT tm AND NOT ti) AS first, max(s) FILTER (NOT tm AND NOT ti) AS last FROM c GROUP BY host"""),
    "feature_audit": (q_feature_audit, EV + DOUBLED + """
        SELECT 'value' AS feature, count(*) FILTER (v = 'missing') AS missing, count(*) FILTER (v = 'text') AS non_numeric, count(*) FILTER (v = 'inf') AS non_finite FROM c
        UNION ALL SELECT 'k', 0, 0, 0"""),
    "record_issues": (q_record_issues, EV + DOUBLED + ISSUES + "SELECT level, code, count(*) AS n, array_to_string(list(row_no ORDER BY row_no)[1:5], ',') AS examples FROM i GROUP BY level, code"),
    "quality_score": (q_quality_score, EV + DOUBLED + ISSUES + """
        , q AS (SELECT (SELECT count(*) FROM c) AS rows, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM i)
        SELECT rows, errors, warnings, round(100 * (1 - least(1, 5 * errors / rows + 0.25 * warnings / rows)), 6)::DOUBLE AS quality FROM q"""),
    "noisy_rules": (q_noisy_rules, EV + RULES + """
        , u AS (SELECT unnest(string_split(rules, ',')) AS rule_id FROM z WHERE rules <> ''), n AS (SELECT count(*) AS n FROM z)
        SELECT rule_id, count(*) AS windows, round(count(*) / max(n), 6) AS ratio, count(*) / max(n) > 0.05 AS noisy FROM u, n GROUP BY rule_id"""),
    "readiness": (q_readiness, EV + RULES + """
        , u AS (SELECT unnest(string_split(rules, ',')) AS rule_id FROM z WHERE rules <> ''),
        ny AS (SELECT rule_id FROM u GROUP BY rule_id HAVING count(*) > 0.05 * (SELECT count(*) FROM z)),
        c AS (SELECT host, count(*) AS windows, sum(CASE WHEN rules = '' THEN 0 ELSE len(string_split(rules, ',')) END)::BIGINT AS hits,
              count(*) FILTER (rules = '' OR list_has_all(coalesce(names, []), string_split(rules, ','))) AS clean FROM z, (SELECT list(rule_id) AS names FROM ny) GROUP BY host)
        SELECT host, windows, hits, clean, CASE WHEN clean < 5 THEN 'insufficient' WHEN clean < 20 THEN 'preliminary' WHEN windows > clean THEN 'ready_with_warnings' ELSE 'ready' END AS state FROM c"""),
    "chrono_split_a": (q_split("sizes"), _split("n - 2 * greatest(1, (n * 0.15)::DOUBLE // 1)", "n - greatest(1, (n * 0.15)::DOUBLE // 1)")),
    "chrono_split_b": (q_split("cuts"), _split("(n * 0.70)::DOUBLE // 1", "(n * 0.85)::DOUBLE // 1")),
    "confusion_metrics_zero": (q_confusion(0.0), _confusion("0")),
    "confusion_metrics_null": (q_confusion(None), _confusion("NULL")),
    "disagreement": (q_disagreement, JUDGED + "SELECT p AS model_flag, long AS rule_flag, count(*) AS windows FROM j GROUP BY ALL"),
    "detection_delay": (q_detection_delay, EV + """
        , o AS (SELECT event_type LIKE 'process%' AS a, value >= 60 AS hit, row_number() OVER (ORDER BY us, event_id) - 1 AS n FROM ev),
        g AS (SELECT *, n - row_number() OVER (ORDER BY n) AS run FROM o WHERE a)
        SELECT min(n) AS first, count(*) AS rows, min(n) FILTER (hit) - min(n) AS delay FROM g GROUP BY run"""),
    "poisoning_guard": (q_poisoning_guard, EV + "SELECT host, count(*) AS rows, sum(k)::BIGINT AS k FROM ev WHERE k % 3 = 0 GROUP BY host"),
    "review_merge": (q_review_merge, REVIEWS + "SELECT *, CASE WHEN label = 'unreviewed' THEN '' ELSE 'seen' END AS analyst_note FROM rv"),
    "review_precision": (q_review_precision, REVIEWS + """
        SELECT count(*) AS alerts, count(*) FILTER (label <> 'unreviewed') AS reviewed, count(*) FILTER (label = 'benign') AS benign, count(*) FILTER (label = 'suspicious') AS suspicious,
               count(*) FILTER (label = 'confirmed_attack') AS confirmed_attack,
               round(count(*) FILTER (label IN ('suspicious', 'confirmed_attack')) / count(*) FILTER (label <> 'unreviewed'), 6) AS alert_precision FROM rv"""),
    "reviewed_baseline": (q_reviewed_baseline, REVIEWS + """
        SELECT host, count(*) AS windows FROM w WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.host = w.host AND rv.window_start = w.window_start AND label IN ('suspicious', 'confirmed_attack')) GROUP BY host"""),
    "snapshot_diff": (q_snapshot_diff, EV + """
        , st AS (SELECT us < 1705276800000000 AS half, host, process_name, max(k) AS v FROM ev GROUP BY ALL),
        j AS (SELECT host, process_name, o.v AS old_version, n.v AS new_version FROM (SELECT * FROM st WHERE half) o FULL JOIN (SELECT * FROM st WHERE NOT half) n USING (host, process_name))
        SELECT *, CASE WHEN old_version IS NULL THEN 'added' WHEN new_version IS NULL THEN 'removed' ELSE 'updated' END AS change FROM j WHERE old_version IS DISTINCT FROM new_version"""),
    "counter_rate": (q_counter_rate, EV + """
        , o AS (SELECT host, round(coalesce(greatest((k - lag(k) OVER h) / nullif((us - lag(us) OVER h) / 1e6, 0), 0), 0), 9) AS rate FROM ev WINDOW h AS (PARTITION BY host ORDER BY us, event_id))
        SELECT host, round(sum(rate), 6) AS rate, count(*) FILTER (rate > 0) AS rises FROM o GROUP BY host"""),
    "health_report": (q_health, EV + RULES + f"""
        , o AS (SELECT us, (us - lag(us) OVER (ORDER BY us)) / 1e6 AS gap FROM ev),
        m AS (SELECT count(*) AS records, count(*) FILTER (gap > 900) AS gap_count, round(coalesce(max(gap), 0), 6) AS largest_gap, least(1, count(*) / (floor((max(us) - min(us)) / 1e6 / 600) + 1)) AS cov,
              round(greatest(0, 1800000000 - max(us) / 1e6), 6) AS latest_age FROM o),
        q AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS r, count(*) OVER () AS n FROM z),
        x AS (SELECT count(*) AS windows, count(*) FILTER (ratio >= 1) AS anomalies, round(max(ratio), 6) AS ratio_max, round(max(ratio) FILTER (r = round_even((n - 1) * 0.5, 0)), 6) AS ratio_p50,
              round(max(ratio) FILTER (r = round_even((n - 1) * 0.95, 0)), 6) AS ratio_p95 FROM q),
        u AS (SELECT unnest(string_split(rules, ',')) AS k FROM z WHERE rules <> ''),
        t AS (SELECT coalesce(string_agg(k || ':' || c, ',' ORDER BY k), '') AS rule_triggers FROM (SELECT k, count(*) AS c FROM u GROUP BY k)),
        l AS (SELECT string_agg(lev || ':' || c, ',' ORDER BY lev) AS severities FROM (SELECT CASE WHEN value >= 150 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS lev, count(*) AS c
              FROM ev WHERE event_type IN ('authentication_failure', 'privilege_elevation', 'package_installed') GROUP BY lev))
        SELECT records, round(cov, 6) AS coverage, gap_count, largest_gap, latest_age, records AS events, 0::BIGINT AS collector_errors, 0::BIGINT AS heartbeats, windows, anomalies, ratio_p50, ratio_p95, ratio_max,
            rule_triggers, severities, concat_ws('; ', CASE WHEN latest_age > 180 THEN 'latest metric is stale' END, CASE WHEN cov < 0.98 AND records > 2 THEN 'metric coverage is below 98 percent' END) AS reasons,
            CASE WHEN latest_age > 180 OR cov < 0.98 AND records > 2 THEN 'degraded' ELSE 'healthy' END AS state FROM m, x, t, l"""),
    "downsample": (q_downsample, EV + """
        , o AS (SELECT event_id, row_number() OVER (ORDER BY us, event_id) - 1 AS pos, count(*) OVER () AS n FROM ev), t AS (SELECT * FROM o WHERE pos % greatest(1, n // 480) = 0 OR pos = n - 1)
        SELECT event_id, pos FROM t QUALIFY row_number() OVER (ORDER BY pos DESC) <= 480"""),
    "ewma_scores": (q_ewma, RECURSIVE + """
        , o AS (SELECT event_id, host, value AS x, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS n FROM ev),
        r AS (SELECT event_id, host, n, 0::DOUBLE AS score, x AS mean, 1e-6::DOUBLE AS var FROM o WHERE n = 1
            UNION ALL SELECT o.event_id, o.host, o.n, abs(o.x - mean) / greatest(sqrt(var), 0.01 * abs(mean), 1e-6), mean + 0.05 * (o.x - mean),
                greatest(0.95 * (var + 0.05 * (o.x - mean) * (o.x - mean)), 1e-6) FROM r JOIN o ON o.host = r.host AND o.n = r.n + 1)
        SELECT event_id, round(score, 4) AS ewma_score FROM r"""),
    "autoencoder_train_eval": (q_autoencoder_train, None),
}
