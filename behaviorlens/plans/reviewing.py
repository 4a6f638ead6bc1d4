"""Review, summary, list parsing, graph admission and stream scoring queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.operators import graph, review
from behaviorlens.plans.behaviour import DAY, EV, LIMITS, RULES, ev_norm, scored
from behaviorlens.plans.records import SALT, pick, streamed
from behaviorlens.sources import files
from behaviorlens.streaming import windows as streaming

NETSTAT = ("ESTABLISHED", "LISTENING", "SYN-SENT", "CLOSE_WAIT", "TIME_WAIT")
CATEGORIES = ("network_anomaly", "process_activity_anomaly", "é anomaly")


def flagged(spark, sf_dir):
    w = scored(spark, sf_dir).where("is_anomaly")
    return w.select(
        fn.iso_z(F.col("window_start") * 1_000_000).alias("event_timestamp"), "host", pick(CATEGORIES, (F.col("window_start") / DAY).cast("long")).alias("category"), "severity", "ratio", "model_ratio",
        F.col("rules.rule_id").alias("rules"), F.array(F.lit("value"), F.lit("k")).alias("features"), "window_start",
    )


def q_review_rows(spark, sf_dir):
    return review.review_rows(flagged(spark, sf_dir))


def q_review_faults(spark, sf_dir):
    rows = review.review_rows(flagged(spark, sf_dir).where("host != 'u1'"))
    tail = F.substring("alert_id", 5, 1)
    odd = rows.select(F.when(tail == "0", " ").otherwise(F.col("alert_id")).alias("alert_id"), F.when(tail == "1", "odd").otherwise("benign").alias("label"), tail.alias("t"))
    return review.review_faults(odd.unionByName(odd.where("t = '2'")))


def q_category_summary(spark, sf_dir):
    return review.category_summary(flagged(spark, sf_dir), "event_timestamp")


def q_demo_metrics(spark, sf_dir):
    day = (F.col("window_start") / DAY).cast("long") % 4
    scenario = F.when(day == 0, "port_scan").when(day == 1, "bulk_file").otherwise("normal")
    found = review.demo_metrics(scored(spark, sf_dir).withColumn("scenario", scenario))
    return found.withColumns({c: F.round(c, 6) for c in ("recall", "false_positive_rate")})


def q_netstat(spark, sf_dir):
    line = F.concat(F.lit(" TCP4 0 0 10.0.0.1.50 10.0.0.2."), F.col("k"), F.lit(" "), pick(NETSTAT, F.col("event_id")))
    return files.netstat_summary(ev_norm(spark, sf_dir).select(line.alias("value")))


def q_processes(spark, sf_dir):
    threads = F.when(F.col("event_id") % 5 == 0, "many").otherwise(F.col("k").cast("string"))
    lines = ev_norm(spark, sf_dir).select(F.concat_ws("  ", "host", "event_id", threads).alias("value"), F.col("event_id").alias("line_no"))
    return files.process_summary(lines, "u1")


def q_brew(spark, sf_dir):
    lines = ev_norm(spark, sf_dir).select(F.concat(F.lit("pkg"), F.col("event_id"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("  1."), F.col("k"))).otherwise(""), F.when(F.col("k") % 3 == 2, " 2.0 ").otherwise("")).alias("value"))
    return files.listed_packages(lines, "homebrew")


def q_json_packages(spark, sf_dir):
    one = F.to_json(F.struct(F.when(F.col("k") % 4 > 0, F.concat(F.lit("n"), F.col("event_id"))).alias("Name"), F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("Version")))
    return files.json_packages(ev_norm(spark, sf_dir).select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))).otherwise(one).alias("value")))


def q_admission(spark, sf_dir):
    i = F.col("event_id")
    rows = ev_norm(spark, sf_dir).select(
        F.when(i % 17 == 0, "x").otherwise(fn.uuid5(F.lit("g"), i.cast("string"))).alias("event_id"), F.when(i % 19 == 0, F.col("host")).otherwise(fn.pseudonym(SALT, F.col("host"))).alias("host"),
        F.when(i % 23 == 0, "dataset.lanl").otherwise("dataset.optc").alias("source"), F.when(i % 29 > 0, F.col("epoch_us")).alias("epoch_us"), F.lit("process_started").alias("event_type"),
        F.when(i % 31 == 0, 1001).otherwise(1007).alias("class_uid"), F.lit(1).alias("activity_id"), F.when(i % 37 == 0, 5).when(i % 31 == 0, 100101).otherwise(100701).alias("type_uid"),
    )
    return graph.admission_faults(rows).groupBy("fault").agg(F.count("*").alias("n"))


def q_stream_scores(spark, sf_dir):
    found = streamed(spark, lambda rows: streaming.stream_scores(rows, rows, "value", 100.0, DAY, LIMITS), sf_dir, ["host", "window_start", "metric_sample_count", "model_ratio", "ratio", "rules", "is_anomaly", "severity"])
    return found.select("host", "window_start", "metric_sample_count", F.round("ratio", 6).alias("ratio"), F.array_join("rules.rule_id", ",").alias("rules"), "is_anomaly", "severity")


_FLAGGED = EV + RULES + """
    , fl AS (SELECT *, strftime(make_timestamp(window_start * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS event_timestamp, ['network_anomaly', 'process_activity_anomaly', 'é anomaly'][(window_start // 86400) % 3 + 1] AS category,
        CASE WHEN ratio >= 5 THEN 'critical' WHEN ratio >= 2.5 THEN 'high' ELSE 'medium' END AS severity FROM z WHERE ratio >= 1),
    al AS (SELECT *, 'hwa-' || substr(sha256('{"category":"' || replace(category, 'é', chr(92) || 'u00e9') || '","features":["value","k"],"host":"' || host || '","rules":['
        || CASE WHEN rules = '' THEN '' ELSE '"' || array_to_string(list_sort(string_split(rules, ',')), '","') || '"' END || '],"timestamp":"' || event_timestamp || '"}'), 1, 16) AS alert_id FROM fl)
"""

CATALOGUE = {
    "review_rows": (q_review_rows, _FLAGGED + """
        SELECT alert_id, event_timestamp, severity, category, printf('%.6f', ratio) AS ratio, printf('%.6f', model_ratio) AS model_ratio, replace(rules, ',', ';') AS rules, 'value;k' AS top_features,
            'unreviewed' AS label, '' AS analyst_note FROM al"""),
    "review_faults": (q_review_faults, _FLAGGED + """
        , t AS (SELECT alert_id, substr(alert_id, 5, 1) AS t FROM al WHERE host <> 'u1')
        SELECT CASE WHEN t = '0' THEN '' ELSE alert_id END AS alert_id, CASE t WHEN '0' THEN 'missing alert_id' WHEN '1' THEN 'unsupported label' ELSE 'duplicate alert_id' END AS fault FROM t WHERE t IN ('0', '1', '2')"""),
    "category_summary": (q_category_summary, _FLAGGED + "SELECT category, count(*) AS alerts FROM al GROUP BY category"),
    "demo_metrics": (q_demo_metrics, EV + RULES + """
        , y AS (SELECT CASE (window_start // 86400) % 4 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'bulk_file' ELSE 'normal' END AS s, ratio >= 1 AS hit FROM z),
        x AS (SELECT count(*) AS n, count(*) FILTER (s = 'normal') AS normal, count(*) FILTER (s <> 'normal' AND hit) AS tp, count(*) FILTER (s = 'normal' AND hit) AS fp FROM y)
        SELECT n AS samples, normal AS normal_samples, n - normal AS injected_anomalies, tp AS true_positives, fp AS false_positives, n - normal - tp AS false_negatives, round(coalesce(tp / nullif(n - normal, 0), 0), 6) AS recall,
            round(coalesce(fp / nullif(normal, 0), 0), 6) AS false_positive_rate, (SELECT string_agg(s || ':' || c, ',' ORDER BY s) FROM (SELECT s, count(*) AS c FROM y WHERE hit GROUP BY s)) AS detected_by_scenario FROM x"""),
    "netstat_summary": (q_netstat, EV + """
        SELECT count(*) FILTER (event_id % 5 = 0) AS tcp_established, count(*) FILTER (event_id % 5 = 1) AS tcp_listen, count(*) FILTER (event_id % 5 = 2) AS tcp_syn_sent,
            count(*) FILTER (event_id % 5 = 3) AS tcp_close_wait, count(DISTINCT k) FILTER (event_id % 5 < 4 AND k <> 0) AS unique_remote_ports FROM ev"""),
    "process_summary": (q_processes, EV + """
        SELECT count(*) AS process_count, count(*) FILTER (contains(host, 'u1')) AS user_process_count, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE greatest(k, 0) END)::BIGINT AS thread_count FROM ev WHERE event_id > 0"""),
    "brew_packages": (q_brew, EV + """
        SELECT 'homebrew' AS manager, 'pkg' || event_id AS name, CASE k % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '1.' || k ELSE '1.' || k || ',2.0' END AS version, 'unknown' AS architecture FROM ev"""),
    "json_packages": (q_json_packages, EV + """
        SELECT 'powershell' AS manager, 'n' || event_id AS name, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'unknown' END AS version, 'unknown' AS architecture
        FROM ev, LATERAL (SELECT unnest(range(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END)) AS copy) WHERE k % 4 > 0"""),
    "graph_admission": (q_admission, EV + """
        , f AS (SELECT unnest([CASE WHEN event_id % 17 = 0 THEN 'event_id must be a UUID' END, CASE WHEN event_id % 19 = 0 THEN 'host must be a pseudonymous token' END, CASE WHEN event_id % 23 = 0 THEN 'unsupported normalized source' END,
            CASE WHEN event_id % 29 = 0 THEN 'event time is missing' END, CASE WHEN event_id % 37 = 0 THEN 'class and activity identifiers are invalid' END, CASE WHEN event_id % 31 = 0 THEN 'event type disagrees with its class' END]) AS fault FROM ev)
        SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault"""),
    "stream_scores": (q_stream_scores, EV + RULES + """
        SELECT host, window_start, n AS metric_sample_count, round(ratio, 6) AS ratio, rules, ratio >= 1 AS is_anomaly, CASE WHEN ratio >= 5 THEN 'critical' WHEN ratio >= 2.5 THEN 'high' WHEN ratio >= 1 THEN 'medium' ELSE 'normal' END AS severity
        FROM z WHERE (window_start + 86400) * 1000 <= (SELECT max(us) // 1000 - 60000 FROM ev)"""),
}
