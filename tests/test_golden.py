"""Golden values of adapters, envelopes, graphs, smoothing, reviews and list parsers."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.functions import ocsf
from behaviorlens.operators import detectors, evaluation, graph, ordering, review
from behaviorlens.sources import adapters, files

SALT = "s"


def hidden(value):
    return hashlib.sha256(f"{SALT}\x1f{value}".encode()).hexdigest()[:16]


def iso(df):
    return [r[0] for r in df.select(fn.iso_z(F.col("epoch_us"))).collect()]


def test_optc(spark):
    rows = spark.createDataFrame(
        [(0, 1_539_120_748_904, "h", "PROCESS", "OPEN", "a", "b", ("C:\\x\\cmd.exe",), 5), (1, None, None, "USER_SESSION", "fly", None, None, (None,), -1)],
        "row_no long, timestamp long, hostname string, object string, action string, actorID string, objectID string, properties struct<image_path: string>, pid int",
    )
    found = adapters.optc(rows, SALT)
    a, b = found.collect()
    assert iso(found) == ["2018-10-09T21:32:28.904000Z", "1970-01-01T00:00:01Z"]
    assert (a["event_type"], a["path_category"], a["actor_id"], a["host"], a["pid_present"]) == ("process_started", "executable", hidden("a"), hidden("h"), True)
    assert (b["event_type"], b["path_category"], b["actor_id"], b["host"], b["pid_present"], b["native_action"], b["object_kind"]) == ("endpoint_activity", "other", None, hidden("unknown"), False, "unknown", "User_Session")
    key = uuid.uuid5(uuid.NAMESPACE_URL, "\x1f".join(["optc", "0", "2018-10-09T21:32:28.904000Z", hidden("h"), "process_started"]))
    assert a["event_id"] == str(key)


def test_lanl_unsw_loghub(spark):
    r = adapters.lanl(spark.createDataFrame([(3, "1500000000", "4625", None, "bob", "cmd.exe")], "row_no long, Time string, EventID string, Computer string, UserName string, ProcessName string"), SALT).first()
    assert (r["event_type"], r["status"], r["host"], r["user_name"], r["process_name"], r["parent_name"]) == ("authentication_failure", "failure", hidden("unknown"), hidden("bob"), "cmd.exe", "unknown")
    rows = spark.createDataFrame([(0, 1.5, "a", "0", "DoS"), (1, 1.0, None, "0", None), (2, 1.0, "a", None, ""), (3, 1.0, "a", "1", "")], "row_no long, stime double, srcip string, label string, attack_cat string")
    found = adapters.unsw(rows, SALT).orderBy("row_no").collect()
    assert [x["status"] for x in found] == ["failure", "success", "success", "failure"] and found[1]["host"] == hidden("unknown") and found[0]["epoch_us"] == 1_500_000
    r = adapters.loghub(spark.createDataFrame([(7, "not a time", "password=x")], "row_no long, Time string, Content string"), SALT).first()
    assert (r["event_type"], r["host"], r["message"], r["epoch_us"]) == ("application_log", hidden("log-source"), "password=[REDACTED]", 7_000_000)


def test_cdm_records(spark):
    lines = [
        {"datum": {"com.x.cdm18.Subject": {"uuid": {"com.x.UUID": "s1"}, "hostId": {"com.x.UUID": "h1"}}}}, {"datum": {"x.FileObject": {"uuid": "f1"}}}, {"datum": {"x.MemoryObject": {"uuid": "m1"}}},
        {"datum": {"x.Event": {"type": "EVENT_WRITE", "timestampNanos": 1_700_000_000_000_000_000, "subject": {"u": "s1"}, "predicateObject": {"u": "f1"}}}},
        {"datum": {"x.Event": {"type": "EVENT_CREATE_THREAD", "timestampNanos": "bad", "subject": None, "predicateObject": "m1"}}},
    ]
    records = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(9, "no json")], "row_no long, value string")
    found = adapters.cdm(*adapters.cdm_records(records), SALT).orderBy("row_no")
    a, b = found.collect()
    assert iso(found) == ["2023-11-14T22:13:20Z", "1970-01-01T00:00:04Z"]
    assert (a["event_type"], a["host"], a["actor_defined"], a["object_kind"], a["activity_name"]) == ("file_activity", hidden("h1"), True, "FileObject", "Write")
    assert (b["event_type"], b["host"], b["actor_id"], b["actor_kind"], b["object_kind"], b["native_action"]) == ("endpoint_activity", hidden("dataset-host"), hidden("unknown"), "Subject", "Unknown", "EVENT_UNKNOWN")


def test_envelopes(spark):
    rows = spark.createDataFrame([("Process Activity", "LAUNCH", "high", "success"), ("Security Finding", "Observe", "odd", "x"), ("Nowhere", "", "low", "failure")], "c string, a string, s string, t string")
    e = rows.select(ocsf.envelope(F.col("c"), F.col("a"), F.col("s"), F.col("t"), F.lit(1000).cast("long"), F.lit("id"), "p").alias("e")).select("e.*").collect()
    assert [(x["category_uid"], x["class_uid"], x["activity_id"], x["type_uid"], x["activity_name"], x["status"]) for x in e] == [
        (1, 1007, 1, 100701, "Launch", "Success"), (2, 2004, 1, 200401, "Create", "New"), (0, 0, 99, 99, "Other", "Failure")]
    bad = rows.limit(1).select(ocsf.envelope(F.col("c"), F.col("a"), F.col("s"), F.col("t"), F.lit(0).cast("long"), F.lit(" "), "p").alias("e"))
    assert bad.select(ocsf.core_issues(F.col("e"), F.array().cast("array<string>"))).first()[0] == [
        "time must be a positive UTC epoch millisecond value", "metadata.uid is required", "process is required for class_uid 1007"]


GRAPH = "event_id string, source string, event_type string, native_action string, host string, epoch_us long, actor_id string, actor_defined boolean, object_id string, object_defined boolean, object_kind string, principal string, row_no long"


def test_graph(spark):
    optc = lambda i, t, kind, a, actor, obj, row, us: (f"e{i}", "dataset.optc", t, a, "h", us, actor, None, obj, None, kind, None, row)
    rows = [optc(1, "process_started", "Process", "CREATE", "a", "b", 0, 30), optc(2, "file_activity", "File", "WRITE", None, "f", 1, 20), optc(3, "network_activity", "Flow", "RECVFROM", "a", "n", 2, 10), optc(1, "process_started", "Process", "CREATE", "a", "b", 3, 30)]
    tc = lambda i, t, a, kind, known: (f"t{i}", graph.CDM, t, a, "h", 50, "a", known, "f", True, kind, None, 10 + i)
    rows += [tc(1, "process_started", "EVENT_EXECUTE", "FileObject", True), tc(2, "file_activity", "EVENT_WRITE", "FileObject", True), tc(3, "network_activity", "EVENT_RECVMSG", "NetFlowObject", True), tc(4, "file_activity", "EVENT_WRITE", "FileObject", False)]
    events = spark.createDataFrame(rows, GRAPH)
    nodes, edges, stats = graph.build_graph(events, b"k" * 32)
    got = {r["event_id"]: r for r in edges.collect()}
    assert {k: v["relation"] for k, v in got.items()} == {"e1": "spawned", "e2": "wrote", "e3": "connected", "t1": "executed", "t2": "wrote", "t3": "accepted"}
    assert got["e2"]["missing"] == ["actor.id"] and got["e1"]["duplicate"] and got["e1"]["confidence"] == 1.0 and got["e3"]["confidence"] == 0.5
    s = stats.first()
    assert (s["input"], s["duplicates"], s["unsupported"], s["unresolved"], s["reordered"], s["missing_identity"]) == (8, 1, 1, 1, 2, 1)
    assert graph.dangling_edges(nodes, edges).count() == 0 and got["t2"]["target"] == got["e2"]["target"]
    assert graph.conflicting_events(events).count() == 0
    assert graph.conflicting_events(events.withColumn("epoch_us", F.col("epoch_us") + F.col("row_no"))).first()[0] == "e1"
    with pytest.raises(ValueError):
        graph.admitted(events.withColumns({"class_uid": F.lit(1007), "activity_id": F.lit(1), "type_uid": F.lit(100701)}))
    with pytest.raises(ValueError):
        graph.admitted(events, 3)


def test_smoothing_scale_and_fingerprint(spark):
    df = spark.createDataFrame([("h", 1, 1000.0), ("h", 2, 1005.0)], "host string, t long, v double")
    assert [r["ewma_score"] for r in detectors.ewma_scores(df, "host", ["v"], ["t"])[0].orderBy("t").collect()] == [0.0, 0.5]
    names = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    row = df.limit(1).select(fn.fingerprint(F.col("host"), names("b", "a"), names(), F.lit("t")), fn.fingerprint(F.lit(None).cast("string"), names(), names("z", "y", "x", "a"), F.lit("t"))).first()
    assert tuple(row) == ("h|a|b", "unknown|x|y|z")


def test_reviews(spark):
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z", "hé", "c", "high", 1.5, None, ["b", "a"], ["x"]), (None, None, None, None, None, None, [], [])], "event_timestamp string, host string, category string, severity string, ratio double, model_ratio double, rules array<string>, features array<string>")
    found = review.review_rows(rows).collect()
    want = []
    for t, h, c, r, f in (("2026-01-01T00:00:00Z", "hé", "c", ["a", "b"], ["x"]), (None, None, None, [], [])):
        text = json.dumps({"timestamp": t, "host": h, "category": c, "rules": r, "features": f}, sort_keys=True, separators=(",", ":"))
        want.append("hwa-" + hashlib.sha256(text.encode()).hexdigest()[:16])
    assert [r["alert_id"] for r in found] == want and found[0]["rules"] == "b;a" and found[0]["model_ratio"] == "1.500000" and found[1]["severity"] == "unknown"
    with pytest.raises(ValueError):
        review.checked_reviews(spark.createDataFrame([("a", "benign"), ("a", "benign")], "alert_id string, label string"))
    assert review.checked_reviews(spark.createDataFrame([("a", "benign")], "alert_id string, label string")).count() == 1


def test_lists(spark):
    lines = lambda *x: spark.createDataFrame([(v, i) for i, v in enumerate(x)], "value string, line_no long")
    netstat = lines("Proto Local", "tcp4 0 0 1.1.1.1.5 2.2.2.2.443 ESTABLISHED", "TCP 1.1.1.1:5 0.0.0.0:0 LISTENING", "tcp 1.1.1.1:6 3.3.3.3:80 SYN-SENT", "udp x y ESTABLISHED")
    assert tuple(files.netstat_summary(netstat).first()) == (1, 1, 1, 0, 2)
    assert tuple(files.process_summary(lines("USER PID T", "root 1 5", "alice 2 8", "alice 3 x", "short"), "ali").first()) == (3, 2, 13)
    assert [(r["name"], r["version"]) for r in files.listed_packages(lines("git 2.1 2.0", "", "jq"), "homebrew").collect()] == [("git", "2.1,2.0"), ("jq", "unknown")]
    assert [(r["name"], r["version"], r["manager"]) for r in files.json_packages(lines('[{"Name": "a", "Version": "1"}, {"Name": ""}]', '{"Name": "b", "ProviderName": "msi"}', " ")).collect()] == [("a", "1", "powershell"), ("b", "unknown", "msi")]


def test_runs_ignore_hosts_and_cross_tasks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RUN_ROWS", 3)
    kinds = "nnaaaaaanana"  # rows of two hosts in turn
    df = spark.createDataFrame([(i, f"h{i % 2}", k == "a", i == 6) for i, k in enumerate(kinds)], "t long, host string, a boolean, hit boolean")
    got = sorted((r["first"], r["rows"], r["delay"]) for r in evaluation.detection_delay(df, F.col("a"), F.col("hit"), "t", []).collect())
    assert got == [(2, 6, 4), (9, 1, None), (11, 1, None)]


def test_order_statistics_narrow_until_exact(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COUNTED", 10)
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).cast("double").alias("v"), F.lit(3.0).alias("c"))
    values = sorted(r["v"] for r in df.collect())
    found = ordering.order_statistics(df, {"v": F.col("v"), "c": F.col("c"), "n": F.lit(None).cast("double")}, lambda n: [0, n // 3, n - 1])
    assert found == {"v": [values[0], values[5000 // 3], values[-1]], "c": [3.0] * 3, "n": []}
