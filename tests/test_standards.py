"""Class objects of envelopes, typed checks of foreign ones, audits of odd lines, and replays that stop and go on."""

import json

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import envelopes
from behaviorlens.streaming import replay

BASE = {"event_id": "e", "timestamp": "2024-01-01T00:00:00.123Z", "host": "h"}


def built(spark, *rows):
    df = spark.createDataFrame([(i, json.dumps(BASE | fields)) for i, fields in enumerate(rows)], "i int, value string").select("i", F.parse_json("value").alias("record"))
    return [json.loads(r[1]) for r in sorted(envelopes.upgrade(df, "record", "p", F.lit(7)).select("i", F.to_json("envelope")).collect())]


CASES = [
    ({"class_name": "Process Activity", "data": {"process": {"pid": 0, "command_line": "run"}}}, {"process": {"name": "unknown", "pid": 0, "cmd_line": "run"}}),
    ({"class_name": "Process Activity", "source": "dataset.tc_cdm", "data": {"subject": {"id": "s"}, "object": {"id": "o", "kind": "FileObject"}}},
     {"actor": {"process": {"uid": "s"}}, "device": {"hostname": "h", "type_id": 0}, "process": {"uid": "s", "name": "unknown"}}),
    ({"class_name": "Process Activity", "source": "dataset.tc_cdm", "data": {"subject": {"id": "s"}, "object": {"id": "o", "kind": "Subject"}}},
     {"actor": {"process": {"uid": "s"}}, "device": {"hostname": "h", "type_id": 0}, "process": {"uid": "o", "name": "unknown"}}),
    ({"class_name": "File System Activity", "source": "dataset.optc", "data": {"path_category": "document"}},
     {"actor": {"process": {"uid": "e"}}, "device": {"hostname": "h", "type_id": 0}, "file": {"name": "unknown", "type_id": 1}}),
    ({"class_name": "File System Activity", "data": {"file": "no object", "path": "/p"}}, {"file": {"path": "/p"}}),
    ({"class_name": "Authentication", "data": {"user": {"uid": 5, "groups": ["a"]}, "destination_endpoint": "text", "dst_endpoint": {"ip": "1"}}}, {"user": {"uid": 5, "groups": ["a"]}, "dst_endpoint": {"hostname": "h"}}),
    ({"class_name": "Network Activity", "data": {"source_endpoint": {"ip": "1", "port": "x"}, "dst_endpoint": {"ip_hash": "z", "port": " 80 "}}}, {"src_endpoint": {"ip": "1"}, "dst_endpoint": {"hostname": "z", "port": 80}}),
    ({"class_name": "Network Activity", "data": None}, {"src_endpoint": {"hostname": "h"}}),
    ({"class_name": "Device Config State"}, {"device": {"hostname": "h"}}),
    ({"class_name": "Software Inventory Info", "data": {"name": "n", "version": ""}}, {"device": {"hostname": "h"}, "package": {"name": "n"}}),
    ({"class_name": "Security Finding"}, {"finding_info": {"uid": "e", "title": "Finding", "created_time": 1704067200123}, "is_alert": True}),
    ({"class_name": "Elsewhere", "data": {"process": {}}}, {}),
]


def test_class_objects(spark):
    found = built(spark, *[fields for fields, _ in CASES])
    assert [{k: v for k, v in e.items() if k in (*envelopes.OBJECTS, "actor", "is_alert")} for e in found] == [want for _, want in CASES]


def test_times_and_records_that_are_not_touched(spark):
    day, soon, none, own = built(spark, {"timestamp": "2024-01-01"}, {"timestamp": "soon"}, {"timestamp": None}, {"ocsf": {"x": [1]}})
    assert (day["time"], soon["time"], none["metadata"]["logged_time"], own) == (1704067200000, 7, 7, {"x": [1]})
    with pytest.raises(ValueError):
        envelopes.upgrade(spark.sql("select parse_json('{}') as record, 1 as _own"), "record", "p")


def test_issues_of_foreign_envelopes(spark):
    (good,) = built(spark, {"class_name": "Authentication", "activity_name": "logon"})
    meta = good["metadata"]
    cases = [
        ({}, []), ({"severity_id": "3"}, ["severity_id must be an integer"]), ({"user": [1]}, ["user is required for class_uid 3002"]), ({"metadata": 3}, ["metadata must be an object"]),
        ({"metadata": meta | {"logged_time": 1, "uid": 0}}, ["metadata.uid is required", "metadata.logged_time must equal time"]),
        ({"time": "soon"}, ["time must be an integer", "metadata.logged_time must equal time"]), ({"time": "soon", "metadata": meta | {"logged_time": "soon"}}, ["time must be an integer"]),
    ]
    lines = spark.createDataFrame([(json.dumps({"ocsf": good | change}),) for change, _ in cases], "value string").coalesce(1)
    assert [r["issues"] for r in envelopes.judged_lines(lines, "p").collect()] == [want for _, want in cases]


def test_audit_of_odd_lines(spark):
    lines = ["", " \t", "{", "7", "null", json.dumps(BASE | {"class_name": "Device Config State"})]
    found = {(r["kind"], r["name"]): r["n"] for r in envelopes.audit_lines(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string"), "p").collect()}
    assert found == {
        ("total", "records"): 1, ("total", "native_envelopes"): 0, ("total", "legacy_records_migrated"): 1, ("total", "invalid_records"): 3, ("total", "valid"): 0,
        ("class", "Device Inventory Info"): 1, ("issue", "malformed JSON"): 1, ("issue", "record is not an object"): 2,
    }
    empty = envelopes.audit_lines(spark.createDataFrame([], "value string"), "p").collect()
    assert {r["name"]: r["n"] for r in empty} == {"records": 0, "native_envelopes": 0, "legacy_records_migrated": 0, "invalid_records": 0, "valid": 0}


def test_replay_goes_on_and_closes(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "event_id string, t long, host string, value double").select(
            "event_id", F.timestamp_seconds("t").alias("ts"), "host", F.lit("process_started").alias("event_type"), F.lit("p").alias("process_name"), F.lit("u").alias("user_name"), F.lit("local").alias("remote"), "value",
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def build(stream):
        named = lambda kind: stream.withColumn("event_id", F.concat(F.lit(kind), "event_id"))
        wide = replay.stream_combined(named("m"), named("e"), ["value"], 60)
        return wide.withColumn("is_anomaly", F.col("value") > 5)

    write([("a", 0, "h", 1.0), ("a", 1, "h", 1.0), ("b", 2, None, 9.0), (None, 61, "h", 3.0), (None, 61, "h", 3.0)])
    scores, alerts = replay.replay(spark, str(tmp_path / "in"), build, str(tmp_path / "run"), 300)
    rows = {(r["host"], r["window_start"]): (r["metric_sample_count"], r["value"], r["event_total_count"], r["event_unique_users"]) for r in scores.collect()}
    assert rows == {("h", 0): (1, 1.0, 1, 1), ("unknown", 0): (1, 9.0, 1, 1), ("h", 60): (1, 3.0, 1, 1)}
    assert [r["host"] for r in alerts.collect()] == ["unknown"]
    # More files: windows given before do not come again.
    write([("c", 1000, "h", 4.0)])
    scores, _ = replay.replay(spark, str(tmp_path / "in"), build, str(tmp_path / "run"), 300)
    assert sorted((r["host"], r["window_start"]) for r in scores.collect()) == [("h", 0), ("h", 60), ("h", 960), ("unknown", 0)]


def test_narrow_events_are_dealt_out_and_audited_once(spark):
    from behaviorlens.plans import standards

    sf = "/root/testdata/sf0.001"
    assert standards.records(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    plan = standards.q_envelope_audit(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1
