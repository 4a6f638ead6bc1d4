"""A whole flow over JSON lines: load, combine, train, score, group, audit and compare."""

import json
import random
import tarfile

from behaviorlens.functions.columns import parse_duration
from behaviorlens.operators import sessions
from behaviorlens.plans import api
from behaviorlens.sources import files


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_flow(spark, tmp_path):
    rng = random.Random(2)
    metrics, events = [], []
    for i in range(120):
        attack = i in (100, 101, 110)
        row = {"timestamp": 1_767_225_600 + 60 * i, "host": "h", "scenario": "attack" if attack else "normal"}
        row |= {f: rng.gauss(50, 5) + (400 if attack and f.startswith("net") else 0) for f in api.FEATURES}
        metrics.append(row)
        for j in range(7 if attack else 1):
            kind = "authentication_failure" if attack else "process_started"
            events.append({"event_id": f"{i}-{j}", "timestamp": f"2026-01-01T{i // 60:02d}:{i % 60:02d}:0{j}Z", "host": "h", "event_type": kind, "data": {"process": {"name": "p"}}})
    m, e = api.load_metrics(spark, write(tmp_path / "m.jsonl", metrics)), api.load_events(spark, write(tmp_path / "e.jsonl", events))
    combined = api.build_combined(m, e).cache()
    assert combined.count() == 120 and combined.where("event_authentication_failure_count = 7").count() == 3
    model = api.load_model(api.save_model(api.train(combined, epochs=15)))
    scored = api.score(combined, model).cache()
    flagged = {r["window_start"] for r in scored.where("is_anomaly").collect()}
    assert {1_767_225_600 + 60 * i for i in (100, 101, 110)} <= flagged and len(flagged) < 12
    assert sessions.correlate_incidents(api.anomalies(scored)).count() >= 1 and sessions.group_alerts(api.anomalies(scored)).count() >= 1
    parts = api.audit(m, e)
    assert parts["coverage"].first()["coverage"] == 1.0 and parts["gaps"].count() == 0 and parts["timestamps"].first()["duplicates"] == 0
    found = {r["method"]: r for r in api.compare_detectors(combined, epochs=5).collect()}
    assert set(found) == {"robust_zscore", "autoencoder", "ewma"} and found["robust_zscore"]["recall"] == 1.0


def test_gate_and_durations():
    good = {"events_valid": True, "records_valid": True, "quality": 99, "coverage": 0.97, "clean_windows": 10_080, "recall": 0.95, "false_positive_rate": None, "windows_per_second": 5000, "peak_mb": 90}
    assert all(api.release_gate(good).values())
    assert [k for k, v in api.release_gate(good | {"coverage": 0.7, "recall": 0.4}).items() if not v] == ["coverage", "detection"]
    assert [parse_duration(x) for x in ("250ms", "5", "2m", "24h")] == [0.25, 5, 120, 86400]
    assert files.segment_order(["b.2", "b", "b.1"], "b") == ["b.1", "b.2", "b"]


def test_archive_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.txt", "d/a.txt")
    got = files.archive_lines(spark, str(tmp_path / "x.tar.gz")).collect()
    assert [(r["member"], r["line_no"], r["value"]) for r in got] == [("d/a.txt", 0, "one"), ("d/a.txt", 1, "two")]
    manifest = files.file_hashes(spark, str(tmp_path / "a.txt"))
    assert files.verify_manifest(spark, str(tmp_path / "a.txt"), manifest).count() == 0
