"""Semantics of the operators on small hand-made tables."""

import hashlib
import hmac
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.operators import detectors, evaluation, ordering, quality, review, rules, sessions, windows
from behaviorlens.plans import behaviour
from behaviorlens.sources import files


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))


def test_ids_equal_the_standard_library(spark):
    row = one(spark, a="x", b="yé").select(fn.uuid5(F.col("a"), F.col("b")).alias("u"), fn.hmac_sha256(b"k" * 32, F.col("b")).alias("h")).first()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "x\x1fyé"))
    assert row["h"] == hmac.new(b"k" * 32, "yé".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("text, want", [
    ("password=abc def", "password=[REDACTED] def"), ("Authorization: Bearer x", "Authorization: [REDACTED] [REDACTED]"), ("my_token=x", "my_token=x"),
    ("access_token: x;y", "access_token: [REDACTED];y"), ("https://u:pw@h/x", "https://u:[REDACTED]@h/x"), ("nothing here", "nothing here"),
])
def test_redaction(spark, text, want):
    assert one(spark, t=text).select(fn.redact_text(F.col("t"))).first()[0] == want


def test_hidden_argument_hides_nothing_itself(spark):
    df = spark.createDataFrame([(["run", "--password", "--token", "plain", "token=x"],)], "a array<string>")
    assert df.select(fn.redact_arguments(F.col("a"))).first()[0] == ["run", "--password", "[REDACTED]", "plain", "token=[REDACTED]"]


def test_combined_window_golden(spark):
    minute = 60_000_000
    metrics = spark.createDataFrame([("h", 0, "10"), ("h", 30_000_000, "30")], "host string, epoch_us long, cpu string")
    events = spark.createDataFrame(
        [("h", 1, "process_started", "p", "u", "r"), ("h", 2, "authentication_failure", "unknown", "", "local"), ("x", 3, "process_started", "p", "u", "r"), ("h", minute, "process_started", "p", "u", "r"), ("h", 5, "package_observed", "p", "u", "r")],
        "host string, epoch_us long, event_type string, process_name string, user_name string, remote string",
    )
    row = windows.combined_windows(metrics, events, ["cpu"]).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["metric_sample_count"], r["cpu"], r["event_process_started_count"], r["event_authentication_failure_count"]) == (2, 20.0, 1, 1)
    assert (r["event_unique_processes"], r["event_unique_users"], r["event_unique_remote_sources"], r["event_total_count"]) == (1, 1, 1, 2)


def test_bad_values_count_as_zero_in_the_mean(spark):
    metrics = spark.createDataFrame([(None, 0, "10"), ("", 1, "bad"), (None, None, "5")], "host string, epoch_us long, cpu string")
    r = windows.metric_windows(metrics, ["cpu"]).collect()
    assert [(x["host"], x["metric_sample_count"], x["cpu"]) for x in r] == [("unknown", 2, 5.0)]


def test_means_add_values_in_the_order_of_events(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1: the files hold the events from the last to the first."""
    values = {day: [round((i * 7919 + day * 31) % 10_007 / 100, 2) for i in range(8 + day % 5)] for day in range(60)}
    rows = [(day * 100 + i, day * 86_400, v, f'{{"k": {i}}}') for day, own in values.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows[::-1], "event_id long, s long, value double, props string").coalesce(3)
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("user_id"), F.lit("click").alias("event_type"), "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for day, own in values.items():
        total = 0.0
        for v in own:
            total += v
        want[day * 86_400] = (len(own), total / len(own))
    got = {r["window_start"]: (r["metric_sample_count"], r["value"]) for r in behaviour.combined(spark, str(tmp_path)).collect()}
    assert got == want


def test_rules_and_fusion(spark):
    df = spark.createDataFrame([(8, 1, 0, 0, 0, 0, 0)], "event_authentication_failure_count long, event_authentication_success_count long, event_package_installed_count long, event_package_removed_count long, event_package_updated_count long, event_process_started_count long, event_privilege_elevation_count long")
    r = rules.fuse(df, F.lit(0.2)).first()
    assert [x["rule_id"] for x in r["rules"]] == ["authentication_failure_burst"]
    assert r["ratio"] == 2.5 and r["is_anomaly"] and r["severity"] == "high"


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 9)], "g string, v double")
    assert ordering.quantiles_by(df, "g", "v", {"m": 0.5}).first()["m"] == 5.0
    assert ordering.order_statistic(df, "v", 0.5) == 5.0
    assert ordering.order_statistic(df.where("v > 9"), "v", 0.5) == 0.0


def test_positions_are_global(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = ordering.with_position(df, "v", ["id"]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_session_boundary_stays_in_the_group(spark):
    df = spark.createDataFrame([("a", t * 1_000_000, i) for i, t in enumerate((0, 300, 601))], "k string, epoch_us long, event_id long")
    got = sessions.sessionise(df, ["k"], 300_000_000).orderBy("event_id").collect()
    assert [r["session"] for r in got] == [0, 0, 1]


def test_confusion_of_nothing(spark):
    df = spark.createDataFrame([(False, False)], "a boolean, p boolean")
    assert evaluation.confusion(df, F.col("a"), F.col("p"), 0.0).first()["recall"] == 0.0
    assert evaluation.confusion(df, F.col("a"), F.col("p"), None).first()["recall"] is None


def test_poisoning_guard(spark):
    df = spark.createDataFrame([(1, "normal"), (2, "scan"), (3, None)], "id long, s string")
    assert [r["id"] for r in evaluation.poisoning_guard(df, "s").collect()] == [1]
    assert evaluation.poisoning_guard(df.withColumn("s", F.lit(None).cast("string")), "s").count() == 3


def test_autoencoder_learns_and_scores_natively(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=80), "b": rng.normal(size=80), "c": rng.normal(size=80)})
    model = detectors.Autoencoder.fit(frame, ["a", "b", "c"], epochs=30)
    far = pd.concat([frame, pd.DataFrame({"a": [50.0], "b": [-50.0], "c": [50.0]})])
    out = model.apply(spark.createDataFrame(far)).orderBy(F.desc("model_ratio")).collect()
    assert out[0]["a"] == 50.0 and out[0]["model_ratio"] > 1 and len(out[0]["top_features"]) == 3


def test_scan_diagnostics(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\nnot json\n{"a":')
    r = files.scan_diagnostics(spark, str(tmp_path)).first()
    assert tuple(r) == (1, 28, 5, 1, 1, 1, 1, 1)  # segments, bytes, total, blank, malformed, non_object, trailing_partial, valid


@pytest.mark.parametrize("parts", [[b'{"a": 1}\r\n\r\n[1]\rnot json\n{"a":'], [b'{"a":\n', b'{"b": 1}\n{"a":', b""], [b'{"a": 1}', b'\xff\xfe\n{"a": "\xc3\xa9"}\n'], [b" \t \n5\n{"]])
def test_physical_lines_are_those_of_the_bytes(spark, tmp_path, parts):
    want = dict.fromkeys(("total", "blank", "malformed", "non_object", "trailing_partial", "valid"), 0)
    for i, data in enumerate(parts):
        (tmp_path / f"s.{i}.jsonl").write_bytes(data)
        lines = data.splitlines(keepends=True)
        for j, line in enumerate(lines):
            want["total"] += 1
            try:
                value = json.loads(line.decode()) if line.strip() else None
                kind = "blank" if not line.strip() else "valid" if isinstance(value, dict) else "non_object"
            except ValueError:
                kind = "trailing_partial" if j == len(lines) - 1 and not line.endswith((b"\n", b"\r")) else "malformed"
            want[kind] += 1
    got = files.scan_diagnostics(spark, str(tmp_path)).first().asDict()
    assert got == want | {"segments": sum(map(bool, parts)), "bytes": sum(map(len, parts))}


def test_nested_redaction_at_any_depth(spark):
    from behaviorlens.functions import columns as fn

    schema = "m map<string,struct<token:string,list:array<map<string,string>>,n:int>>, password struct<x:int>, t array<array<string>>"
    value = ({"a": ("s1", [{"cookie": "c", "k": "pwd=1"}, {"k": "fine"}], 3), "secret": ("x", None, 1), "b": None}, (4,), [["token=1", "ok"], None])
    df = spark.createDataFrame([(1, value), (2, None)], f"id int, v struct<{schema.replace(' ', ':', 1).replace(', password ', ',password:').replace(', t ', ',t:')}>")
    found = {r["path"]: r["reason"] for r in quality.nested_exposures(df, "id", "v").collect()}
    hidden, text = "unredacted sensitive field", "secret-like text"
    assert found == {"$.m.a.token": hidden, "$.m.a.list[0].cookie": hidden, "$.m.a.list[0].k": text, "$.m.secret": hidden, "$.password": hidden, "$.t[0][0]": text}
    shown = df.select("id", fn.redact_nested(F.col("v"), df.schema["v"].dataType).alias("v"))
    r = {x["id"]: x["v"] for x in shown.collect()}
    assert r[2] is None and r[1]["m"]["a"]["token"] == "[REDACTED]" and r[1]["m"]["a"]["list"] == [{"cookie": "[REDACTED]", "k": "pwd=[REDACTED]"}, {"k": "fine"}]
    assert r[1]["m"]["secret"] is None and r[1]["password"] is None and r[1]["t"] == [["token=[REDACTED]", "ok"], None] and quality.nested_exposures(shown, "id", "v").count() == 0


def test_survivors_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    values, texts = [word(rng.randrange(5, 14)) for _ in range(60)] + [None, ""], [(i, word(rng.randrange(0, 60))) for i in range(50)] + [(99, None)]
    v, o = spark.createDataFrame([(x,) for x in values], "value string"), spark.createDataFrame(texts, "id long, text string")
    want = sorted({(i, x) for i, t in texts for x in values if t and x and len(x) >= 8 and x in t})
    assert sorted(map(tuple, quality.survivors(v, o, "id", "text").collect())) == want and want
    few, quality.FILTER_MOST = quality.FILTER_MOST, 1
    try:
        assert sorted(map(tuple, quality.survivors(v, o, "id", "text").collect())) == want
    finally:
        quality.FILTER_MOST = few
    rows = spark.createDataFrame([(1, ["abcdefgh", "short", "abcdefgh", None], "x abcdefgh short"), (2, None, "y")], "id int, v array<string>, t string")
    assert [tuple(r) for r in quality.own_survivors(rows, "id", F.col("v"), F.col("t")).collect()] == [(1, "abcdefgh")]


def test_auth_lines(spark):
    lines = ["sshd[1]: Accepted publickey for bob from 1.2.3.4 port 5", "x sshd[1]: Failed password for invalid user eve from 9.9.9.9 port 1", "pam: authentication failure; rhost=h user=u", "hello"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(files.auth_event(F.col("l")).alias("e")).collect()
    assert [r["e"] and (r["e"]["event_type"], r["e"]["user_name"]) for r in got] == [("authentication_success", "bob"), ("authentication_failure", "eve"), ("authentication_failure", "u"), None]


def test_quality_score(spark):
    assert spark.range(1).select(quality.quality_score(F.lit(10), F.lit(1), F.lit(2))).first()[0] == pytest.approx(45.0)


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "b long, a string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "out"), "a string, b long").collect()), key=repr) == [("é", 2), (None, 1)]


def test_survivors_of_long_texts_take_one_pass(spark):
    """A text of 300,000 characters: windows cut one by one from its start would take as many steps as its square."""
    text = "é" * 150_000 + "kept😀secret" + "x" * 150_000
    o = spark.createDataFrame([(1, text), (2, "kept😀secre"), (3, None), (4, "")], "id long, text string")
    v = spark.createDataFrame([("kept😀secret",), ("kept😀sec",), ("short",), (None,)], "value string")
    start = time.time()
    assert sorted(map(tuple, quality.survivors(v, o, "id", "text").collect())) == [(1, "kept😀sec"), (1, "kept😀secret"), (2, "kept😀sec")]
    assert time.time() - start < 30


def test_review_numbers_are_rounded_by_their_exact_value(spark):
    rows = spark.createDataFrame([(0.5635625,), (0.0000005,), (2.5,), (float("nan"),), (None,), (-1e22,)], "x double")
    assert [r[0] for r in rows.select(review.six_digits(F.col("x"))).collect()] == [None if x is None else f"{x:.6f}" for x in (0.5635625, 0.0000005, 2.5, float("nan"), None, -1e22)]
