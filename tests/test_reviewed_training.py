"""Retraining on reviewed windows: what is left out, and the gate that keeps the current model."""

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators.windows import COUNTS
from behaviorlens.plans import api


def test_retraining_and_its_gate(spark):
    n = 60
    windows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise(F.lit(None)).alias("host"), (F.col("id") * 60).alias("window_start"), (F.col("id") % 7).cast("double").alias("x"), *[F.lit(1).alias(c) for c in COUNTS])
    alerts = spark.createDataFrame([("p", "a", 0), ("q", "a", 0), ("r", "", 60), ("s", "a", 120), ("t", "a", 999)], "alert_id string, host string, window_start long")
    note = lambda rows: spark.createDataFrame([(i, label, "") for i, label in rows], "alert_id string, label string, analyst_note string")
    full = note([("p", "suspicious"), ("q", "benign"), ("r", "confirmed_attack"), ("s", "benign"), ("t", "suspicious")])
    found = api.retrain_reviewed(windows, alerts, full, features=["x"], epochs=4)
    # Windows 0 (one of its alerts is suspicious) and 60 of the unnamed host go; the alert at 999 covers no window.
    want = {"input_windows": n, "selected_windows": n - 2, "excluded_windows": 2, "alerts": 5, "unreviewed": 0, "unknown_reviews": 0}
    assert found["accepted"] and want.items() <= found["selection"].items() and found["rules"].count() == 4
    left = [r["x"] for r in windows.where("window_start not in (0, 60)").collect()]
    mean, _ = found["model"].scaler["x"]
    assert abs(mean - sum(left) / len(left)) < 1e-9

    some = full.where("alert_id != 's'")
    for reviews, bound in ((some, 0), (full.unionByName(note([("z", "benign")])), 0)):
        kept = api.retrain_reviewed(windows, alerts, reviews, found["model"], bound, features=["x"], epochs=4)
        assert not kept["accepted"] and kept["model"] is found["model"] and kept["rules"] is None
        with pytest.raises(ValueError, match="review gate"):
            api.retrain_reviewed(windows, alerts, reviews, None, bound, features=["x"])
    assert api.retrain_reviewed(windows, alerts, some, None, 1, features=["x"], epochs=4)["accepted"]
    with pytest.raises(ValueError, match="review gate"):
        api.retrain_reviewed(windows.where("window_start = 0"), alerts, full, features=["x"])
