"""Detectors against plain sequential versions, order statistics by digits, and the whole comparison and evaluation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import detectors, ordering
from behaviorlens.plans import api


def sequential(x, start=None, threshold=None, alpha=0.05, floor=1e-6):
    mean, var = start or (x[0].copy(), np.full(x.shape[1], floor))
    scores = []
    for row in x:
        z = sorted(np.abs(row - mean) / np.maximum(np.maximum(np.sqrt(var), 0.01 * np.abs(mean)), floor), reverse=True)[:3]
        scores.append(sum(z) / len(z))
        if threshold is None or scores[-1] < threshold:
            d = row - mean
            mean, var = mean + alpha * d, np.maximum((1 - alpha) * (var + alpha * d * d), floor)
    return scores, mean, var


@pytest.mark.parametrize("threshold", [None, 3.0])
def test_ewma_in_chunks_is_one_pass(spark, threshold):
    """A hot key in chunks; with a threshold and a shift of level, after which nothing is learnt, chunk after chunk is mended."""
    rng = np.random.default_rng(5)
    x = rng.normal(10, 2, (1200, 4)) + np.where(np.arange(1200) > 700, 40, 0)[:, None]
    rows = [("hot", i, *map(float, x[i])) for i in range(1200)] + [("cold", 5 * i, 1.0, float(i), 2.0, 3.0) for i in range(9)]
    df = spark.createDataFrame(rows, "host string, t long, a double, b double, c double, d double")
    scored, last = detectors.ewma_scores(df, "host", ["a", "b", "c", "d"], ["t", "host"], threshold=threshold, chunk_rows=200)
    got = {(r["host"], r["t"]): r["ewma_score"] for r in scored.collect()}
    want, mean, var = sequential(x, threshold=threshold)
    assert len(got) == 1209 and np.allclose([got["hot", i] for i in range(1200)], want, rtol=1e-12)
    state = {r["host"]: r for r in last.collect()}
    assert np.allclose(state["hot"]["mean"], mean, rtol=1e-12) and np.allclose(state["hot"]["var"], var, rtol=1e-12)
    assert got["cold", 0] == 0.0 and len(state) == 2


def test_order_statistics_by_digits(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, -0.0, 1.0, -1e300, 5e-324, float("inf"), rng.gauss(0, 1), rng.gauss(50, 1e-9), float(rng.randrange(9))]) for _ in range(3000)]
    df = spark.createDataFrame([(v, None if i % 2 else float(i), None) for i, v in enumerate(values)], "a double, b double, c double")
    ranks = lambda n: [0, n // 3, n // 2, n - 1]
    few, ordering.COUNTED = ordering.COUNTED, 5
    try:
        got = ordering.order_statistics(df, {k: F.col(k) for k in "abc"}, ranks)
    finally:
        ordering.COUNTED = few
    a, b = sorted(values), [float(i) for i in range(0, 3000, 2)]
    assert got == {"a": [a[r] for r in ranks(3000)], "b": [b[r] for r in ranks(1500)], "c": []}


def labelled(spark, n=120):
    rng = random.Random(8)
    names = ["cpu_percent", "net_bytes_sent_per_sec", "event_process_started_count"]
    rows = []
    for i in range(n):
        attack = i % 17 == 16
        rows.append((60 * i, "h", "attack" if attack else "normal", rng.gauss(50, 5) + 60 * attack, rng.gauss(9, 1), 40 if attack else 1))
    df = spark.createDataFrame(rows, "window_start long, host string, scenario string, cpu_percent double, net_bytes_sent_per_sec double, event_process_started_count long")
    more = {c: F.lit(0) for c in ("event_authentication_failure_count", "event_authentication_success_count", "event_package_installed_count", "event_package_removed_count", "event_package_updated_count", "event_privilege_elevation_count")}
    return df.withColumns(more), names


def test_comparison(spark):
    df, names = labelled(spark)
    found = {r["method"]: r for r in api.compare_detectors(df, names, epochs=8).collect()}
    assert set(found) == {"autoencoder", "robust_zscore", "ewma"} and all(r["windows"] == r["labelled_windows"] == 18 and r["tp"] + r["fn"] == 1 for r in found.values())
    frame = df.orderBy("window_start").toPandas()
    x, normal = frame[names].to_numpy(float), (frame["scenario"] == "normal").to_numpy()
    _, mean, var = sequential(x[:84][normal[:84]])
    scores, mean, var = sequential(x[84:102][normal[84:102]], (mean, var))
    limit = sorted(scores)[round((len(scores) - 1) * 0.995)]
    assert abs(found["ewma"]["threshold"] - limit) < 1e-9
    assert found["ewma"]["anomalies"] == sum(s >= limit for s in sequential(x[102:], (mean, var), limit)[0])
    with pytest.raises(ValueError):
        api.compare_detectors(df.limit(19), names)


def test_evaluation(spark):
    df, names = labelled(spark)
    found = api.evaluate_combined(df, names, epochs=8)
    assert {r["split"]: (r["rows"], r["normal_rows"]) for r in found["dataset"].collect()} == {"train": (84, 80), "validation": (18, 16), "test": (18, 17)}
    methods = {r["method"]: r for r in found["methods"].collect()}
    assert methods["rules"]["recall"] == 1.0 and methods["combined"]["recall"] == 1.0 and methods["rules"]["false_positive_rate"] == 0.0
    assert {r["method"]: (r["attack_runs"], r["missed_runs"]) for r in found["delays"].collect()}["rules"] == (1, 0)
    assert sum(r["windows"] for r in found["disagreement"].collect()) == 18
    with pytest.raises(ValueError):
        api.evaluate_combined(df.limit(9), names)


def test_ewma_of_one_feature_takes_the_steps_of_several():
    """One feature runs on plain numbers; three equal features run on arrays and score alike."""
    x = np.random.default_rng(1).normal(5, 30, (3000, 1))
    x[::50] *= 50
    y = np.concatenate([x, x, x], 1)
    for threshold in (None, 4.0):
        one = detectors._ewma_chunk(x, x[0].copy(), np.full(1, 1e-6), 0.05, 1e-6, threshold)
        three = detectors._ewma_chunk(y, y[0].copy(), np.full(3, 1e-6), 0.05, 1e-6, threshold)
        assert np.allclose(one[0], three[0], rtol=1e-12) and one[1][0] == three[1][0] and one[2][0] == three[2][0]
