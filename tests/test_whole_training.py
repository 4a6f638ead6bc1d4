"""The autoencoder's scaler, weights and threshold come from all windows."""

import numpy as np
from pyspark.sql import functions as F

from behaviorlens.operators import detectors


def test_scaler_and_threshold_cover_all_windows(spark):
    features = ["x", "y"]
    rows = spark.range(600).select(
        F.lit("h").alias("host"), F.col("id").alias("window_start"), (F.col("id") % 37).cast("double").alias("x"),
        F.when(F.col("id") % 100 == 0, 500.0).otherwise(F.col("id") % 11).cast("double").alias("y"),
    )
    model = detectors.Autoencoder.fit_windows(rows, features, epochs=4, part_rows=150)
    assert model.scaler == detectors.fit_scaler(rows, features)
    x = rows.select(*features).toPandas().to_numpy(float)
    mean, std = (np.array([model.scaler[f][i] for f in features]) for i in (0, 1))
    z = (x - mean) / std
    errors = np.sort(((np.tanh(z @ model.w1.T + model.b1) @ model.w2.T + model.b2 - z) ** 2).mean(1))
    want = max(errors[round(599 * 0.995)], errors.mean() + 3 * errors.std())
    assert abs(model.threshold - want) < 1e-9 * want


def test_registered_training_takes_all_windows(spark, monkeypatch):
    from behaviorlens.plans import behaviour

    seen = []
    fit = detectors.fit_scaler
    monkeypatch.setattr(detectors, "fit_scaler", lambda df, features: seen.append(df.count()) or fit(df, features))
    sf = "/root/testdata/sf0.01"
    assert behaviour.q_autoencoder_train(spark, sf).count() > 0 and seen == [behaviour.combined(spark, sf).count()]


def test_one_part_is_the_plain_descent(spark):
    features = ["x", "y"]
    rows = spark.range(80).select(F.lit("h").alias("host"), F.col("id").alias("window_start"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    model = detectors.Autoencoder.fit_windows(rows, features, epochs=9)
    frame = rows.orderBy(F.xxhash64("host", "window_start")).toPandas()
    plain = detectors.Autoencoder.fit(frame, features, epochs=9, scaler=model.scaler)
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(model.weights(), plain.weights(), strict=True)) and abs(model.threshold - plain.threshold) < 1e-9


def test_scores_with_filters_keep_a_small_plan(spark):
    """37 features under three filters, as the quantiles put them there."""
    names = [f"f{i}" for i in range(37)]
    rows = spark.range(50).select("id", *[(F.col("id") * (i + 1) % 13).cast("double").alias(f) for i, f in enumerate(names)])
    model = detectors.Autoencoder.drawn(names, {f: (5.0, 3.0) for f in names}, 1)
    scored = model.apply(rows)
    kept = scored.where("model_error is not null").where("model_error > 0.5").where("model_error <= 1e9")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    found = {r["id"]: r for r in scored.collect()}
    want = model.errors(rows.select(*names).toPandas().to_numpy(float))
    for i, r in found.items():
        assert abs(r["model_error"] - want[i].mean()) < 1e-12 and [t["feature"] for t in r["top_features"]] == [names[j] for j in np.argsort(-want[i], kind="stable")[:5]]
    assert {r["id"] for r in kept.collect()} == {i for i in range(50) if want[i].mean() > 0.5}


def test_parts_descend_side_by_side_as_alone():
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(n, 5)) for n in (40, 1, 57, 57)]
    model = detectors.Autoencoder.drawn(list("abcde"), {}, 42)
    together = detectors._descend_together(parts, model.weights(), range(2, 5), 8, 42)
    for part, found in zip(parts, together, strict=True):
        alone = detectors._descend(part, [w.copy() for w in model.weights()], range(2, 5), 8, 42)
        assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(alone, found, strict=True))


def test_a_task_takes_many_parts(spark, monkeypatch):
    """Small parts share a task's steps, with the weights that one part a task gives."""
    rows = spark.range(300).select(F.lit("h").alias("host"), F.col("id").alias("window_start"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    many = detectors.Autoencoder.fit_windows(rows, ["x", "y"], epochs=8, part_rows=30)
    monkeypatch.setattr(detectors, "TOGETHER", 1)
    one = detectors.Autoencoder.fit_windows(rows, ["x", "y"], epochs=8, part_rows=30)
    assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(many.weights(), one.weights(), strict=True))
