"""Statistical detectors: scaler, robust z-scores, drift, EWMA and a small autoencoder."""

from __future__ import annotations

import dataclasses
import functools
import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.functions.columns import vectorise
from behaviorlens.operators.ordering import middle, order_statistic, order_statistics, with_position
from behaviorlens.sources.store import stored

#: Rows of a part, about, how often the parts' weights are averaged, and parts that a task descends over side by side.
PART_ROWS, ROUNDS, TOGETHER = 2_000, 4, 128
#: Rows of one key that a task takes in order, and rows of short keys that meet in a group, about.
CHUNK_ROWS, GROUP_ROWS = 100_000, 25_000


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; deviations below 1e-9 become 1."""
    values = {f: F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) for f in features}
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values.values())]).first()
    return {f: (row[f"m{i}"] or 0.0, s if (s := row[f"s{i}"] or 0.0) >= 1e-9 else 1.0) for i, f in enumerate(features)}


def standardise(features: Sequence[str], scaler: dict[str, tuple[float, float]]) -> Column:
    """Array of z-scores of the features."""
    return F.array(*[(F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) - scaler[f][0]) / scaler[f][1] for f in features])


def unpivot(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids, feature, value): one row for each feature of each row."""
    return df.select(*ids, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), vectorise(features, strict=True))).alias("feature", "value"))


def _value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def fit_robust(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, center, scale): nearest-rank median, and max(1.4826 MAD, .01 |median|, 1e-6)."""
    half = lambda n: [round((n - 1) / 2)]
    med = {f: v[0] for f, v in order_statistics(df, {f: _value(f) for f in features}, half).items() if v}
    mad = order_statistics(df, {f: F.abs(_value(f) - m) for f, m in med.items()}, half)
    rows = [(f, m, max(1.4826 * mad[f][0], 0.01 * abs(m), 1e-6)) for f, m in med.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, center double, scale double")


def robust_score(features: Sequence[str], profile: dict[str, tuple[float, float]], top: int = 3) -> Column:
    """Mean of the largest |z| of a row."""
    z = F.array(*[F.abs((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - profile[f][0]) / profile[f][1]) for f in features])
    best = F.slice(F.sort_array(z, asc=False), 1, min(top, len(features)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / min(top, len(features))


@dataclasses.dataclass(frozen=True)
class Robust:
    """Robust z-scores: medians and scales of each feature, and the score from which a row is an anomaly."""

    profile: dict[str, tuple[float, float]]
    threshold: float = 1.0

    @classmethod
    def fit(cls, rows: DataFrame, features: Sequence[str]) -> Robust:
        found = {r["feature"]: (r["center"], r["scale"]) for r in fit_robust(rows, features).collect()}
        if not found:
            raise ValueError("need at least one training row")
        return cls({f: found[f] for f in features})

    def score(self) -> Column:
        return robust_score(list(self.profile), self.profile)

    def calibrated(self, rows: DataFrame, quantile: float = 0.995) -> Robust:
        return dataclasses.replace(self, threshold=max(order_statistic(rows.select(self.score().alias("s")), "s", quantile), 1e-9))


@dataclasses.dataclass(frozen=True)
class Ewma:
    """One running state over all rows in order, and the score from which a row is an anomaly."""

    features: Sequence[str]
    order: Sequence[str]
    state: tuple[list[float], list[float]]
    alpha: float = 0.05
    threshold: float = 1.0

    @classmethod
    def fit(cls, rows: DataFrame, features: Sequence[str], order: Sequence[str], alpha: float = 0.05) -> Ewma:
        if not 0.0 < alpha <= 1.0:
            raise ValueError("alpha must be between zero and one")
        last = ewma_scores(rows, None, features, order, alpha)[1].first()
        if not last:
            raise ValueError("need at least one training row")
        return cls(list(features), list(order), (last["mean"], last["var"]), alpha)

    def calibrated(self, rows: DataFrame, quantile: float = 0.995) -> Ewma:
        """Scores rows and learns them; the threshold is the quantile of their scores."""
        scored, last = ewma_scores(rows, None, self.features, self.order, self.alpha, start=self.state)
        state = last.first()
        return dataclasses.replace(self, state=(state["mean"], state["var"]), threshold=max(order_statistic(scored, "ewma_score", quantile), 1e-9))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with ewma_score; rows whose score reaches the threshold are not learnt."""
        return ewma_scores(rows, None, self.features, self.order, self.alpha, threshold=self.threshold, start=self.state)[0]


def drift_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, med, mad, low, high) with true medians."""
    mean = lambda pair: sum(pair) / len(pair)
    med = {f: mean(v) for f, v in order_statistics(df, {f: _value(f) for f in features}, middle).items() if v}
    mad = order_statistics(df, {f: F.abs(_value(f) - m) for f, m in med.items()}, middle)
    ends = df.agg(*[g(_value(f)).alias(f"{f}@{n}") for f in med for n, g in (("low", F.min), ("high", F.max))]).first() if med else {}
    rows = [(f, m, mean(mad[f]), ends[f"{f}@low"], ends[f"{f}@high"]) for f, m in med.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, med double, mad double, low double, high double")


def drift_compare(reference: DataFrame, current: DataFrame, features: Sequence[str], shift: float = 4.0) -> DataFrame:
    """(feature, reference_median, current_median, robust_shift, drifted) of each feature."""
    old, new = drift_profile(reference, features), drift_profile(current, features).select("feature", F.col("med").alias("current_median"))
    scale = F.greatest(F.col("mad") * 1.4826, F.abs("med") * 0.01, F.lit(1e-6))
    found = old.join(new, "feature").withColumn("robust_shift", F.abs(F.col("current_median") - F.col("med")) / scale)
    return found.select("feature", F.col("med").alias("reference_median"), "current_median", "robust_shift", (F.col("robust_shift") >= shift).alias("drifted"))


def _ewma_chunk(x: np.ndarray, mean: np.ndarray, var: np.ndarray, alpha: float, floor: float, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows in order, and the means and variances after them.  A row whose score reaches the threshold is scored but not learnt."""
    scores, most = np.empty(len(x)), min(3, x.shape[1])
    if x.shape[1] == 1:  # plain numbers take the same steps without an array a row
        m, v, keep, root = float(mean[0]), float(var[0]), 1 - alpha, math.sqrt
        found = []
        for value in x[:, 0].tolist():
            diff = value - m
            scale, least = root(v), 0.01 * abs(m)
            scale = least if least > scale else scale
            score = abs(diff) / (floor if floor > scale else scale)
            found.append(score)
            if threshold is None or score < threshold:
                m += alpha * diff
                v = keep * (v + alpha * diff * diff)
                v = floor if floor > v else v
        scores[:] = found
        return scores, np.array([m]), np.array([v])
    for i, row in enumerate(x):
        diff = row - mean
        z = np.abs(diff) / np.maximum(np.maximum(np.sqrt(var), 0.01 * np.abs(mean)), floor)
        scores[i] = np.sort(z)[::-1][:most].sum() / most
        if threshold is None or scores[i] < threshold:
            mean = mean + alpha * diff
            var = np.maximum((1 - alpha) * (var + alpha * diff * diff), floor)
    return scores, mean, var


def ewma_scores(df: DataFrame, key: str | None, features: Sequence[str], order: Sequence[str], alpha: float = 0.05, floor: float = 1e-6, threshold: float | None = None,
                start: tuple[Sequence[float], Sequence[float]] | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(scored, states): df with ewma_score, and each key's mean and variance after its last row.

    Each row is scored against the running means and variances of its key (of all rows, if key is None), which then learn it, unless its score reaches
    ``threshold``.  The scale of a feature is its deviation, at least one hundredth of its mean and ``floor``; the score is the mean of the three largest |z|.
    ``start`` is the state before the first row; without it a key starts at its own first row.

    A key of more than ``chunk_rows`` rows is cut into chunks of the global order, which run in parallel from a guess, the state
    that their own first row gives.  Then a chunk whose start is not what the chunk before it ended with runs again, until all agree: the result
    is that of one pass over the key.  The state forgets quickly, so two or three rounds do; the first chunk that is wrong is mended in every round."""
    names, own = list(features), key or "__all"
    rows = df if key else df.withColumn(own, F.lit(0))
    rows = with_position(rows, order[0], [*order[1:]], "__pos")
    many = rows.groupBy(own).agg(F.count("*").alias("__n"))
    chunk = F.when(F.col("__n") > chunk_rows, F.floor(F.col("__pos") / chunk_rows)).otherwise(F.lit(0))
    rows = stored(rows.join(many, own).withColumn("__chunk", chunk).withColumn("__x", vectorise(names)).drop("__n"), "ewma-rows")
    kind = rows.schema[own].dataType.simpleString()
    first = None if start is None else [np.array(s, float) for s in start]

    # Short keys share a group, since a group of its own costs a key more than its rows do.
    groups = rows.count() // GROUP_ROWS + 1
    grouped = lambda df: df.withColumn("__group", F.pmod(F.xxhash64(own, "__chunk"), F.lit(groups))).groupBy("__group")

    def run(part: pd.DataFrame, state: pd.DataFrame, scored: bool) -> pd.DataFrame:
        part = part.sort_values([own, "__chunk", "__pos"])
        x = np.stack(part["__x"].to_numpy()).astype(float) if len(part) else np.zeros((0, len(names)))
        keys, chunks = part[own].to_numpy(), part["__chunk"].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        given = {(k, c): (m, v) for k, c, m, v in zip(state[own], state["__chunk"], state["mean"], state["var"], strict=True) if m is not None}
        scores, ends = np.zeros(len(x)), []
        for i, j in zip([0, *cuts] if len(x) else [], [*cuts, len(x)], strict=len(x) > 0):
            found = given.get((keys[i], chunks[i]))
            mean, var = [np.array(s, float) for s in found] if found else (x[i].copy(), np.full(x.shape[1], floor)) if first is None else first
            scores[i:j], mean, var = _ewma_chunk(x[i:j], mean, var, alpha, floor, threshold)
            ends.append((keys[i], chunks[i], mean.tolist(), var.tolist()))
        if scored:
            return pd.DataFrame({"__pos": part["__pos"], "ewma_score": scores})
        return pd.DataFrame(ends, columns=[own, "__chunk", "mean", "var"])

    light = rows.select(own, "__chunk", "__pos", "__x")
    none = F.lit(None).cast("array<double>")
    schema = f"`{own}` {kind}, __chunk long, mean array<double>, var array<double>"
    lag = lambda c: F.lag(c).over(Window.partitionBy(own).orderBy("__chunk")).alias(c)
    used = stored(rows.select(own, "__chunk").distinct().withColumns({"mean": none, "var": none}), "ewma-starts")
    again, ends = used, None
    while True:
        part = light.join(again.select(own, "__chunk"), [own, "__chunk"], "left_semi") if ends is not None else light
        done = grouped(part).cogroup(grouped(again)).applyInPandas(lambda a, b: run(a, b, False), schema)
        done = done if ends is None else done.unionByName(ends.join(again.select(own, "__chunk"), [own, "__chunk"], "left_anti"))
        ends = stored(done, "ewma-ends")
        now = stored(ends.select(own, "__chunk", lag("mean"), lag("var")), "ewma-starts")
        differs = now.alias("n").join(used.alias("u"), [own, "__chunk"]).where(~F.col("n.mean").eqNullSafe(F.col("u.mean")) | ~F.col("n.var").eqNullSafe(F.col("u.var")))
        again = stored(differs.select(own, "__chunk", "n.mean", "n.var"), "ewma-again")
        used = now
        if not again.count():
            break
    scores = grouped(light).cogroup(grouped(used)).applyInPandas(lambda a, b: run(a, b, True), "__pos long, ewma_score double")
    scored = rows.drop("__x", "__chunk").join(scores, "__pos").drop("__pos")
    last = ends.groupBy(own).agg(F.max_by("mean", "__chunk").alias("mean"), F.max_by("var", "__chunk").alias("var"))
    return (scored, last) if key else (scored.drop(own), last.drop(own))


def _descend(z: np.ndarray, weights: list[np.ndarray], epochs: range, of: int, seed: int, rate: float = 0.015) -> list[np.ndarray]:
    """Stochastic descent over standardised rows, one row a step, in the given epochs of ``of``; the step falls with the epoch.

    The generator has drawn the starting weights before it orders the rows, as a run from the first epoch does."""
    w1, b1, w2, b2 = weights
    rng = random.Random(seed)
    for _ in range(w1.size + w2.size):
        rng.random()
    order = list(range(len(z)))
    for epoch in range(epochs.stop):
        rng.shuffle(order)
        if epoch < epochs.start:
            continue
        step = rate / (1 + epoch / of)
        for i in order:
            h = np.tanh(w1 @ z[i] + b1)
            out = w2 @ h + b2 - z[i]
            back = (w2.T @ out) * (1 - h * h)
            w2 -= step * np.outer(out, h)
            b2 -= step * out
            w1 -= step * np.outer(back, z[i])
            b1 -= step * back
    return [w1, b1, w2, b2]


def _orders(size: int, drawn: int, epochs: range, seed: int) -> list[np.ndarray]:
    """The orders in which ``_descend`` takes a part of this size, of the given epochs."""
    rng = random.Random(seed)
    for _ in range(drawn):
        rng.random()
    order, found = list(range(size)), []
    for epoch in range(epochs.stop):
        rng.shuffle(order)
        if epoch >= epochs.start:
            found.append(np.array(order))
    return found


def _descend_together(parts: list[np.ndarray], weights: list[np.ndarray], epochs: range, of: int, seed: int, rate: float = 0.015) -> list[list[np.ndarray]]:
    """What ``_descend`` gives for each part from the same weights.  A step takes the next row of every part at once; parts of fewer rows stop earlier."""
    most = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    sizes = np.array([len(parts[i]) for i in most])
    first = np.cumsum(sizes) - sizes
    rows = np.concatenate([parts[i] for i in most])
    w1, b1, w2, b2 = (np.repeat(w[..., None], len(parts), -1) for w in weights)  # parts are the last axis
    drawn = weights[0].size + weights[2].size
    orders = {n: _orders(n, drawn, epochs, seed) for n in set(sizes.tolist())}
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left").tolist()  # parts of more rows than the step's number
    for turn, epoch in enumerate(epochs):
        step = rate / (1 + epoch / of)
        places = np.zeros((sizes[0], len(parts)), np.int64)
        for p, n in enumerate(sizes.tolist()):
            places[:n, p] = first[p] + orders[n][turn]
        for i, n in enumerate(active):
            v1, c1, v2, c2 = w1[..., :n], b1[..., :n], w2[..., :n], b2[..., :n]
            z = rows[places[i, :n]].T
            h = np.tanh((v1 * z).sum(1) + c1)
            out = (v2 * h).sum(1) + c2 - z
            back = (v2 * out[:, None]).sum(0) * (1 - h * h)
            out *= step
            back *= step
            v2 -= out[:, None] * h
            c2 -= out
            v1 -= back[:, None] * z
            c1 -= back
    found: list[list[np.ndarray]] = [[]] * len(parts)
    for place, i in enumerate(most):
        found[i] = [w[..., place] for w in (w1, b1, w2, b2)]
    return found


def _parts_descent(start: list[np.ndarray], epochs: range, of: int, seed: int):
    """A function on the rows of some parts: the sum of the weights after each part's descent times its number of rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.stack(part["z"].to_numpy()) for _, part in rows.sort_values(["part", "h"], kind="stable").groupby("part")]
        found = _descend_together(parts, start, epochs, of, seed)
        return pd.DataFrame({"w": [sum(np.concatenate([w.ravel() for w in own]) * len(part) for own, part in zip(found, parts, strict=True))]})

    return run


class Autoencoder:
    """One hidden tanh layer, linear output, mean squared error over standardised features."""

    def __init__(self, features: Sequence[str], scaler: dict[str, tuple[float, float]], w1, b1, w2, b2, threshold: float = 1.0):
        self.features, self.scaler = list(features), scaler
        self.w1, self.b1, self.w2, self.b2, self.threshold = w1, b1, w2, b2, threshold

    @classmethod
    def fit(cls, rows: pd.DataFrame, features: Sequence[str], epochs: int = 220, rate: float = 0.015, quantile: float = 0.995, seed: int = 42,
            scaler: dict[str, tuple[float, float]] | None = None) -> Autoencoder:
        """Stochastic descent over a frame that a caller holds.  Scaler, unless given, and threshold are those of the frame; fit_windows takes all rows of a table."""
        x = rows[list(features)].apply(pd.to_numeric, errors="coerce").fillna(0.0).to_numpy(float)
        if scaler is None:
            mean, std = x.mean(0), x.std(0)
            std[std < 1e-9] = 1.0
        else:
            mean, std = (np.array([scaler[f][i] for f in features]) for i in (0, 1))
        z = (x - mean) / std
        model = cls.drawn(features, {f: (float(m), float(s)) for f, m, s in zip(features, mean, std, strict=True)}, seed)
        model.w1, model.b1, model.w2, model.b2 = w1, b1, w2, b2 = _descend(z, model.weights(), range(epochs), epochs, seed, rate)
        errors = np.sort(((np.tanh(z @ w1.T + b1) @ w2.T + b2 - z) ** 2).mean(1))
        at = min(max(round((len(errors) - 1) * quantile), 0), len(errors) - 1)
        model.threshold = max(float(errors[at]), float(errors.mean() + 3 * errors.std()), 1e-9)
        return model

    @classmethod
    def fit_windows(cls, clean: DataFrame, features: Sequence[str], epochs: int = 220, quantile: float = 0.995, seed: int = 42, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> Autoencoder:
        """Scaler, weights and threshold of all clean windows.

        The rows are dealt by hash to parts of about ``part_rows``.  In every round each part descends over its own rows from the common weights, for its share of
        the epochs, and the parts' weights are averaged by their rows: one part is the plain descent over all of them.  A task takes a bounded number of parts
        side by side.  What reaches the driver is one number a weight."""
        scaler = fit_scaler(clean, features)
        keyed = clean.select(F.xxhash64("host", "window_start").alias("h"), standardise(features, scaler).alias("z"))
        rows = stored(keyed, "autoencoder-rows")
        n = rows.count()
        parts = max(1, -(-n // part_rows))
        model = cls.drawn(features, scaler, seed)
        shape = [x.shape for x in model.weights()]
        dealt = rows.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        tasks = min(parts, max(-(-parts // TOGETHER), clean.sparkSession.sparkContext.defaultParallelism))
        dealt = dealt.withColumn("task", F.pmod("part", F.lit(tasks))).repartitionById(tasks, F.col("task"))
        done = 0
        for turn in range(rounds):
            stop = epochs * (turn + 1) // rounds
            descend = _parts_descent(model.weights(), range(done, stop), epochs, seed)
            found = dealt.groupBy("task").applyInPandas(descend, "w array<double>")
            # Sums of weights in two steps, so that many parts do not meet in one task.
            summed = found.select(F.posexplode("w").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")) if n else None
            if summed is not None:
                flat = np.array([x / n for _, x in sorted(tuple(r) for r in summed.collect())])  # one number a weight
                model.w1, model.b1, model.w2, model.b2 = (x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([math.prod(s) for s in shape])[:-1]), shape, strict=True))
            done = stop
        return model.calibrated(clean, quantile)

    @classmethod
    def drawn(cls, features: Sequence[str], scaler: dict[str, tuple[float, float]], seed: int) -> Autoencoder:
        """A model of random weights."""
        d = len(features)
        hidden = max(3, min(12, d // 2))
        rng = random.Random(seed)
        draw = lambda n, m: np.array([[rng.uniform(-1 / math.sqrt(m), 1 / math.sqrt(m)) for _ in range(m)] for _ in range(n)])
        return cls(features, scaler, draw(hidden, d), np.zeros(hidden), draw(d, hidden), np.zeros(d))

    def weights(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def calibrated(self, rows: DataFrame, quantile: float = 0.995) -> Autoencoder:
        """The model with the threshold of these rows: the quantile of their errors or their mean and three deviations, whichever is more.  The errors are written once."""
        errors = stored(self.apply(rows).select("model_error"), "autoencoder-errors")
        row = errors.agg(F.avg("model_error").alias("m"), F.stddev_pop("model_error").alias("s")).first()
        threshold = max(order_statistic(errors, "model_error", quantile), (row["m"] or 0.0) + 3 * (row["s"] or 0.0), 1e-9)
        return Autoencoder(self.features, self.scaler, *self.weights(), threshold)

    def errors(self, values: np.ndarray) -> np.ndarray:
        """Squared misses of every feature of rows of plain values.  Sums run feature by feature, so that they do not depend on how many rows there are."""
        mean, std = (np.array([self.scaler[f][i] for f in self.features]) for i in (0, 1))
        z = (values - mean) / std
        total = lambda x, w: functools.reduce(lambda a, b: a + b, [x[:, i, None] * w[:, i] for i in range(x.shape[1])])
        miss = total(np.tanh(total(z, self.w1) + self.b1), self.w2) + self.b2 - z
        return miss * miss

    def apply(self, df: DataFrame, top: int = 5) -> DataFrame:
        """df with model_error, model_ratio and top_features (largest contributions first, equal ones in feature order).

        One Arrow function scores a batch of rows.  It is marked as not deterministic, so a filter on its result stays above it and is never a second call."""
        threshold, names, errors = self.threshold, np.array(self.features, object), self.errors
        kind = pa.struct([("feature", pa.string()), ("contribution", pa.float64())])

        @F.arrow_udf("struct<error: double, ratio: double, top: array<struct<feature: string, contribution: double>>>")
        def scored(rows: pa.Array) -> pa.Array:
            part = errors(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(names)))
            error = functools.reduce(lambda a, b: a + b, part.T, np.zeros(len(part))) / len(names)
            best = np.argsort(-part, axis=1, kind="stable")[:, :top]
            flat = pa.StructArray.from_arrays([pa.array(names[best.ravel()].tolist(), pa.string()), pa.array(np.take_along_axis(part, best, 1).ravel())], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * best.shape[1]), flat)
            return pa.StructArray.from_arrays([pa.array(error), pa.array(error / threshold), lists], ["error", "ratio", "top"])

        held = df.withColumn("__model", scored.asNondeterministic()(vectorise(self.features)))
        return held.select(*df.columns, F.col("__model.error").alias("model_error"), F.col("__model.ratio").alias("model_ratio"), F.col("__model.top").alias("top_features"))
