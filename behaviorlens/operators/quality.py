"""Data quality: timestamp, feature and record audits, secret exposures, readiness and health."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from behaviorlens.functions.columns import exposures_nested, is_sensitive_key, parse_timestamp, redact_text
from behaviorlens.operators.sessions import behind_running_max
from behaviorlens.sources.store import stored


def timestamp_audit(df: DataFrame, text: str = "timestamp", identity: Sequence[str] = ("event_id",)) -> DataFrame:
    """Per host: rows, missing, invalid and usable timestamps, repeated identities, first and last second."""
    value = F.col(text)
    missing = value.isNull() | (value == "")
    known = F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]) != ""
    # Rows without an identity repeat nothing, so they are spread.
    spread = F.when(~known, F.xxhash64(*df.columns))
    nth = F.row_number().over(Window.partitionBy(*identity, spread).orderBy(F.lit(1)))
    return df.withColumn("__t", parse_timestamp(value)).withColumn("__again", (nth > 1) & known).groupBy("host").agg(
        F.count("*").alias("rows"), F.count_if(missing).alias("missing"), F.count_if(~missing & F.col("__t").isNull()).alias("invalid"),
        F.count("__t").alias("usable"), F.count_if("__again").alias("duplicates"), F.min("__t").alias("first"), F.max("__t").alias("last"),
    )


def feature_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, missing, non_numeric, non_finite) of string columns."""
    text = F.col("value")
    number = text.try_cast("double")
    absent = text.isNull() | (text == "")
    long = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("string") for f in features]))).alias("feature", "value"))
    finite = ~(F.isnan(number) | (F.abs(number) == float("inf")))
    return long.groupBy("feature").agg(
        F.count_if(absent).alias("missing"), F.count_if(~absent & number.isNull()).alias("non_numeric"), F.count_if(~absent & ~finite).alias("non_finite")
    )


def record_issues(df: DataFrame, required: Sequence[str], features: Sequence[str] = (), percents: Sequence[str] = (), order: str = "row_no", secrets: Sequence[str] = ()) -> DataFrame:
    """(row_no, level, code) of every problem of every record."""
    when = lambda cond, level, code: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = [when(F.col("__t").isNull(), "error", "invalid_timestamp")]
    found += [when(F.col(c).isNull() | (F.col(c).cast("string") == ""), "error", f"missing_{c}") for c in required]
    for c in features:
        text, number = F.col(c).cast("string"), F.col(c).try_cast("double")
        absent = text.isNull() | (text == "")
        finite = ~(F.isnan(number) | (F.abs(number) == float("inf")))
        found += [
            when(absent, "error", "missing_feature"), when(~absent & number.isNull(), "error", "non_numeric_feature"), when(~finite, "error", "non_finite_feature"),
            when(finite & (number < 0), "warning", "negative_feature"),
        ]
        if c in percents:
            found.append(when(finite & (number > 100), "warning", "percent_out_of_range"))
    found += [when(has_secret(F.col(c)), "error", "secret_exposure") for c in secrets]
    found += [when(F.col("__late"), "warning", "out_of_order"), when(F.col("__again"), "warning", "duplicate_identity")]
    unnamed = F.coalesce(F.col("event_id").cast("string"), F.lit("")) == ""
    nth = F.row_number().over(Window.partitionBy("event_id", F.when(unnamed, F.col(order))).orderBy(order))
    rows = df.withColumn("__t", parse_timestamp(F.col("timestamp"))).withColumn("__again", (nth > 1) & (F.coalesce(F.col("event_id").cast("string"), F.lit("")) != ""))
    rows = rows.withColumn("__late", behind_running_max(rows, ["host"], "__t", [order]))
    return rows.select(order, F.explode(F.array_compact(F.array(*found))).alias("issue")).select(order, "issue.*")


def issue_summary(issues: DataFrame, order: str = "row_no", examples: int = 5) -> DataFrame:
    """(level, code, n, examples): the first rows of each code.  Each task keeps its own first rows of a code before any are shuffled."""
    nth = F.row_number().over(Window.partitionBy("level", "code").orderBy(order))
    few = issues.withColumn("__n", nth).where(F.col("__n") <= examples).groupBy("level", "code").agg(F.array_sort(F.collect_list(order)).alias("examples"))
    return issues.groupBy("level", "code").agg(F.count("*").alias("n")).join(few, ["level", "code"])


def quality_score(rows: Column, errors: Column, warnings: Column) -> Column:
    """100 (1 - min(1, 5 errors / rows + .25 warnings / rows))."""
    n = F.greatest(rows, F.lit(1))
    return 100.0 * (1.0 - F.least(F.lit(1.0), 5.0 * errors / n + 0.25 * warnings / n))


def has_secret(text: Column) -> Column:
    """Whether redaction would change the text."""
    return F.coalesce(redact_text(text) != text, F.lit(False))


def secret_exposures(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, path, reason) of columns whose name or text gives a secret away."""
    value = F.col("value")
    long = df.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))).alias("path", "value"))
    reason = F.when(is_sensitive_key(F.col("path")) & value.isNotNull() & ~value.isin("", "[REDACTED]"), "sensitive_key").when(has_secret(value), "secret_text")
    return long.withColumn("reason", reason).where("reason is not null").select(key, "path", "reason")


def nested_exposures(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, reason) of every secret in a column of any type, at any depth."""
    found = exposures_nested(F.col(column), df.schema[column].dataType)
    return df.select(key, F.explode(found).alias("e")).select(key, "e.path", "e.reason")


#: Characters of a raw value that must not survive; shorter values are not looked for.
SURVIVING = 8


def own_survivors(df: DataFrame, key: str, values: Column, output: Column) -> DataFrame:
    """(key, value) of every raw value (array of strings) of 8 characters or more that stands in the output text of its own row."""
    left = F.filter(values, lambda v: (F.length(v) >= SURVIVING) & F.contains(output, v))
    return df.select(key, F.explode(F.array_distinct(left)).alias("value"))


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every SURVIVING characters that follow each other within a text, and the number of the text they stand in."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    n = max(0, len(codes) - SURVIVING + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SURVIVING):
        h = (h ^ codes[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = left[:n] >= SURVIVING
    return h[whole].view(np.int64), owner[:n][whole]


def _head(value: Column) -> Column:
    """The hash of the first SURVIVING characters of values of at least so many."""
    @F.arrow_udf("long")
    def hashed(values: pa.Array) -> pa.Array:
        return pa.array(_windows([v[:SURVIVING] for v in values.to_pylist()])[0])

    return hashed(value)


def _places(h: np.ndarray) -> list[np.ndarray]:
    """The two places of a hash in the filter."""
    return [h >> s & (FILTER_BITS - 1) for s in (0, 32)]


def _suspects(batches: Iterable[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """key, text and hash of every window of a text that passes the filter, once each."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        start = 0
        while start < len(texts):  # about SLICE characters at once; a longer text alone
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + len(texts[stop] or "") <= SLICE):
                held += len(texts[stop] or "")
                stop += 1
            h, owner = _windows([t or "" for t in texts[start:stop]])
            maybe = np.logical_and(*[bits[p >> 5] >> (p & 31).astype(np.uint32) & 1 == 1 for p in _places(h)])
            found = pa.table({"o": owner[maybe] + start, "h": h[maybe]}).group_by(["o", "h"]).aggregate([])
            for k in range(0, len(found), 1000):  # each carries its text
                part = found.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*[c.take(part["o"].combine_chunks()) for c in batch.columns], part["h"].combine_chunks()], [*batch.schema.names, "h"])
            start = stop


def survivors(values: DataFrame, outputs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value) of every raw value of 8 characters or more that stands anywhere in any output text.

    Values and texts meet by 8 characters: a value by its first 8, a text by every 8 of its characters that follow each other, hashed in one pass over it.  A
    filter of fixed size over the values' beginnings keeps the others from being shuffled; what meets is compared whole."""
    heads = stored(values.select(F.col("value")).where(F.length("value") >= SURVIVING).distinct().withColumn("h", _head(F.col("value"))), "survivors-values")
    bits = np.full(FILTER_BITS // 32, 0xFFFFFFFF, np.uint32)
    if heads.count() <= FILTER_MOST:
        places = heads.select(F.explode(F.array(*[F.shiftright("h", s).bitwiseAND(FILTER_BITS - 1) for s in (0, 32)])).alias("p"))
        words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b")).toPandas()
        bits[:] = 0
        bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    carried = heads.sparkSession.sparkContext.broadcast(bits)
    texts = outputs.select(key, F.col(text).cast("string").alias(text))
    schema = StructType([*texts.schema.fields, StructField("h", LongType())])
    grams = texts.mapInArrow(lambda it: _suspects(it, carried.value), schema)
    return grams.join(heads, "h").where(F.contains(text, "value")).select(key, "value").distinct()


#: Places of the filter over values: its broadcast has 2 MB, whatever the input.  Values beyond which it would let most windows pass and is left open.
FILTER_BITS, FILTER_MOST = 1 << 24, 1 << 23
#: Characters of texts that are hashed at once.
SLICE = 500_000


def noisy_rules(scored: DataFrame, most: float = 0.05) -> DataFrame:
    """(rule_id, windows, ratio, noisy): noisy where more than ``most`` of all windows fire it."""
    n = scored.agg(F.count("*").alias("__n"))
    hits = scored.select(F.explode("rules.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("windows"))
    ratio = F.col("windows") / F.col("__n")
    return hits.crossJoin(F.broadcast(n)).select("rule_id", "windows", ratio.alias("ratio"), (ratio > most).alias("noisy"))


def clean_windows(scored: DataFrame, noisy: Sequence[str]) -> DataFrame:
    """Windows without collector errors and without a rule that is not noisy."""
    loud = F.exists("rules", lambda r: ~r["rule_id"].isin(*noisy)) if noisy else F.size("rules") > 0
    return scored.where((F.coalesce(F.col("event_collector_error_count"), F.lit(0)) == 0) & ~loud)


def readiness(clean: Column, blockers: Column, warnings: Column, least: int = 1440, full: int = 10080) -> Column:
    """State of a history by its clean windows: insufficient, invalid, preliminary, ready_with_warnings or ready, in this precedence."""
    return F.when(clean < least, "insufficient").when(blockers > 0, "invalid").when(clean < full, "preliminary").when(warnings > 0, "ready_with_warnings").otherwise("ready")


def health_report(metrics: DataFrame, events: DataFrame, scores: DataFrame, alerts: DataFrame, interval: float = 60.0, stale: float = 180.0, now: float | None = None) -> DataFrame:
    """One row on the whole monitoring: records, coverage (at most 1), gaps above 1.5 intervals, the largest gap, age of the latest metric, errors, heartbeats,
    scores with anomalies and ratios, alerts by severity, rules that fired, the reasons of a degraded state and the state.

    metrics has epoch_us, events event_type, scores ratio, is_anomaly and rules, alerts severity; hosts are not told apart.  Times are put in
    order by buckets, each of which knows the last time before it."""
    from behaviorlens.operators.ordering import order_statistics, with_position

    placed = with_position(metrics.where("epoch_us is not null").select("epoch_us"), "epoch_us")
    part = F.floor(F.col("pos") / 100_000)
    ends = placed.groupBy(part.alias("part")).agg(F.max("epoch_us").alias("last"))
    before = ends.select((F.col("part") + 1).alias("part"), F.col("last").alias("before"))
    gap = (F.col("epoch_us") - F.coalesce(F.lag("epoch_us").over(Window.partitionBy("part").orderBy("pos")), "before")) / 1e6
    times = placed.withColumn("part", part).join(before, "part", "left").withColumn("gap", gap)
    m = times.agg(F.count("*").alias("n"), F.min("epoch_us").alias("a"), F.max("epoch_us").alias("b"), F.count_if(F.col("gap") > interval * 1.5).alias("gaps"), F.max("gap").alias("most")).first()
    e = events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "collector_error").alias("errors"), F.count_if(F.col("event_type") == "agent_heartbeat").alias("beats")).first()
    s = scores.agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"), F.max("ratio").alias("most")).first()
    rank = lambda n: [min(n - 1, max(0, round((n - 1) * q))) for q in (0.5, 0.95)]
    p50, p95 = order_statistics(scores, {"r": F.coalesce("ratio", F.lit(0.0))}, rank)["r"] or (None, None)
    counted = lambda df: ",".join(f"{r[0]}:{r[1]}" for r in sorted(tuple(r) for r in df.collect()))  # noqa: E731  few names
    fired = counted(scores.select(F.explode("rules.rule_id").alias("k")).groupBy("k").count())
    severities = counted(alerts.groupBy(F.coalesce("severity", F.lit("unknown")).alias("k")).count())
    seconds = (m["b"] - m["a"]) / 1e6 if m["n"] else 0.0
    covered = min(1.0, m["n"] / (max(1, int(seconds // interval) + 1))) if m["n"] else 0.0
    age = max(0.0, now - m["b"] / 1e6) if m["n"] and now is not None else None
    reasons = [text for text, bad in (
        ("no completed monitoring evidence", not m["n"] or not s["n"]), ("latest metric is stale", age is not None and age > stale),
        ("collector errors were recorded", e["errors"] > 0), ("metric coverage is below 98 percent", covered < 0.98 and m["n"] > 2),
    ) if bad]
    row = (
        m["n"], covered, m["gaps"], m["most"] or 0.0, age, e["n"], e["errors"], e["beats"], s["n"], s["anomalies"], p50, p95, s["most"], fired, severities, "; ".join(reasons), "degraded" if reasons else "healthy",
    )
    return metrics.sparkSession.createDataFrame([row], (
        "records long, coverage double, gap_count long, largest_gap double, latest_age double, events long, collector_errors long, heartbeats long, windows long, anomalies long, "
        "ratio_p50 double, ratio_p95 double, ratio_max double, rule_triggers string, severities string, reasons string, state string"
    ))
