"""Scoring on the stream: duplicates removed, whole combined windows, the model and the rules, two sinks, and the replay of files to their last window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.operators.detectors import Autoencoder
from behaviorlens.operators.rules import fuse
from behaviorlens.operators.windows import COUNTS, DISTINCTS, EVENT_TYPES


#: The host of the rows that close a replay.
CLOSING = "\0closing"


def stream_combined(metrics: DataFrame, events: DataFrame, features: Sequence[str], seconds: int, delay: str = "60 seconds") -> DataFrame:
    """Completed windows as ``combined_windows`` gives them in a batch: means of the metrics, counts, distinct names and the total of the events.

    metrics has event_id, host, ts and the features; events event_id, host, ts, event_type, process_name, user_name and remote.  A row whose event_id came before goes, as
    long as the watermark has not passed the first one's end; rows without an id are told by host and time.  The ids of metrics and events must differ.
    State: one row a host and window with its distinct names, and the ids of the watermark's span."""
    host = F.coalesce(F.nullif(F.col("host"), F.lit("")), F.lit("unknown"))
    text = lambda c: F.lit(None).cast("string").alias(c)
    identity = lambda kind: F.coalesce(F.col("event_id").cast("string"), F.concat_ws("\x1f", F.lit(kind), "host", F.col("ts").cast("string"))).alias("event_id")
    names = [c for c, _ in DISTINCTS.values()]
    value = [F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)).alias(f) for f in features]
    left = metrics.select(identity("metric"), host.alias("host"), "ts", F.lit(True).alias("metric"), *value, text("event_type"), *map(text, names))
    right = events.select(identity("event"), host.alias("host"), "ts", F.lit(False).alias("metric"), *[F.lit(None).cast("double").alias(f) for f in features], "event_type", *names)
    rows = left.unionByName(right).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    counted = F.col("event_type").isin(*EVENT_TYPES)
    counts = [F.count_if(F.col("event_type") == t).alias(c) for t, c in zip(EVENT_TYPES, COUNTS, strict=True)]
    distinct = [F.size(F.collect_set(F.when(counted & ~F.col(c).isin(*out), F.col(c)))).cast("long").alias(k) for k, (c, out) in DISTINCTS.items()]
    means = [(F.sum(f) / F.count_if("metric")).alias(f) for f in features]
    found = rows.groupBy("host", F.window("ts", f"{seconds} seconds")).agg(F.count_if("metric").alias("metric_sample_count"), *means, *counts, *distinct, F.count_if(counted).alias("event_total_count"))
    ids = [c for c in found.columns if c not in ("host", "window")]
    return found.where("metric_sample_count > 0").select("host", F.unix_seconds("window.start").alias("window_start"), *ids)


def scored(windows: DataFrame, model: Autoencoder, thresholds: Mapping[str, int] | None = None) -> DataFrame:
    """Windows with the model's error, ratio and top features, the rules, the fused ratio and severity; the same on a stream and in a batch."""
    return fuse(model.apply(windows), F.col("model_ratio"), thresholds)


def write_scores(scores: DataFrame, folder: str) -> None:
    """Run a stream of scores until its input ends: each trigger writes all its windows to folder/scores and the anomalous ones to folder/alerts.

    A trigger that runs again after a failure writes its own parts again, so each window stands once in either sink."""

    def both(batch: DataFrame, number: int) -> None:
        own = f"{folder}/scores/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        batch.sparkSession.read.schema(batch.schema).parquet(own).where("is_anomaly").write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")

    scores.writeStream.foreachBatch(both).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replay(spark: SparkSession, files: str, build: Callable[[DataFrame], DataFrame], folder: str, close_after: int) -> tuple[DataFrame, DataFrame]:
    """(scores, alerts) of Parquet files replayed as a stream, without the windows that stay open where a stream ends: when all files are read, a row
    ``close_after`` seconds (more than a window and the delay) behind the last one moves the watermark past them.  That row's own window is no result; build keeps the column host.

    Files come in the order of their change times; a row behind the watermark of an earlier trigger is late and goes, as on a live stream.
    A replay that was stopped goes on from its state in the folder."""
    schema = spark.read.parquet(files).schema
    marks = f"{folder}/marks"
    spark.createDataFrame([], schema).write.mode("append").parquet(marks)
    stream = lambda path: spark.readStream.schema(schema).parquet(path)
    scores = build(stream(files).unionByName(stream(marks))).where(F.col("host") != CLOSING)
    write_scores(scores, folder)
    last = spark.read.parquet(files).agg((F.max("ts") + F.make_dt_interval(secs=F.lit(close_after))).alias("ts"))  # one row
    rest = [F.lit(CLOSING if f.name == "host" else None).cast(f.dataType).alias(f.name) for f in schema if f.name != "ts"]
    last.where("ts is not null").select("ts", *rest).select(*schema.names).write.mode("append").parquet(marks)
    write_scores(scores, folder)
    read = lambda name: spark.read.schema(scores.schema).parquet(f"{folder}/{name}")
    return read("scores"), read("alerts")
