"""Evaluation: confusion metrics, disagreement, detection delay, guards and analyst review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.operators.ordering import with_position

#: Consecutive rows whose runs are told by one task.
RUN_ROWS = 100_000


def confusion(df: DataFrame, actual: Column, predicted: Column, empty: float | None = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, f1, false_positive_rate and accuracy over rows with a label; ratios of nothing are ``empty``."""
    labelled = df.withColumn("__a", actual).withColumn("__p", predicted).where("__a is not null")
    a, p = F.col("__a"), F.col("__p")
    counts = labelled.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn")
    )

    def ratio(up: Column, down: Column) -> Column:
        return F.coalesce(up / F.nullif(down, F.lit(0)), F.lit(empty).cast("double"))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("false_positive_rate", ratio(fp, fp + tn)).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
    )


def method_metrics(df: DataFrame, actual: Column, predicted: Column, empty: float | None) -> DataFrame:
    """One row: windows, anomalies, anomaly_rate and labelled_windows of all rows, and the confusion metrics of those with a label (null if none has)."""
    named = df.select(actual.alias("__a"), predicted.alias("__p"))
    whole = named.agg(
        F.count("*").alias("windows"), F.count_if("__p").alias("anomalies"), F.coalesce(F.count_if("__p") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("anomaly_rate"), F.count("__a").alias("labelled_windows")
    )
    return whole.crossJoin(F.broadcast(confusion(named, F.col("__a"), F.col("__p"), empty)))  # one row each


def clean_rows(df: DataFrame, label: str, normal: str = "normal") -> DataFrame:
    """The rows that ``poisoning_guard`` keeps, or a ValueError if none is left."""
    kept = poisoning_guard(df, label, normal)
    if not kept.take(1):
        raise ValueError("no normal rows remain after labelled attacks are left out")
    return kept


def disagreement(df: DataFrame, model: Column, rules: Column) -> DataFrame:
    """Rows by whether the model and the rules flag them."""
    return df.groupBy(model.alias("model_flag"), rules.alias("rule_flag")).agg(F.count("*").alias("windows"))


def detection_delay(df: DataFrame, attack: Column, hit: Column, key: str, ties: Sequence[str]) -> DataFrame:
    """Maximal runs of attack rows among all rows in the order of (key, ties), whatever their host: place of the first row, length and
    rows until the first hit (null if none).

    Places come from a global order by buckets.  A run is told by the last row before it that is no attack: within a bucket by a running
    maximum, across buckets by the buckets' own maxima, one number each."""
    placed = with_position(df.withColumn("__a", attack).withColumn("__hit", hit), key, ties)
    quiet = F.when(~F.col("__a"), F.col("pos"))
    part = F.floor(F.col("pos") / RUN_ROWS)
    last = placed.groupBy(part.alias("__part")).agg(F.max(quiet).alias("__last"))
    before = last.withColumn("__before", F.max("__last").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", "__before")
    rows = Window.partitionBy("__part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.withColumn("__part", part).join(before, "__part", "left").withColumn("__run", F.coalesce(F.max(quiet).over(rows), "__before", F.lit(-1)))
    found = marked.where("__a").groupBy("__run").agg(F.min("pos").alias("first"), F.count("*").alias("rows"), F.min(F.when(F.col("__hit"), F.col("pos"))).alias("hit"))
    return found.select("first", "rows", (F.col("hit") - F.col("first")).alias("delay"))


def poisoning_guard(df: DataFrame, label: str, normal: str = "normal") -> DataFrame:
    """If any row has a label, only rows labelled normal; else all rows."""
    any_label = df.agg(F.coalesce(F.max(F.col(label).isNotNull()), F.lit(False)).alias("__any"))  # one row
    return df.crossJoin(F.broadcast(any_label)).where(~F.col("__any") | (F.col(label) == normal)).drop("__any")


def merge_reviews(alerts: DataFrame, reviews: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts with the label and note of earlier reviews; 'unreviewed' where there is none."""
    kept = alerts.join(reviews.select(key, "label", "analyst_note"), key, "left")
    return kept.withColumn("label", F.coalesce("label", F.lit("unreviewed"))).withColumn("analyst_note", F.coalesce("analyst_note", F.lit("")))


def unknown_reviews(alerts: DataFrame, reviews: DataFrame, key: str = "alert_id") -> DataFrame:
    """Reviews of alerts that do not exist; a caller refuses these."""
    return reviews.join(alerts.select(key), key, "left_anti")


def review_summary(merged: DataFrame) -> DataFrame:
    """Counts by label and the share of reviewed alerts that were suspicious or confirmed."""
    label = F.col("label")
    positive = F.count_if(label.isin("suspicious", "confirmed_attack"))
    reviewed = F.count_if(label != "unreviewed")
    return merged.agg(
        F.count("*").alias("alerts"), reviewed.alias("reviewed"), *[F.count_if(label == x).alias(x) for x in ("benign", "suspicious", "confirmed_attack")],
        (positive / F.nullif(reviewed, F.lit(0))).alias("alert_precision"),
    )


def reviewed_baseline(windows: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows without a suspicious or confirmed alert."""
    return windows.join(merged.where(F.col("label").isin("suspicious", "confirmed_attack")).select(*keys), list(keys), "left_anti")


def review_selection(windows: DataFrame, merged: DataFrame, keys: Sequence[str], maximum_unreviewed: int = 0) -> DataFrame:
    """One row on a reviewed baseline: windows in, selected and excluded, the review's counts, and whether it is blocked: more alerts without a review
    than allowed, or no window left."""
    counts = windows.agg(F.count("*").alias("input_windows"))
    kept = reviewed_baseline(windows, merged, keys).agg(F.count("*").alias("selected_windows"))
    row = counts.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(review_summary(merged)))  # one row each
    blocked = (F.col("alerts") - F.col("reviewed") > maximum_unreviewed) | (F.col("selected_windows") == 0)
    return row.withColumn("excluded_windows", F.col("input_windows") - F.col("selected_windows")).withColumn("unreviewed", F.col("alerts") - F.col("reviewed")).withColumn("blocked", blocked)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """added, removed or updated entries between two snapshots."""
    old, new = before.select(*keys, F.col(version).alias("old_version")), after.select(*keys, F.col(version).alias("new_version"))
    change = F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed").when(F.col("old_version") != F.col("new_version"), "updated")
    return old.join(new, list(keys), "full_outer").withColumn("change", change).where("change is not null")
