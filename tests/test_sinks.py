"""Sinks for reports and review rows, manifests, and times that must name their zone."""

import hashlib
import json

from pyspark.sql import functions as F

from behaviorlens.functions import columns as fn
from behaviorlens.sources import files


def test_csv_report_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y", z', None), ("b", "", "n")], "id string, text string, note string").coalesce(1)
    files.write_csv(rows, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_text() == 'id,text,note\na,"x ""y"", z",\nb,,n\n'
    files.write_report(spark.sql("select 2 as b, cast(null as int) as a"), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*.json")
    assert json.loads(part.read_text()) == {"a": None, "b": 2}
    source = tmp_path / "in.txt"
    source.write_text("one\ntwo\n")
    found = files.dataset_manifest(str(source), spark.range(2), spark.range(1), "d", {"licence": "l"}).collect()
    assert [(r["dataset"], r["licence"], r["bytes"], r["input_sha256"], r["source_rows"], r["normalized_rows"]) for r in found] == [("d", "l", 8, hashlib.sha256(source.read_bytes()).hexdigest(), 2, 1)]


def test_times_with_zones(spark):
    cases = {"2024-01-01T01:00:00+01:00": "2024-01-01T00:00:00.000000Z", "2024-01-01T00:00:00.5Z": "2024-01-01T00:00:00.500000Z", "2024-01-01T00:00:00": None, "2024-01-01": None, "soon": None, "2024-99-01T00:00:00Z": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", fn.iso_micros(F.col("t")).alias("o")).collect()} == cases
