"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary per partition finds the digests that may hold a large
share of all rows.  Their exact counts and winners are few by construction, so
they are broadcast and their rows never enter a shuffle.  All other digests are
grouped by an ordinary shuffle, in which no key holds more than ``share`` of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import materialize, table

#: A digest with at least this share of all rows counts as heavy.
SHARE = 0.001
#: ASCII white space, collapsed before texts are compared.
SPACES = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 in hex of the text with each run of white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def misra_gries(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """At most k counters over the column 'digest'.  A counter understates its
    digest by at most rows / (k + 1), and every digest above that share has one."""
    counters: Counter = Counter()
    for batch in batches:
        counters.update(batch.column("digest").to_pylist())
        if len(counters) > k:
            cut = sorted(counters.values(), reverse=True)[k]
            counters = Counter({d: n - cut for d, n in counters.items() if n > cut})
    yield pa.RecordBatch.from_pydict(
        {"digest": pa.array(list(counters), pa.string()), "seen": pa.array(list(counters.values()), pa.int64())}
    )


def heavy_winners(digests: DataFrame, share: float = SHARE) -> DataFrame:
    """(digest, keep_id, group_size) of each digest with at least ``share`` of the
    rows: at most 1 / share rows, whatever the input size."""
    k = int(4 / share)
    total = digests.count()
    # Summed counters understate by at most total / (k + 1), so the candidates hold every heavy digest.
    candidates = (
        digests.select("digest")
        .mapInArrow(lambda it: misra_gries(it, k), "digest string, seen long")
        .groupBy("digest").agg(F.sum("seen").alias("seen"))
        .where(F.col("seen") >= share * total - total / (k + 1))
        .select("digest")
    )
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= F.lit(share) * total)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Group rows of equal text and keep the row with the smallest id.

    One output row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    A null text counts as empty, so null and empty texts form one group.  Rows that
    repeat one id with one text are the same document: each counts in group_size, and
    all are kept if that id is the smallest.  A null id is never the smallest; a group
    of null ids alone has a null keep_id and keeps all its rows.  An empty table gives
    an empty result.  Other columns of the input are not read.
    """
    digests = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests"
    )
    heavy = materialize(heavy_winners(digests, share), "heavy")
    frequent = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return (
        frequent.select(columns).unionByName(rest.join(groups, "digest").select(columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .withColumnRenamed("digest", "text_sha256")
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)"""
}
