"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns to the system what this process's allocators hold but no object uses.

    Python workers outlive their tasks and share an executor's memory with its JVM.  After encoding 20 MB of text and dropping the encoder a worker
    had 245 MB; 29 MB of them were Arrow's free blocks and 41 MB the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(batches: Iterable) -> Iterator:
    """The batches of a task, which gives memory back at its end."""
    yield from batches
    give_back()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of this machine only where the whole session runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch while a table is written: a worker holds a batch several times over.
BATCH_BYTES = "2m"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut at a table
    that survives the loss of any executor.  Small Arrow batches hold for this write alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(limit, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a membership filter, whatever the input: its broadcast is 1 MB.  A fuller filter lets more through.
FILTER_BITS = 1 << 23
#: Keys that a filter still tells apart from others.
FILTER_MOST = 1 << 23


def _filter_bits(hashed: DataFrame) -> np.ndarray:
    """The bits of a filter over the longs in column h, which are hashes."""
    places = hashed.select(F.explode(F.array(*[F.shiftright("h", s).bitwiseAND(FILTER_BITS - 1) for s in (0, 24)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toPandas()
    bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return bits


def _in_filter(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.ones(len(v), bool)
    for s in (0, 24):
        p = (v >> s) & (32 * len(bits) - 1)
        out &= (bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
    return out


def token_filter(values: DataFrame, column: str):
    """A function on int64 arrays of hashes, for use in tasks: true for all of values[column], and for few others."""
    carried = values.sparkSession.sparkContext.broadcast(_filter_bits(values.select(F.col(column).alias("h"))))
    return lambda v: _in_filter(carried.value, v)


def member_filter(values: DataFrame, *columns: str):
    """A function on columns that is true for every combination of values[columns], and for few others.

    The filter has a fixed size, so it may travel to every task; what it lets through
    is then joined exactly, so it only saves shuffling rows that cannot match."""
    bits = _filter_bits(values.select(F.xxhash64(*columns).alias("h")))
    carried = values.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def member(h: pa.Array) -> pa.Array:
        return pa.array(_in_filter(carried.value, h.to_numpy(zero_copy_only=False)))

    return lambda *cols: member(F.xxhash64(*cols))


def separator(docs: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows of docs whose key (a column of both) is in members, exactly, where docs are wide: only keys are shuffled, while numbers allow.

    A filter of members lets some other keys of docs through; a filter of those lets a few members through, and so on until nothing is
    wrong: what the last filter that a key passes was made of, the key is.  Each filter has the same fixed size.  Of more keys than such
    filters can tell apart, the rows themselves are joined."""
    keys = docs.select(key).where(F.col(key).isNotNull()).distinct().join(members.select(key, F.lit(True).alias("member")), key, "left")
    keys = materialize(keys.select(key, F.coalesce("member", F.lit(False)).alias("member")), "separated-keys")
    now, rest = keys.where("member"), keys.where("not member")
    bits: list[np.ndarray] = []
    while n := now.count():
        if n > FILTER_MOST:
            return docs.join(members, key, "left_semi")
        level = F.xxhash64(key, F.lit(len(bits)))
        bits.append(_filter_bits(now.select(level.alias("h"))))
        passes = _passes(docs.sparkSession.sparkContext.broadcast(bits[-1]))
        now, rest = materialize(rest.where(passes(level)), f"separated-{len(bits)}"), now
    if not bits:
        return docs.join(members, key, "left_semi")
    carried = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def member(hashes: pa.Array) -> pa.Array:
        levels = hashes.flatten().to_numpy(zero_copy_only=False).reshape(len(hashes), -1)
        inside, depth = np.ones(len(hashes), bool), np.zeros(len(hashes), int)
        for k, b in enumerate(carried.value):
            inside &= _in_filter(b, levels[:, k])
            depth += inside
        return pa.array(depth % 2 == 1)

    hashes = F.array(*[F.xxhash64(key, F.lit(k)) for k in range(len(bits))])
    return docs.where(F.col(key).isNotNull()).where(member(hashes))


def _passes(carried):
    @F.arrow_udf("boolean")
    def passes(h: pa.Array) -> pa.Array:
        return pa.array(_in_filter(carried.value, h.to_numpy(zero_copy_only=False)))

    return passes


def dropped(docs: DataFrame, keys: dict[str, Column], gone: DataFrame) -> DataFrame:
    """The rows of docs whose keys, by the names of gone's columns, are no row of gone (nulls are equal); columns of docs may have any name.
    Only rows that pass the filter of gone's rows travel to the exact join."""
    suspect = member_filter(gone, *keys)
    marked = docs.select(F.struct("*").alias("row"), F.struct(*[key.alias(name) for name, key in keys.items()]).alias("key"))
    marked = marked.withColumn("maybe", suspect(*[F.col(f"key.{name}") for name in keys]))
    same = F.lit(True)
    for name in keys:
        same = same & F.col(f"key.{name}").eqNullSafe(gone[name])
    checked = marked.where("maybe").join(gone, same, "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(checked.select("row.*"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the smallest node
    reachable.  Alternates large-star and small-star steps; every round is a table in the shared folder."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = materialize(both, "links")
    mark = None
    while True:
        each = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = each.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = each.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), "large-star")
        discard(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u != v").distinct(), "small-star")
        discard(large)
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
