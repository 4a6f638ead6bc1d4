"""Hard-negative mining by rotated one-bit codes with deterministic intervals.

A vector is turned by several fixed random rotations; the signs of all coordinates are its code.  The code stands for a direction in the
vectors' own space, and with it are stored its length, the vector's norm and the alignment of both.  The product of an anchor with a vector is
its product with that direction, times a stored factor, plus its product with a residual at right angles to the direction.  The first is
estimated by popcounts of the code under the bit planes of the anchor's rotated coordinates, whose rounding error is bounded by its
sum; the second is bounded by Cauchy and Schwarz.  So every score lies in a known interval: only rows whose interval can still reach
the result are scored, in integers.

Anchors meet all rows in blocks of both; the best of every block merge exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import discard, give_back, materialize, table, trimmed

#: Rotations of a vector: one bit of the code for each of them and coordinate.  Bit planes of an anchor's coordinates.
ROTATIONS, PLANES, SEED = 16, 6, 11
#: Rows and anchors that meet in a task, about; anchors whose popcounts are taken at once.
BLOCK_ROWS, BLOCK_ANCHORS, TOGETHER = 4096, 4096, 64
#: Components that 64-bit arithmetic can hold: 100 * length * LARGEST ** 2 stays below 2 ** 63 up to 5000 components.
LARGEST = float(1 << 22)

_CODED = "vec_id long, label long, anchor boolean, vector binary, code binary, norm double, length double, alignment double"


def rotations(dims: int) -> np.ndarray:
    """The stacked rotations, a row for each bit of the code."""
    draw = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(draw.standard_normal((dims, dims)))[0] for _ in range(ROTATIONS)])


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (bytes, in words of 8), norms, lengths of the codes' directions and their alignments with the vectors."""
    positive = vectors @ turn.T >= 0
    direction = np.where(positive, 1.0, -1.0) @ turn
    norm, length = np.sqrt((vectors * vectors).sum(1)), np.sqrt((direction * direction).sum(1))
    both = norm * length
    alignment = np.divide((vectors * direction).sum(1), both, out=np.zeros(len(both)), where=both > 0)
    bits = np.packbits(positive, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))), norm, length, np.clip(alignment, -1.0, 1.0)


def _encode_task(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    turn = rotations(dims)
    for batch in batches:
        lists = batch.column(3)
        vectors = np.zeros((batch.num_rows, dims), np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        vectors[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        code, norm, length, alignment = encode(vectors.astype(float), turn)
        raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (vectors, code)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *raw, pa.array(norm), pa.array(length), pa.array(alignment)], ["vec_id", "label", "anchor", "vector", "code", "norm", "length", "alignment"])


class _Rows:
    """The rows of one block, one for each vec_id (of several the smallest label and vector), by label."""

    def __init__(self, rows: pa.Table):
        ids, label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        matrix = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(len(ids), -1)
        vector = matrix("vector", np.int64)
        order = np.lexsort((label, ids))
        if len(np.unique(ids)) < len(ids):
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], label[i], vector[i].tolist())))
            order = order[np.append(True, np.diff(ids[order]) != 0)]
        order = order[np.argsort(label[order], kind="stable")]
        self.ids, self.label, self.vector = ids[order], label[order], vector[order]
        self.norm, self.length, self.alignment = (rows[name].to_numpy()[order] for name in ("norm", "length", "alignment"))
        self.code = matrix("code", np.uint64)[order]
        self.order = order

    def span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))


def planes(coordinates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated anchors as whole numbers of PLANES bits: their bit planes in words, the step, the sum of the numbers and that of all rounding errors."""
    top = (1 << PLANES) - 1
    step = np.maximum(2 * np.abs(coordinates).max(1) / top, 1e-300)
    number = np.clip(np.rint(coordinates / step[:, None] + top / 2), 0, top).astype(np.uint8)
    error = np.abs(coordinates - step[:, None] * (number - top / 2)).sum(1)
    bits = np.packbits((number[:, None, :] >> np.arange(PLANES)[:, None]) & 1, axis=2, bitorder="little")
    bits = np.pad(bits, ((0, 0), (0, 0), (0, -bits.shape[2] % 8)))
    return np.ascontiguousarray(bits).view(np.uint64), step, number.sum(1, dtype=np.int64).astype(float), error


def intervals(anchors: _Rows, mine: slice, rows: _Rows, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of some anchors with all rows of a block."""
    words, step, total, error = planes(anchors.vector[mine].astype(float) @ turn.T)
    top, bits = (1 << PLANES) - 1, len(turn)
    under = np.zeros((len(step), len(rows.ids)), np.int32)
    for p in range(PLANES):
        plane = np.zeros(under.shape, np.uint16)
        for w in range(words.shape[2]):
            plane += np.bitwise_count(words[:, p, w, None] & rows.code[:, w])
        under += plane.astype(np.int32) << p
    ones = np.bitwise_count(rows.code).sum(1, dtype=np.int64)
    product = step[:, None] * (2 * under - total[:, None] - top / 2 * (2 * ones - bits))  # with the code's direction, up to the error
    factor = np.divide(rows.alignment * rows.norm, rows.length, out=np.zeros(len(rows.ids)), where=rows.length > 0)
    rest = rows.norm * np.sqrt(1 - rows.alignment**2)
    norm = anchors.norm[mine, None]
    along = np.divide(np.maximum(np.abs(product) - error[:, None], 0), rows.length, out=np.zeros_like(product), where=rows.length > 0)
    half = rest * np.sqrt(np.maximum(norm**2 - along**2, 0)) + np.abs(factor) * error[:, None]
    half += 1e-9 * norm * rows.norm + 1e-6  # rounding of these sums themselves
    middle = factor * product
    return middle - half, middle + half


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, -k, axis=1)[:, -k]


def _scores(anchors: _Rows, a: np.ndarray, rows: _Rows, r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", anchors.vector[a[i : i + (1 << 16)]], rows.vector[r[i : i + (1 << 16)]])
    return out


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k best, in order: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(begins, np.diff(begins, append=len(own)))
    return order[rank < k]


def _groups(anchors: _Rows) -> Iterator[tuple[int, slice]]:
    """Runs of at most TOGETHER anchors of one label."""
    for label in np.unique(anchors.label).tolist():
        low, high = anchors.span(label)
        for i in range(low, high, TOGETHER):
            yield label, slice(i, min(i + TOGETHER, high))


def _part(rows: _Rows, keep: np.ndarray) -> _Rows:
    out = object.__new__(_Rows)
    for name in ("ids", "label", "vector", "code", "norm", "length", "alignment"):
        setattr(out, name, getattr(rows, name)[keep])
    return out


def _positives(left: pa.Table, right: pa.Table, turn: np.ndarray, k: int) -> pa.Table:
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    if left.num_rows and right.num_rows:
        rows, anchors = _Rows(left), _Rows(right)
        for label, mine in _groups(anchors):
            same = _part(rows, np.arange(*rows.span(label)))
            if not len(same.ids):
                continue
            low, high = intervals(anchors, mine, same, turn)
            itself = anchors.ids[mine, None] == same.ids
            low[itself] = high[itself] = -np.inf
            a, r = np.nonzero((high >= _kth(low, k)[:, None]) & ~itself)
            score = _scores(anchors, a + mine.start, same, r)
            best = _first(a, score, same.ids[r], k)
            for out, x in zip(found, (anchors.ids[a[best] + mine.start], same.ids[r[best]], score[best]), strict=True):
                out.append(x)
    give_back()
    return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), map(np.concatenate, found), strict=True)))


def _negatives(left: pa.Table, right: pa.Table, turn: np.ndarray, k: int, low_percent: int, high_percent: int) -> pa.Table:
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    if left.num_rows and right.num_rows:
        rows, anchors = _Rows(left), _Rows(right)
        names, scores = (right[c].to_pylist() for c in ("positive_ids", "positive_scores"))
        names, scores = [names[i] for i in anchors.order], [scores[i] for i in anchors.order]
        for label, mine in _groups(anchors):
            begin, stop = rows.span(label)
            others = _part(rows, np.append(np.arange(begin), np.arange(stop, len(rows.ids))))
            if not len(others.ids):
                continue
            low, high = intervals(anchors, mine, others, turn)
            own = scores[mine]
            most = max(map(len, own))
            positive = np.array([s + [0] * (most - len(s)) for s in own], np.int64)
            held = np.array([[i < len(s) for i in range(most)] for s in own])
            wanted = np.zeros(low.shape, bool)
            for i in range(most):
                at_least, at_most = (p * positive[:, i, None] / 100 for p in (low_percent, high_percent))
                sure = (low >= at_least) & (high <= at_most)
                wanted |= held[:, i, None] & (high >= at_least) & (low <= at_most) & (high >= _kth(np.where(sure, low, -np.inf), k)[:, None])
            a, r = np.nonzero(wanted)
            score = _scores(anchors, a + mine.start, others, r)
            for i in range(most):
                base = positive[a, i]
                inside = np.flatnonzero(held[a, i] & (low_percent * base <= 100 * score) & (100 * score <= high_percent * base))
                best = inside[_first(a[inside], score[inside], others.ids[r[inside]], k)]
                anchor = a[best]
                name = np.array([names[mine.start + x][i] for x in anchor.tolist()], np.int64)
                for out, x in zip(found, (anchors.ids[anchor + mine.start], name, others.ids[r[best]], positive[anchor, i], score[best]), strict=True):
                    out.append(x)
    give_back()
    return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), map(np.concatenate, found), strict=True)))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each anchor's first ``negatives`` rows of another label whose score lies
    between the two shares of a positive's score, for each of its ``positives`` best other rows of the same label.

    rows has vec_id, label and vector (whole numbers, array of double); anchor is a condition on it.  A score is the inner product; higher scores come
    first, ties by smaller vec_id.  Rows with a null vec_id, label, vector or component, with a component that is not finite or is 2 ** 22 or more in size, take
    no part.  Of rows that repeat a vec_id the one of the smallest label, then vector, takes part.  Shorter vectors end in zeros.  An anchor
    without positives has no rows; an empty table gives none; other columns are not read.  Anchors meet all rows, in blocks of both."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < LARGEST)))
    dims = max(rows.agg(F.max(F.size("vector"))).first()[0] or 1, 1)
    coded = materialize(rows.withColumn("vector", F.col("vector").cast("array<long>")).mapInArrow(lambda it: trimmed(_encode_task(it, dims)), _CODED), "negatives-coded")
    counted = coded.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    blocks, parts = max(1, -(-counted["n"] // block_rows)), max(1, -(-counted["anchors"] // block_anchors))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = coded.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part")).groupBy("block", "part")
    again = coded.sparkSession.read.schema(coded.schema).parquet(coded.written_to)  # the other side of a cogroup has columns of its own
    asked = again.where("anchor").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int"))

    def met(right: DataFrame, run, schema: str) -> DataFrame:
        return dealt.cogroup(right.select("*", every(blocks).alias("block")).groupBy("block", "part")).applyInArrow(lambda a, b: run(a, b, rotations(dims)), schema)

    first = met(asked, lambda a, b, turn: _positives(a, b, turn, positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    first = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    first = materialize(first.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")), "negatives-positives")
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    second = met(asked.join(first, "vec_id"), lambda a, b, turn: _negatives(a, b, turn, negatives, low_percent, high_percent), schema)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    second = materialize(second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives), "negatives-found")
    discard(coded, first)
    return second.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return mine(rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 50 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 2, 3) = 1),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
              FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3"""
}
