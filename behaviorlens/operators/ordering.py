"""Global positions, exact order statistics, splits and samples without a single-task sort.

Rows are dealt to buckets by bounds that are literals of the plan, so that a row's bucket is a
function of its value; bucket counts, one row a bucket, give each bucket's first position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.sources.store import discard, stored

#: Buckets of a global order.
BUCKETS = 64
#: Values of a range that are read whole; a range of more is cut again.  Bits of a digit.
COUNTED, DIGIT_BITS = 20_000, 12


def with_position(df: DataFrame, key: str, ties: Sequence[str] = (), name: str = "pos", buckets: int = BUCKETS) -> DataFrame:
    """df with the 0-based position of each row in the order of (key, ties); key is numeric."""
    cuts = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col(key).cast("double") > c).cast("int")
    dealt = df.withColumn("__bucket", bucket)
    total, first = 0, []
    for row in dealt.groupBy("__bucket").count().orderBy("__bucket").collect():
        first += [F.lit(row["__bucket"]), F.lit(total)]
        total += row["count"]
    start = F.element_at(F.create_map(*first), F.col("__bucket")) if first else F.lit(0)
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(key, *ties)) - 1
    return dealt.withColumn(name, (within + start).cast("long")).drop("__bucket")


def nearest_rank(n: Column, q: float) -> Column:
    """0-based rank round((n - 1) q), halves to even, within the rows."""
    return F.greatest(F.lit(0), F.least(n - 1, F.rint((n - 1) * F.lit(q)).cast("long")))


def quantiles_by(df: DataFrame, group: str, value: str, qs: dict[str, float], nulls: bool = False) -> DataFrame:
    """Nearest-rank quantiles of value in each group; an empty group gives 0, or null if nulls."""
    order = Window.partitionBy(group).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(
        group, value, (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy(group)).alias("n")
    )
    empty = F.lit(None).cast("double") if nulls else F.lit(0.0)
    return ranked.groupBy(group).agg(
        F.first("n").alias("n"), *[F.coalesce(F.max(F.when(F.col("r") == nearest_rank(F.col("n"), q), F.col(value))), empty).alias(k) for k, q in qs.items()]
    )


def _sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _digits_task(batches: Iterable[pa.RecordBatch], open_: Sequence[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """How many values of each open range begin with each next digit; a range is a column and the bits that its values begin with."""
    counts = np.zeros((len(open_), 1 << DIGIT_BITS), np.int64)
    for batch in batches:
        keys = {}
        for n, (i, known, prefix) in enumerate(open_):
            if i not in keys:
                keys[i] = _sortable(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
            own = keys[i] if not known else keys[i][keys[i] >> np.uint64(64 - known) == np.uint64(prefix)]
            digit = own >> np.uint64(64 - known - DIGIT_BITS) & np.uint64((1 << DIGIT_BITS) - 1)
            counts[n] += np.bincount(digit.astype(np.int64), minlength=1 << DIGIT_BITS)
    n, digit = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(digit), pa.array(counts[n, digit])], ["range", "digit", "count"])


def _values_task(batches: Iterable[pa.RecordBatch], wanted: Sequence[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The distinct values of each wanted range and how often each occurs."""
    for batch in batches:
        for n, (i, known, prefix) in enumerate(wanted):
            values = batch.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0
            own, counts = np.unique(values[_sortable(values) >> np.uint64(64 - known) == np.uint64(prefix)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n)), pa.array(own), pa.array(counts)], ["range", "value", "count"])


def order_statistics(df: DataFrame, values: Mapping[str, Column], ranks: Callable[[int], Sequence[int]]) -> dict[str, list[float]]:
    """Of each named value, what stands at the ranks that ranks(n) asks for among its n rows that are not null, exactly; [] for no rows.

    A selection by digits: one pass over all values at once counts how they begin, by sign, exponent and so on down their bits, and keeps for every
    rank the range of values it lies in; ranges of few values are then read whole.  Two passes do for small tables and at most six for any; no task
    sorts, and the driver gets counts by range and digit only.  The values are written once, so that what made them runs once."""
    rows = stored(df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())]), "order-statistics")
    names = list(values)

    def counted(ranges: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
        found = rows.mapInArrow(lambda it: _digits_task(it, ranges), "range long, digit long, count long").groupBy("range", "digit").agg(F.sum("count").alias("count"))
        out: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(tuple(r) for r in found.collect()):
            out.setdefault(r[0], []).append((r[1], r[2]))
        return out

    ranges = [(i, 0, 0) for i in range(len(names))]
    counts = counted(ranges)
    wanted = {i: list(ranks(sum(c for _, c in counts.get(i, [])))) if counts.get(i) else [] for i in range(len(names))}
    # Each rank's range so far, and its rank within that range.
    at = {(i, rank): ((i, 0, 0), rank) for i in wanted for rank in wanted[i]}
    few: dict[tuple[int, int], tuple[tuple[int, int, int], int]] = {}
    while at:
        deeper = {}
        for key, (range_, rank) in at.items():
            i, known, prefix = range_
            for digit, count in counts[ranges.index(range_)]:
                if rank < count:
                    break
                rank -= count
            inside = (i, known + DIGIT_BITS, prefix << DIGIT_BITS | digit), rank
            (few if count <= COUNTED or known + 2 * DIGIT_BITS > 60 else deeper)[key] = inside
        at, ranges = deeper, sorted({r for r, _ in deeper.values()})
        counts = counted(ranges) if at else {}
    asked = sorted({r for r, _ in few.values()})
    held: dict[int, list[tuple[float, int]]] = {}
    if asked:
        found = rows.mapInArrow(lambda it: _values_task(it, asked), "range long, value double, count long").groupBy("range", "value").agg(F.sum("count").alias("count"))
        for r in sorted(tuple(r) for r in found.collect()):
            held.setdefault(r[0], []).append((r[1], r[2]))
    discard(rows)
    out = {}
    for key, (range_, rank) in few.items():
        for value, count in held[asked.index(range_)]:
            if rank < count:
                break
            rank -= count
        out[key] = value
    return {name: [out[i, rank] for rank in wanted[i]] for i, name in enumerate(names)}


def middle(n: int) -> list[int]:
    """The ranks whose mean is the true median."""
    return [(n - 1) // 2, n // 2]


def order_statistic(df: DataFrame, value: str, q: float) -> float:
    """The nearest-rank quantile of a whole column, exactly; 0 for no rows."""
    found = order_statistics(df, {"v": F.col(value)}, lambda n: [min(max(round((n - 1) * q), 0), n - 1)])["v"]
    return found[0] if found else 0.0


def chronological_split(df: DataFrame, key: str, ties: Sequence[str], formula: str = "sizes") -> DataFrame:
    """df with split train / validation / test in time order.

    'sizes': validation and test have max(1, int(.15 n)) rows each, all are train below three rows;
    'cuts': cuts at int(.70 n) and int(.85 n)."""
    n = df.count()
    if formula == "sizes":
        part = max(1, int(n * 0.15)) if n >= 3 else 0
        first, second = n - 2 * part, n - part
    else:
        first, second = int(n * 0.70), int(n * 0.85)
    pos = F.col("pos")
    return with_position(df, key, ties).withColumn("split", F.when(pos < first, "train").when(pos < second, "validation").otherwise("test"))


def systematic_sample(df: DataFrame, key: str, ties: Sequence[str], most: int = 480) -> DataFrame:
    """Every (n // most)-th row and the last, of which the last ``most`` stay."""
    n = df.count()
    step = max(1, n // most)
    pos = F.col("pos")
    taken = with_position(df, key, ties).where((pos % step == 0) | (pos == n - 1))
    chosen = (n - 1) // step + 1 + ((n - 1) % step != 0) if n else 0
    skip = max(0, chosen - most)
    return taken.where(pos >= skip * step)
