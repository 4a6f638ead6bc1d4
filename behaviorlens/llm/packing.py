"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task encodes its documents and fills shards of a fixed number of windows.
Whole windows are cut from long documents; what remains of each document is an item
of the shard's differencing, and some remainders are cut into small pieces that even
out the windows.  No shuffle is needed and a task holds one shard at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import give_back, materialize, table, trimmed
from behaviorlens.llm.encoding import REMEMBERED, SLICE, Encoder, slices

#: Tokens of a window.
CAPACITY = 1024
#: Windows of a shard, as planned before differencing.
WINDOWS = 48
#: Share of a shard's tokens that is cut into small pieces, and the pieces' sizes.
FILLER, SMALL = 0.03, (32, 16, 8, 4, 2, 1)
#: Pieces of an Arrow batch, of at most 4 KB of ids each: the task holds a batch several times over, the JVM once more.
ROWS = 256
#: Bytes of text after which a task gives back what its allocators keep of earlier slices.
KEPT_BYTES = 4 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by merging the two partial partitions of the largest
    spread, largest windows of one onto smallest of the other, until one is left."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    # A node is (left, right, slots of left, slots of right); items are the first nodes.
    left, right, slots = [], [], []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads = np.zeros(windows, np.int64)
        loads[-1] = s
        heap.append((-s if windows > 1 else 0, i, loads))
    heapq.heapify(heap)
    node = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        loads = x + y[::-1]  # both ascend
        order = np.argsort(loads, kind="stable")
        loads = loads[order]
        left.append(a)
        right.append(b)
        slots.append(order)
        heapq.heappush(heap, (int(loads[0] - loads[-1]), node, loads))
        node += 1
    where: dict[int, np.ndarray] = {node - 1: np.arange(windows)}
    out = np.zeros(len(sizes), np.int64)
    for k in range(node - 1, -1, -1):
        place = where.pop(k)
        if k < len(sizes):
            out[k] = place[-1]
            continue
        j = k - len(sizes)
        inverse = np.empty(windows, np.int64)
        inverse[slots[j]] = np.arange(windows)  # where each slot of the left went
        where[left[j]] = place[inverse]
        where[right[j]] = place[inverse[::-1]]
    return out


def pack_items(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows by differencing; one more window is tried whenever one would exceed the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, windows)
        if not len(sizes) or np.bincount(found, sizes, windows).max() <= capacity:
            return found
        windows += 1


class Shards:
    """Gathers documents' ids and yields rows of pieces, shard by shard."""

    def __init__(self, capacity: int, windows: int, base: int):
        self.capacity, self.limit, self.next = capacity, windows * (capacity - 1), base
        self.items: list[tuple[int, int, int, int, bytes]] = []  # doc, start, length, doc tokens, ids
        self.total = self.small = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, cap, data = len(ids), self.capacity, ids.tobytes()
        whole = n - n % cap
        for start in range(0, whole, cap):
            self.rows.append((doc, start, cap, n, self.next, 0, data[4 * start : 4 * (start + cap)]))
            self.next += 1
        filler = self.small <= FILLER * self.total
        start, k = whole, 0
        while start < n:
            size = n - start
            if filler:
                size = min(size, SMALL[k % len(SMALL)])
                k += 1
            size = min(size, self.limit - self.total)
            self.items.append((doc, start, size, n, data[4 * start : 4 * (start + size)]))
            self.total += size
            self.small += size if filler else 0
            start += size
            if self.total >= self.limit:
                self.close()

    def close(self) -> None:
        """Difference the shard's items into windows."""
        sizes = np.array([x[2] for x in self.items], np.int64)
        found = pack_items(sizes, self.capacity)
        _, found = np.unique(found, return_inverse=True)  # gapless
        offsets: dict[int, int] = {}
        for (doc, start, size, n, data), w in zip(self.items, found.tolist(), strict=True):
            at = offsets.get(w, 0)
            self.rows.append((doc, start, size, n, self.next + w, at, data))
            offsets[w] = at + size
        self.next += len(offsets)
        self.items, self.total, self.small = [], 0, 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The rows so far, in batches of at most ``ROWS``, however many a long document or a shard has."""
        rows, self.rows = self.rows, []
        long = pa.int64()
        for k in range(0, len(rows), ROWS):
            doc, start, size, n, seq, at, data = zip(*rows[k : k + ROWS], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, long), pa.array(start, long), pa.array(size, long), pa.array(n, long), pa.array(seq, long), pa.array(at, long), pa.array(data, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )


def _pack_task(
    batches: Iterable[pa.RecordBatch], path: str, end: int, capacity: int, windows: int, remembered: int, slice_bytes: int
) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    shards = Shards(capacity, windows, (context.partitionId() if context else 0) << 40)
    encoder = Encoder(path, remembered)  # lives as long as the task: workers that wait hold no pieces
    read = 0
    for batch in batches:
        for first, stop in slices(batch.column(1), slice_bytes):
            read += slice_bytes
            if read >= KEPT_BYTES:
                give_back()
                read = 0
            ids, sizes = encoder.encode(batch.column(1).slice(first, stop - first))
            ids = np.insert(ids, np.cumsum(sizes), end).astype("<u4", copy=False)
            ends = np.cumsum(sizes + 1).tolist()
            for doc, start, n in zip(batch.column(0).slice(first, stop - first).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                shards.add(doc, ids[start:n])
                if len(shards.rows) >= ROWS:
                    yield from shards.batches()
    shards.close()
    yield from shards.batches()


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, windows: int = WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, slice_bytes: int = SLICE,
) -> DataFrame:
    """Pack every document's ids, with end_id after each, into windows of at most ``capacity`` tokens.

    A task remembers the ids of so many pieces and encodes slices of about slice_bytes; both only weigh time against memory.

    Returns the pieces: doc_id, start, length, doc_tokens, sequence_id, offset, and ids
    (little-endian unsigned 32-bit).  The pieces of a document cover its ids once.
    A null or empty text is the end id alone.  Rows that repeat a doc_id, with a null one
    too, are packed as documents of their own.  A very long text fills whole windows.  An empty table gives no
    pieces.  Other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: trimmed(_pack_task(it, tokenizer, end_id, capacity, windows, remembered, slice_bytes)), PIECES
    )


def packed(docs: DataFrame, remembered: int = REMEMBERED, slice_bytes: int = SLICE) -> DataFrame:
    """The pieces with a checksum in place of their ids, written and read back."""
    import public_tokenizers

    pieces = pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), remembered=remembered, slice_bytes=slice_bytes)
    return materialize(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"), "pieces")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pack": op7_pack}
