"""Token-id files compressed by Re-Pair grammars.

A file holds shards; a shard holds the ids of consecutive documents.  Frequent
pairs of neighbouring symbols are replaced by nonterminals, the most frequent ones first, until no
pair is frequent any more; none spans a document's end.  Rules and
the lengths of their expansions are stored, so that any document or span is decoded
without the rest.

The bytes of a shard: a magic number and seven counts, then arrays of little-endian
integers (rules, expansion lengths, documents' ids, first tokens, first symbols, the low 16 bits
of the symbols) and the symbols' higher bits, as many as the largest takes.  A table of such shards is the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import materialize, table, trimmed
from behaviorlens.llm.encoding import SLICE, Encoder, slices

MAGIC = b"RPGS"
#: Tokens of a shard, at least.
SHARD_TOKENS = 500_000
#: A pair becomes a rule when it occurs this often in its shard: a rule takes 12 bytes, a pair that it replaces saves two.
FREQUENT = 8
#: Pieces that a task remembers while it encodes.
REMEMBERED = 400_000
#: Buckets in which pairs are counted before they are counted exactly.
BUCKET_BITS = 19


def _places(symbols: np.ndarray, last: np.ndarray, least: int | None, newest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the pairs of at least ``least`` occurrences (a quarter of the most where None), the number of each
    one's pair, the pairs, and the count that was asked for.  No pair spans a document's end.  Where newest is given, only pairs
    that hold a symbol from it on can be that frequent."""
    a, b, ends = symbols[:-1], symbols[1:], last[:-1]
    at = None
    if newest is not None:
        recent = symbols >= newest
        at = np.flatnonzero(recent[:-1] | recent[1:])
        a, b, ends = a[at], b[at], ends[at]
    bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + (b >> np.uint32(7)))) >> np.uint32(32 - BUCKET_BITS)
    bucket[ends] = 1 << BUCKET_BITS
    counts = np.bincount(bucket, minlength=(1 << BUCKET_BITS) + 1)  # of a pair's bucket, so never less than the pair's
    counts[-1] = 0
    least = least or max(FREQUENT, int(counts.max()) // 4)
    likely = np.flatnonzero((counts >= least)[bucket])
    a, b = a[likely], b[likely]
    at = likely if at is None else at[likely]
    pairs, kind, n = np.unique((a.astype(np.uint64) << np.uint64(32)) | b, return_inverse=True, return_counts=True)
    often = n >= least
    own = often[kind]
    return at[own], (np.cumsum(often) - 1)[kind[own]], pairs[often], least


def _replace_pairs(symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, last and rules after pairs were replaced until none is frequent.

    Pairs go from the most frequent down: a round replaces all pairs above a count that falls to a quarter
    from round to round.  Where pairs overlap, every other one is replaced; a pair that keeps fewer than FREQUENT
    places that way makes no rule."""
    base = max(int(symbols.max(initial=0)) + 1, 1)
    rules = [np.zeros(0, np.uint64)]
    made, least, newest = 0, None, None
    while True:
        at, kind, pairs, least = _places(symbols, last, least, newest)
        begins = np.ones(len(at), bool)
        begins[1:] = np.diff(at) > 1
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - run) % 2 == 0
        at, kind = at[chosen], kind[chosen]
        kept = np.bincount(kind, minlength=len(pairs)) >= FREQUENT
        at, kind = at[kept[kind]], (np.cumsum(kept) - 1)[kind[kept[kind]]]
        newest = base + made if least == FREQUENT else None
        if len(at):
            symbols[at] = base + made + kind
            last[at] = last[at + 1]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, last = symbols[stay], last[stay]
            rules.append(pairs[kept])
            made += int(kept.sum())
        elif least == FREQUENT:
            break
        least = max(FREQUENT, least // 4)
    pairs = np.concatenate(rules)
    return symbols, last, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def compress(doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one shard."""
    base = max(int(ids.max(initial=0)) + 1, 1)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, last, rules = _replace_pairs(ids.astype(np.uint32), last)
    lengths = np.ones(base + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[base + k] = lengths[a] + lengths[b]
    ends = np.flatnonzero(last) + 1
    more = next(bits for bits in (0, 1, 2, 4, 8, 16) if (base + len(rules) - 1) >> 16 < 1 << bits)
    first_symbol = np.concatenate([[0], ends]).astype("<i8")
    first_token = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    high = ((symbols >> 16)[:, None] >> np.arange(more, dtype=np.uint32) & 1).astype(bool)
    return b"".join([
        MAGIC, struct.pack("<7q", base, len(rules), len(sizes), len(symbols), more, len(ids), 0),
        rules.astype("<u4").tobytes(), lengths[base:].astype("<u4").tobytes(), np.array(doc_ids, "<i8").tobytes(),
        first_token.tobytes(), first_symbol.tobytes(), (symbols & 0xFFFF).astype("<u2").tobytes(), np.packbits(high).tobytes(),
    ])


class Shard:
    """Reads one shard's bytes; decodes all of it, one document, or a span of a document."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.base, n_rules, n_docs, n_symbols, more, self.tokens, _ = struct.unpack_from("<7q", data, 4)
        at = 4 + 56

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", n_rules)
        self.doc_ids = take("<i8", n_docs)
        self.first_token = take("<i8", n_docs + 1)
        self.first_symbol = take("<i8", n_docs + 1)
        self.symbols = take("<u2", n_symbols).astype(np.uint32)
        if more:
            high = np.unpackbits(take("u1", -(-n_symbols * more // 8)), count=n_symbols * more).reshape(-1, more)
            for k in range(more):
                self.symbols |= high[:, k].astype(np.uint32) << np.uint32(16 + k)
        # The expansions one after the other; symbol s spans flat[begin[s] : begin[s] + length[s]].
        self.length = np.concatenate([np.ones(self.base, np.int64), self.rule_lengths.astype(np.int64)])
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.zeros(int(self.length.sum()), np.uint32)
        self.flat[: self.base] = np.arange(self.base)
        for k, (a, b) in enumerate(self.rules.tolist()):
            s, n, m = self.begin[self.base + k], self.length[a], self.length[b]
            self.flat[s : s + n] = self.flat[self.begin[a] : self.begin[a] + n]
            self.flat[s + n : s + n + m] = self.flat[self.begin[b] : self.begin[b] + m]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        sizes = self.length[symbols]
        stop = np.cumsum(sizes)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(self.begin[symbols] - stop + sizes, sizes) + np.arange(total)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]])

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of document k; only the symbols that cover them are expanded."""
        own = self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]].astype(np.int64)
        ends = np.cumsum(self.length[own])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[start - before : stop - before]


def _write_task(batches: Iterable[pa.RecordBatch], path: str, end: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    docs: list[int] = []
    total = made = before = 0
    encoder = Encoder(path, REMEMBERED)  # lives as long as the task: workers that wait hold no pieces

    def shard() -> pa.RecordBatch:
        data = compress(docs, np.concatenate(sizes), np.concatenate(ids))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([total], pa.int64()), pa.array([before], pa.int64()), pa.array([data], pa.binary())],
            ["part", "shard", "n_tokens", "before", "data"],
        )

    for batch in batches:
        names = pc.fill_null(batch.column(0), -(1 << 63)).to_pylist()
        for first, stop in slices(batch.column(1), min(SLICE, 4 * shard_tokens)):
            found, size = encoder.encode(batch.column(1).slice(first, stop - first))
            ids.append(np.insert(found, np.cumsum(size), end))
            sizes.append(size + 1)
            docs += names[first:stop]
            total += len(ids[-1])
            if total >= shard_tokens:
                yield shard()
                before += total
                ids, sizes, docs, total, made = [], [], [], 0, made + 1
    if docs:
        yield shard()


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, append end_id to each document, compress, and write shards in ascending doc_id order.

    Returns the written table (part, shard, n_tokens, before, data) read back from the shared
    folder; (part, shard) ascends with doc_id.  A null or empty text is the end id alone.  Null
    ids come first.  Rows that repeat a doc_id stay documents of their own, in no set
    order.  A very long document stays whole in its shard.  An empty table writes no shard.
    Other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = plain.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    shards = ordered.mapInArrow(
        lambda it: trimmed(_write_task(it, tokenizer, end_id, shard_tokens)), "part int, shard int, n_tokens long, before long, data binary"
    )
    return materialize(shards, "tokens")


def _read_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(data.as_py())
            ids = shard.expand(shard.symbols).astype("<u4")
            offsets = pa.array(shard.first_token * 4, pa.int64())
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shard.doc_ids), [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
            doc = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == -(1 << 63))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(shard.first_token[:-1] + begin, pa.int64()), pa.array(np.diff(shard.first_token), pa.int64()), blobs.cast(pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens and ids (little-endian
    unsigned 32-bit) of every document of a written table.  The driver sees one number for each
    writing task; where a shard begins within its task's part is stored beside it."""
    spark = shards.sparkSession
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in parts):
        starts.append((part, total))
        total += n
    begins = F.broadcast(spark.createDataFrame(starts, "part int, begin long"))
    return shards.join(begins, "part").select((F.col("begin") + F.col("before")).alias("begin"), "data").mapInArrow(
        lambda it: trimmed(_read_task(it)), "doc_id long, start long, n_tokens long, ids binary"
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    written = write_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return materialize(read_tokens(written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-rows")


QUERIES = {"op2_token_store": op2_token_store}
