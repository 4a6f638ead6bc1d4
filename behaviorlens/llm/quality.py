"""Quality classifier: interpolated modified Kneser-Ney character model of trusted text.

The model is counted and smoothed with sharded Spark joins over the n-gram tables of all
trusted rows.  Every document gets its perplexity, and a document is rejected above a quantile of
its own language's trusted documents, all of them: each is measured for that by a model of the half that it is not in.
The two halves' models are further columns of the same tables.

Documents meet the model's tables in joins as well.  Their symbols are first gathered in
chunks of bounded size; a chunk's distinct n-grams, a small share of its characters, are what is
shuffled: joined with the tables of all orders, they come back to their chunk with their
log probabilities, and each document's are summed there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import dropped, give_back, materialize, separator, table, trimmed

ORDER = 4
#: Bits of a symbol: a character's code point; code points above them share the surrogates' places, which no text holds.
BITS = 16
#: Symbols of their own: a text's border, and the first character of a word that repeats the word before it.
BORDER, REPEAT = 1, 2
#: Documents above this quantile of their language's trusted documents are rejected.
QUANTILE = 0.995
#: Digits to which cross-entropies are compared, so that a language has a bounded number of values.
DIGITS = 4
#: Characters of ordinary text that each document's mean is shrunk by, so that a few words do not decide.
SHRINK = 40
#: Characters of a chunk, about, and of a slice that is worked on at a time; a longer text is a chunk or slice of its own.
CHUNK, SLICE = 8_000_000, 500_000

_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 62, 64)  # of a word's characters in its hash


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after ORDER - 1 borders, and the texts' sizes."""
    border = chr(BORDER) * (ORDER - 1)
    raw = np.frombuffer((border + border.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.where(raw > 0xFFFF, 0xD800 | (raw & 0x7FF), raw).astype(np.uint16)
    gap = raw <= 32
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1  # words' first characters
    if len(first) > 1:
        at = np.arange(len(raw)) - np.maximum.accumulate(np.where(gap, np.arange(len(raw)), 0))
        words = np.add.reduceat(np.where(gap, 0, (raw.astype(np.int64) + 7) * _WEIGHTS[np.minimum(at, 63)]), first)
        text = np.searchsorted(np.cumsum(sizes + ORDER - 1), first, "right")
        symbols[first[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])]] = REPEAT
    return symbols, sizes


def _grams(symbols: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each position from ORDER - 1 on, as one integer."""
    out = np.zeros(max(0, len(symbols) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(BITS)) | symbols[k : len(symbols) - ORDER + 1 + k]
    return out.view(np.int64)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of texts (column 0), and how often they occur in texts of half 0 and half 1 (column 1)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        half = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for a, b in _slices(np.array([len(t) for t in texts]), SLICE):
            symbols, sizes = _symbols(texts[a:b])
            room = sizes + ORDER - 1
            inside = np.arange(len(symbols)) - np.repeat(np.cumsum(room) - room, room) >= ORDER - 1
            inside, second = inside[ORDER - 1 :], np.repeat(half[a:b], room)[ORDER - 1 :] > 0
            found, own = np.unique(_grams(symbols)[inside], return_inverse=True)
            n1 = np.bincount(own[second[inside]], minlength=len(found))
            n0 = np.bincount(own, minlength=len(found)) - n1
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n0), pa.array(n1)], ["gram", "n0", "n1"])


def _discounts(counts: DataFrame, models: int) -> list[tuple[float, float, float]]:
    """Chen and Goodman's three discounts of each model from the counts of counts."""
    row = counts.agg(*[F.sum((F.col(f"n{m}") == k).cast("long")) for m in range(models) for k in (1, 2, 3, 4)]).first()
    found = []
    for m in range(models):
        n1, n2, n3, n4 = (float(x or 0) for x in row[4 * m : 4 * m + 4])
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            found.append(tuple(min(max(k - (k + 1) * y * x / n, 0.05), k - 0.05) for k, n, x in ((1, n1, n2), (2, n2, n3), (3, n3, n4))))
        else:
            found.append((0.5, 0.75, 0.9))
    return found


def _suffix(gram: Column, order: int) -> Column:
    """The last symbols of a gram."""
    return gram if order == ORDER else gram.bitwiseAND((1 << BITS * order) - 1)


class Model:
    """One model or several, each a column of the same tables: their numbers of symbols and, for each order from 1 on, the sharded tables
    (gram, p0, ...) and (context, b0, ...), which are null where a model has not seen the gram or context."""

    def __init__(self, symbols: list[int], grams: list[DataFrame], contexts: list[DataFrame]):
        self.symbols, self.grams, self.contexts = symbols, grams, contexts


def train(texts: DataFrame, text_col: str = "text", half: Column | None = None) -> Model:
    """Fit the model to a table of trusted texts (nulls count as empty).  With half, which is 0 or 1, the models of the two halves and of all texts."""
    rows = texts.select(F.col(text_col).alias("text"), (F.lit(0) if half is None else half).cast("int").alias("half"))
    models = 1 if half is None else 3
    columns = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("n0") + F.col("n1")).alias("n2")][:models]
    counts = rows.mapInArrow(lambda it: trimmed(_count_task(it)), "gram long, n0 long, n1 long").groupBy("gram").agg(*columns)
    by_order = [materialize(counts, "kn-counts")]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols to the left
        left = [F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"n{m}") for m in range(models)]
        by_order.insert(0, materialize(by_order[0].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(*left), f"kn-counts-{order}"))
    seen = by_order[0].agg(*[F.sum((F.col(f"n{m}") > 0).cast("long")) for m in range(models)]).first()
    symbols = [(x or 0) + 1 for x in seen]  # and one for all that were not seen
    grams, contexts = [], []
    for order, counted in enumerate(by_order, 1):
        n = [F.col(f"n{m}") for m in range(models)]
        discount = [F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]) for c, d in zip(n, _discounts(counted, models), strict=True)]
        counted = counted.withColumn("context", F.shiftrightunsigned("gram", BITS))
        sums = [c for m in range(models) for c in (F.sum(n[m]).alias(f"total{m}"), F.sum(discount[m]).alias(f"held{m}"))]
        context = counted.groupBy("context").agg(*sums)
        total = [F.nullif(F.col(f"total{m}"), F.lit(0)) for m in range(models)]
        backoff = [F.col(f"held{m}") / total[m] for m in range(models)]
        joined = counted.join(context, "context")
        if order == 1:
            below = [F.lit(1.0 / x) for x in symbols]
        else:
            below = [F.col(f"q{m}") for m in range(models)]
            shorter = grams[-1].select(F.col("gram").alias("suffix"), *[F.col(f"p{m}").alias(f"q{m}") for m in range(models)])
            joined = joined.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(shorter, "suffix")
        found = joined.select("gram", *[F.when(n[m] > 0, (n[m] - discount[m]) / total[m] + backoff[m] * below[m]).alias(f"p{m}") for m in range(models)])
        grams.append(materialize(found, f"kn-{order}"))
        contexts.append(materialize(context.select("context", *[b.alias(f"b{m}") for m, b in enumerate(backoff)]), f"kn-context-{order}"))
    return Model(symbols, grams, contexts)


def log_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, log0, ...) of the distinct grams of a table: the natural log, by each model, of the last symbol's probability after the others."""
    known, models = grams.select("gram").distinct(), range(len(model.symbols))
    for order in range(ORDER, 0, -1):
        gram = _suffix(F.col("gram"), order)
        seen = model.grams[order - 1].select(F.col("gram").alias("g"), *[F.col(f"p{m}").alias(f"p{order}_{m}") for m in models])
        known = known.join(seen, gram == F.col("g"), "left").drop("g")
        seen = model.contexts[order - 1].select(F.col("context").alias("h"), *[F.col(f"b{m}").alias(f"b{order}_{m}") for m in models])
        known = known.join(seen, F.shiftrightunsigned(gram, BITS) == F.col("h"), "left").drop("h")
    found = [F.lit(1.0 / x) for x in model.symbols]
    for order in range(1, ORDER + 1):
        found = [F.coalesce(F.col(f"p{order}_{m}"), F.coalesce(F.col(f"b{order}_{m}"), F.lit(1.0)) * found[m]) for m in models]
    return known.select("gram", *[F.log(p).alias(f"log{m}") for m, p in enumerate(found)])


_PACKED = "chunk long, ids array<long>, digests array<long>, langs array<string>, sizes array<long>, symbols binary"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[list], np.ndarray, np.ndarray]]:
    """Key, ids with digests and languages, sizes and symbols of chunks of consecutive documents.  A key follows from the
    chunk's documents, so that tasks which read the same rows twice agree."""
    rows: list[list] = [[], [], []]
    sizes, symbols, held = [], [], 0

    def chunk():
        key = xxhash.xxh64_intdigest(repr(rows[:2]).encode()) - (1 << 63)
        return key, rows, np.concatenate(sizes), np.concatenate(symbols)

    def add(batch: pa.RecordBatch, lengths: np.ndarray) -> None:
        for have, k in zip(rows, (0, 1, 3), strict=True):
            have += batch.column(k).to_pylist()
        for a, b in _slices(lengths, SLICE):
            found = _symbols([t or "" for t in batch.column(2).slice(a, b - a).to_pylist()])
            symbols.append(found[0])
            sizes.append(found[1])

    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):  # by rows alone, so that chunks do not depend on batches
            held += n
            if held >= CHUNK:
                add(batch.slice(start, i + 1 - start), lengths[start : i + 1])
                yield chunk()
                rows, sizes, symbols, held, start = [[], [], []], [], [], 0, i + 1
        add(batch.slice(start), lengths[start:])
    if sizes:
        yield chunk()


def _chunk_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents with all their symbols, compressed."""
    long, name = pa.list_(pa.int64()), pa.list_(pa.string())
    for key, rows, sizes, symbols in _chunks(batches):
        data = pa.Codec("zstd", compression_level=3).compress(symbols.tobytes(), asbytes=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array(rows[:1], long), pa.array(rows[1:2], long), pa.array(rows[2:], name), pa.array([sizes], long), pa.array([data])],
            ["chunk", "ids", "digests", "langs", "sizes", "symbols"],
        )


def _parts(sizes: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, stop, symbols) of slices of a chunk's documents."""
    room = sizes + ORDER - 1
    stop = np.cumsum(room)
    for a, b in _slices(sizes, SLICE):
        yield a, b, symbols[stop[a] - room[a] : stop[b - 1]]


def _chunk_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each chunk."""
    for key, _, sizes, symbols in _chunks(batches):
        grams = np.unique(np.concatenate([np.unique(_grams(part)) for _, _, part in _parts(sizes, symbols)]))
        for k in range(0, len(grams), 50_000):
            part = grams[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(part)], ["chunk", "gram"])


def _score_chunk(chunks: pa.Table, scored: pa.Table) -> pa.Table:
    """The sums of log probabilities of a chunk's documents; equal chunks share a key."""
    gram = scored["gram"].to_numpy()
    order = np.argsort(gram)
    gram, logs = gram[order], [scored[name].to_numpy()[order] for name in scored.column_names if name.startswith("log")]
    out = []
    for k in range(chunks.num_rows):
        sizes = np.array(chunks["sizes"][k].as_py())
        symbols = np.frombuffer(pa.decompress(chunks["symbols"][k].as_py(), int((sizes + ORDER - 1).sum()) * 2, "zstd", asbytes=True), np.uint16)
        total = np.zeros((len(sizes), len(logs)))
        for a, b, part in _parts(sizes, symbols):
            own = _grams(part)
            at = np.searchsorted(gram, own)
            if len(own) and (at.max() == len(gram) or (gram[at] != own).any()):
                raise ValueError("docs gave other rows when they were read again: write them to a table first")
            stop = np.cumsum(sizes[a:b] + ORDER - 1) - ORDER + 1
            for m, log in enumerate(logs):
                sums = np.concatenate([[0.0], np.cumsum(log[at], dtype=np.float64)])
                total[a:b, m] = sums[stop] - sums[stop - sizes[a:b]]
        lists = [chunks[name][k].values for name in ("ids", "digests", "langs")]
        by_model = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * len(logs), pa.int32()), pa.array(total.ravel()))
        out.append(pa.table([*lists, by_model, pa.array(sizes)], ["doc_id", "digest", "lang", "logs", "chars"]))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("lang", pa.string()), ("logs", pa.list_(pa.float64())), ("chars", pa.int64())])
    found = pa.concat_tables(out) if out else schema.empty_table()
    give_back()
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, digest (of the text), lang, chars, logs (by each model) and log_p (by the last) of every row of docs, which are read twice."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text", "lang")
    grams = rows.mapInArrow(lambda it: trimmed(_chunk_grams(it)), "chunk long, gram long")
    logs = [F.col(f"log{m}").cast("float").alias(f"log{m}") for m in range(len(model.symbols))]
    scored = grams.join(log_probabilities(grams, model), "gram").select("chunk", "gram", *logs)
    chunks = rows.mapInArrow(lambda it: trimmed(_chunk_task(it)), _PACKED)
    schema = "doc_id long, digest long, lang string, logs array<double>, chars long"
    found = chunks.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(_score_chunk, schema)
    return found.withColumn("log_p", F.element_at("logs", -1))


def _half(doc_id: Column) -> Column:
    """The half of a trusted document, 0 or 1."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all trusted rows (quality 1)."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all trusted documents: a model of each half and one of both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = separator(rows, "doc_id", trusted_ids(labels))
    return train(trusted, half=_half(F.col("doc_id")))


def thresholds(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, most): the least cross-entropy that this share of a language's trusted rows does not exceed; lang is
    null for all rows together.  Values are counted first, so no task sorts a language's rows."""
    langs = F.array_compact(F.array(F.struct("lang"), F.when(F.col("lang").isNotNull(), F.struct(F.lit(None).cast("string").alias("lang")))))
    counted = held.select(F.inline(langs), "cross_entropy").groupBy("lang", "cross_entropy").agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    below = F.sum("n").over(of_lang.orderBy("cross_entropy").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("lang", "cross_entropy", below.alias("below"), F.sum("n").over(of_lang).alias("all"))
    return ranked.where(F.col("below") >= quantile * F.col("all")).groupBy("lang").agg(F.min("cross_entropy").alias("most"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept and digest (of the text) of each row of docs.

    A null or empty text has the perplexity of ordinary text, so it is kept here.
    A row of null lang, or of a language without trusted documents, is held against the
    threshold over all languages; without any trusted document everything is kept.
    Rows that repeat a doc_id, or have none, are judged one by one.  Very long texts are scored whole.
    An empty table gives no rows.  Only doc_id, text and lang of docs are read.
    """
    measured = materialize(score(docs, fit(docs, labels)), "kn-scores")
    unseen = F.element_at("logs", (2 - _half(F.col("doc_id"))).cast("int"))  # by the model of the other half
    held = measured.join(trusted_ids(labels), "doc_id", "left_semi").withColumn("log_p", unseen)
    sums = held.agg(F.sum("log_p"), F.sum("chars")).first()
    typical = -(sums[0] or 0.0) / (sums[1] or 1)
    mean = F.round((SHRINK * typical - F.col("log_p")) / (F.col("chars") + SHRINK), DIGITS).alias("cross_entropy")
    cuts = materialize(thresholds(held.select("lang", mean), quantile), "kn-thresholds")
    whole = cuts.where("lang is null").first()
    most = F.coalesce("most", F.lit(whole["most"] if whole else float("inf")))
    judged = measured.withColumn("cross_entropy", mean).join(cuts.where("lang is not null"), "lang", "left")
    return judged.select(
        "doc_id", "lang", F.col("chars").alias("n_chars"), F.exp("cross_entropy").alias("perplexity"), F.exp(most).alias("threshold"),
        (F.col("cross_entropy") <= most).alias("kept"), "digest",
    )


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that classify keeps, all their columns, whatever they are named."""
    gone = materialize(classify(docs, labels, quantile).where("not kept").select("doc_id", "digest", "lang").distinct(), "kn-rejected")
    return dropped(docs, {"doc_id": F.col("doc_id").cast("long"), "digest": F.xxhash64("text"), "lang": F.col("lang")}, gone)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


QUERIES = {"op10_quality": op10_quality}
