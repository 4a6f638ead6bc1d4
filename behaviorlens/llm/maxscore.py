"""Ranked lexical search: an inverted index of compressed blocks, searched by Block-Max MaxScore in every shard.

The index is built and stored once, without a shuffle: a task cuts its documents into shards of a bounded number of words.  A shard numbers its
documents by their length, so a block of postings holds documents of nearly one length: its largest term frequency and its
first, shortest document bound every score in it closely, whatever the corpus statistics turn out to be.

A query's lists are ordered by their bounds in the shard.  Those whose bounds together stay below the k-th best score so far are not
essential: candidates come from the others, window by window of documents, and the block maxima of the lists that are not essential
reject candidates before a block of them is decoded.  The shards' best merge exactly, since all weights are global.
All scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorlens.llm.common import discard, give_back, materialize, table

#: Results of a query.
TOP_K = 10
#: Words of a shard, about (a longer document is a shard of its own), and its documents at most: their numbers take two bytes.
SHARD_WORDS, SHARD_DOCS = 2_000_000, 1 << 16
#: Postings of a block; documents of a window of the search.
BLOCK, WINDOW = 64, 4096
#: Queries of a block, about.
BLOCK_QUERIES = 20_000

#: Letters, digits and all bytes beyond ASCII stand for themselves, A-Z for a-z, and any other byte parts terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

_INDEX = "shard long, term string, df long, words long, width int, firsts binary, tops binary, places binary, tfs binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 8 m) for norm = 8 m."""
    return (1_000_000_000 * tf) // (1000 * tf + norm)


class _Numbers(dict):
    """Numbers terms as they first occur."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each run of data that stops at ends."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _index_shard(shard: int, numbers: dict[bytes, int], ids: list[int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: a list for each term, in as many bytes a number as it needs, and one row of all documents (term null)."""
    names = ["shard", "term", "df", "words", "width", "firsts", "tops", "places", "tfs"]
    length = np.fromiter(map(len, codes), np.int64, len(codes))
    order = np.argsort(length, kind="stable")
    length = length[order]
    key = np.concatenate([codes[i] for i in order.tolist()]).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), length)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    df = np.bincount(term, minlength=len(numbers))
    begins = np.cumsum(df) - df
    at = np.arange(len(key)) - begins[term]
    edge = np.flatnonzero(at % BLOCK == 0)
    first, top = doc[edge], np.maximum.reduceat(tf, edge)
    place = doc - np.repeat(first, np.diff(edge, append=len(key)))
    need = np.maximum(np.maximum.reduceat(place, begins), np.maximum.reduceat(tf, begins))
    width = np.where(need < 1 << 8, 1, np.where(need < 1 << 16, 2, 4))
    words = np.array(list(numbers), object)
    for size in (1, 2, 4):
        mine = width == size
        if mine.any():
            posting, block, kind = mine[term], mine[term[edge]], f"<u{size}"
            ends, block_ends = np.cumsum(df[mine]), np.cumsum(-(-df[mine] // BLOCK))
            n = int(mine.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard)), pa.array(words[mine].tolist(), pa.binary()).cast(pa.string()), pa.array(df[mine]), pa.nulls(n, pa.int64()), pa.array(np.full(n, size, np.int32)),
                    _binaries(first[block].astype("<u2"), block_ends), _binaries(top[block].astype(kind), block_ends), _binaries(place[posting].astype(kind), ends), _binaries(tf[posting].astype(kind), ends),
                ],
                names,
            )
    own = np.array(ids, "<i8")[order]
    whole = [pa.array([x], kind) for x, kind in ((shard, pa.int64()), (None, pa.string()), (len(ids), pa.int64()), (int(length.sum()), pa.int64()), (8, pa.int32()), (b"", pa.binary()), (b"", pa.binary()))]
    yield pa.RecordBatch.from_arrays([*whole, pa.array([own.tobytes()], pa.binary()), pa.array([length.astype("<i8").tobytes()], pa.binary())], names)


def _index_task(batches: Iterable[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    numbers, ids, codes, held = _Numbers(), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            terms = terms_of(text)
            if not terms:
                continue
            if ids and (held + len(terms) > shard_words or len(ids) == SHARD_DOCS):
                yield from _index_shard(shard, numbers, ids, codes)
                shard += 1
                numbers, ids, codes, held = _Numbers(), [], [], 0
            ids.append(doc_id)
            codes.append(np.fromiter(map(numbers.__getitem__, terms), np.int32, len(terms)))
            held += len(terms)
    if ids:
        yield from _index_shard(shard, numbers, ids, codes)
    give_back()


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index of docs (doc_id, text): a row for each shard and term, and a row of each shard's documents (term null), with their number in df.

    Documents without terms, null texts and rows without doc_id are not in it; rows that repeat a doc_id are documents of their own."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(lambda it: _index_task(it, shard_words), _INDEX), "maxscore-index")


class PostingList:
    """One term's blocks in a shard, decoded where asked."""

    def __init__(self, df: int, width: int, firsts: bytes, tops: bytes, places: bytes, tfs: bytes, norms: np.ndarray):
        kind = f"<u{width}"
        self.df, self.firsts = df, np.frombuffer(firsts, "<u2").astype(np.int64)
        self.places, self.tfs = np.frombuffer(places, kind), np.frombuffer(tfs, kind)
        #: No impact in a block exceeds that of its largest frequency in its shortest document.
        self.bounds = impact(np.frombuffer(tops, kind).astype(np.int64), norms[self.firsts])
        self.norms = norms

    def blocks(self, low: int, high: int) -> tuple[int, int]:
        """The blocks that may hold documents low to high - 1."""
        return max(int(np.searchsorted(self.firsts, low, "right")) - 1, 0), int(np.searchsorted(self.firsts, high))

    def decode(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of these blocks."""
        a, b = first * BLOCK, min(stop * BLOCK, self.df)
        docs = self.places[a:b] + np.repeat(self.firsts[first:stop], BLOCK)[: b - a]
        return docs, impact(self.tfs[a:b].astype(np.int64), self.norms[docs])

    def of(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of documents, each of which can stand in the given block only; 0 where it does not."""
        at = block[:, None] * BLOCK + np.arange(BLOCK)
        same = (self.places[np.minimum(at, self.df - 1)] == (docs - self.firsts[block])[:, None]) & (at < self.df)
        there = same.any(1)
        out = np.zeros(len(docs), np.int64)
        out[there] = impact(self.tfs[at[there, same[there].argmax(1)]].astype(np.int64), self.norms[docs[there]])
        return out


def best_documents(lists: list[tuple[int, PostingList]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids and scores of the k best documents of a shard, exactly; lists has the factor of every list.  Equal scores: the smaller doc_id."""
    lists = sorted(((c, p, c * int(p.bounds.max())) for c, p in lists if c > 0), key=lambda x: x[2])
    upto = np.cumsum([u for *_, u in lists])
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for low in range(0, len(ids) if lists else 0, WINDOW):
        high = min(low + WINDOW, len(ids))
        spans = [p.blocks(low, high) for _, p, _ in lists]
        if sum(c * int(p.bounds[a:b].max()) for (c, p, _), (a, b) in zip(lists, spans, strict=True) if a < b) < least:
            continue
        first = int(np.searchsorted(upto, least))  # lists before it cannot reach the threshold together
        sums = np.zeros(high - low, np.int64)
        for (c, p, _), (a, b) in zip(lists[first:], spans[first:], strict=True):
            if a < b:
                doc, own = p.decode(a, b)
                inside = (doc >= low) & (doc < high)
                sums[doc[inside] - low] += c * own[inside]
        found = np.flatnonzero((sums > 0) & (sums + (int(upto[first - 1]) if first else 0) >= least)) + low
        own = sums[found - low]
        for i in range(first - 1, -1, -1):
            if not len(found):
                break
            c, p, _ = lists[i]
            block = np.searchsorted(p.firsts, found, "right") - 1
            bound = np.where(block >= 0, c * p.bounds[np.maximum(block, 0)], 0)
            open_ = own + bound + (int(upto[i - 1]) if i else 0) >= least
            found, own, block = found[open_], own[open_], block[open_]
            there = block >= 0
            own[there] += c * p.of(found[there], block[there])
        docs, scores = np.concatenate([docs, found]), np.concatenate([scores, own])
        keep = np.lexsort((ids[docs], -scores))[:k]
        docs, scores = docs[keep], scores[keep]
        if len(scores) == k:
            least = max(1, int(scores[-1]))
    return ids[docs], scores


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, shard_words: int = SHARD_WORDS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, doc_id and score of the k best documents of each query (query_id, text), over all documents (doc_id, text).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased.  Rows that repeat a query_id are one query of all
    their terms; a query's repeated terms count as often as they stand there.  A query without terms, or whose terms no document holds, has no
    rows, nor have documents without a score above 0.  Null texts have no terms; rows of null query_id or doc_id take no part; rows that repeat a
    doc_id are documents of their own.  Empty tables give no rows; other columns are not read.  Ties go to the smaller doc_id."""
    index = build_index(docs, shard_words)
    shards = index.where("term is null")
    whole = shards.agg(F.count("*").alias("shards"), F.sum("df").alias("n"), F.sum("words").alias("words")).first()
    groups, n, words = max(whole["shards"], 1), whole["n"] or 0, whole["words"] or 1
    own = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text")
    terms = own.mapInArrow(_query_task, "query_id long, term string, times long").groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    terms = materialize(terms, "maxscore-terms")
    parts = max(1, -(-terms.select("query_id").distinct().count() // block_queries))
    part = lambda name: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    df = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = terms.join(df, "term").select("query_id", "term", (F.col("times") * weight).alias("factor"))
    asked = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "factor")).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.factor").alias("factors"))
    asked = asked.select("*", part("query_id").alias("part"), every(groups).alias("group"))
    wanted = terms.select("term", part("query_id").alias("part")).distinct()
    held = index.join(wanted, "term").unionByName(shards.withColumn("part", every(parts)))
    held = held.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query, doc, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        by_shard: dict[int, list[dict]] = {}
        for row in left.to_pylist() if right.num_rows else []:
            by_shard.setdefault(row["shard"], []).append(row)
        questions = list(zip(right["query_id"].to_pylist(), right["terms"].to_pylist(), right["factors"].to_pylist(), strict=True)) if by_shard else []
        for rows in by_shard.values():
            documents = next(r for r in rows if r["term"] is None)
            ids = np.frombuffer(documents["places"], "<i8")
            norms = 8 * (25 + (75 * np.frombuffer(documents["tfs"], "<i8") * n) // words)
            lists = {r["term"]: PostingList(r["df"], r["width"], r["firsts"], r["tops"], r["places"], r["tfs"], norms) for r in rows if r["term"] is not None}
            for name, own, factors in questions:
                found, scores = best_documents([(c, lists[t]) for t, c in zip(own, factors, strict=True) if t in lists], ids, k)
                query.append(np.full(len(found), name))
                doc.append(found)
                score.append(scores)
        give_back()
        return pa.table({"query_id": np.concatenate(query), "doc_id": np.concatenate(doc), "score": np.concatenate(score)})

    found = held.groupBy("group", "part").cogroup(asked.groupBy("group", "part")).applyInArrow(run, "query_id long, doc_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "maxscore-found")
    discard(index, terms)
    return ranked.select("query_id", "rank", "doc_id", "score")


def _query_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            terms = terms_of(text)
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(terms), pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([1] * len(terms), pa.int64())], ["query_id", "term", "times"])


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search(table(spark, sf_dir, "documents"), items).withColumnRenamed("query_id", "item_id")


QUERIES = {"op12_maxscore": op12_maxscore}
ORACLE_SQL = {
    "op12_maxscore": r"""
        WITH w AS (SELECT doc_id, row_number() OVER () AS r,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
                   FROM documents WHERE doc_id IS NOT NULL),
        tf AS (SELECT doc_id, r, term, count(*) AS tf FROM (SELECT doc_id, r, unnest(t) AS term FROM w) GROUP BY ALL),
        n AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM w WHERE len(t) > 0),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT item_id, term, count(*) AS times
              FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                    FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
        m AS (SELECT r, 25 + (75 * len(t) * n.n) // n.l AS m FROM w, n WHERE len(t) > 0),
        s AS (SELECT item_id, doc_id, r,
                     sum(times * floor(1000 * ln((2 * n.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
              FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r), n GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY rank <= 10"""
}
