"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word n-grams, hashed; the order of tokens is: rare
ones by hash, then frequent ones by hash.  Two sets that reach the similarity differ in few
tokens of either, so that prefixes of a bounded number of "errors" must share a signature:
rare tokens are signatures alone, frequent ones in pairs, and a prefix is extended until
losing all of its signatures would take more errors than the similarity allows.  (Combinations of three
would be C(errors + 2, 3) signatures a document where all tokens are frequent: 5,456 for
300 tokens at 90 %, against 496 pairs.)

A token is frequent when it stands in the stored prefixes (lowest hashes) of more than
``FREQUENT`` documents, counted over all documents.  The classes reach every task as a
membership filter of fixed size: what the filter says is the class, so that all documents
order their tokens alike.  Should more tokens be frequent than the filter holds, the
threshold doubles until they fit.

Documents of equal sets are one node.  A signature also holds a class of sizes, so that only sets
of comparable sizes meet, and of signatures with the same nodes one is kept.  The nodes of a signature are
looked at together by a task, in blocks where they are many, by their prefixes, which leave most pairs no chance.
No pair is ever a row: a task gives a spanning forest of the links that are possible, at
most one for each node.  All links lie within the components of that forest, whose whole sets are then
compared block by block; that gives a forest of the links, so the components, and counts every link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import FILTER_BITS, components, discard, dropped, materialize, member_filter, table, token_filter, trimmed

#: Stored prefixes that may share a token before it counts as frequent.
FREQUENT = 16
#: Bytes of text shingled at a time.
SLICE = 1 << 18
#: Nodes of a block of a signature's nodes, about, of which two meet in a task.
SIGNED_NODES = 1024
#: Nodes and tokens of a block of a component, about, of which two are compared in a task; tokens counted at a time.
BLOCK_NODES, BLOCK_TOKENS, COLUMNS = 512, 400_000, 8192

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    gap = _GAP[raw]
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64), first
    at = np.arange(len(raw)) - np.maximum.accumulate(np.where(gap, np.arange(1, len(raw) + 1), 0))
    weights = _mix(np.arange(1, int(at.max()) + 2)) | np.uint64(1)
    sums = np.add.reduceat(np.where(gap, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * weights[np.maximum(at, 0)]), first)
    return _mix(sums), first


def token_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: A-Z in lower case, words apart by ASCII white
    space; a text of fewer words is one token, one without words has none."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        part.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(part[-1])
        if size >= SLICE:
            yield from _token_sets(part, n)
            part, size = [], 0
    yield from _token_sets(part, n)


def _token_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    hashes, first = _word_hashes(b" ".join(texts))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(first, begins)
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams = _mix(grams + np.uint64(k + 1)) + hashes[k : len(hashes) - n + 1 + k] if len(grams) else grams
    grams = _mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = _mix(np.array([short + np.uint64(77)], np.uint64))[0] + h
            yield _mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def errors(size: int, percent: int) -> int:
    """Tokens of a set of this size that a partner of the similarity may lack."""
    return size - -(-size * percent // 100)


def stored(allowed: int) -> int:
    """Tokens of a set that are kept beside it: the plain prefix, and some in place of frequent ones."""
    return allowed + 1 + (allowed + 1) // 2 + 4


def signatures(rare: np.ndarray, frequent: np.ndarray, allowed: int) -> tuple[np.ndarray, bool]:
    """Signatures of the shortest prefix that more than ``allowed`` errors would be needed to empty, and
    whether the tokens suffice for one.  rare and frequent are in the order of tokens."""
    singles = rare[: allowed + 1]
    missing = allowed + 1 - len(singles)
    if not missing:
        return singles, True
    mixed = _mix(frequent[: missing + 1].view(np.uint64))
    i, j = np.triu_indices(len(mixed), 1)
    return np.concatenate([singles, (mixed[i] * np.uint64(3) + mixed[j]).view(np.int64)]), len(mixed) > missing


def size_class(size: Column, percent: int) -> Column:
    """Sets of which one may be a partner of the other lie in one class or in two neighbouring ones."""
    return F.floor(F.log(size) / (1.0001 * math.log(max(100 / percent, 1.01))))


def all_signatures(tokens: np.ndarray, often: np.ndarray, size: int, percent: int) -> np.ndarray:
    """The signatures by which a set meets its partners.

    A set of so few tokens that all of them would not suffice, or that has such a partner, also has
    the plain prefix's tokens one by one."""
    allowed = errors(size, percent)
    found, enough = signatures(tokens[~often], tokens[often], allowed)
    # Tokens run out only where at most one must be shared with a partner: then at most 100 / percent of them, and a partner's at most as many times more.
    if not enough or size * percent * percent <= 100 * 100:
        found = np.concatenate([found, _mix(tokens[: allowed + 1].view(np.uint64) + np.uint64(1)).view(np.int64)])
    return found


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column as arrays, without a Python object for each value."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _plain_task(batches: Iterable[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            sizes, one, two, prefixes = [], [], [], []
            for tokens in token_sets(part.column(1).to_pylist(), n):
                sizes.append(len(tokens))
                one.append(np.add.reduce(_mix(tokens + np.uint64(5))).astype(np.int64) if len(tokens) else 0)
                two.append(np.add.reduce(_mix(tokens ^ np.uint64(0x5DEECE66D))).astype(np.int64) if len(tokens) else 0)
                prefixes.append(tokens[: stored(errors(len(tokens), percent))].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "d1", "d2", "prefix"],
            )


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the documents that nodes names, read again from their texts."""
    wanted = member_filter(nodes, "node")
    rows = docs.where(wanted(F.col("doc_id").cast("long"))).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")

    def task(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [t.astype(np.int64) for t in token_sets(part.column(1).to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"])

    return rows.select("doc_id", "text").mapInArrow(lambda it: trimmed(task(it)), "node long, tokens array<long>")


def _halves(column: str) -> Column:
    """The upper halves of tokens, in the same order."""
    return F.transform(column, lambda x: (F.shiftrightunsigned(x, 32) - (1 << 31)).cast("int"))


def _frequent(nodes: DataFrame) -> DataFrame:
    """(token) of the frequent tokens' upper halves, at most an eighth of the filter's bits."""
    counts = nodes.select(F.explode(_halves("prefix")).alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > FREQUENT)
    counts = materialize(counts, "frequent")
    limit = FREQUENT
    while counts.where(F.col("c") > limit).count() > FILTER_BITS // 8:
        limit *= 2
    return counts.where(F.col("c") > limit).select("token")


def _signed(docs: DataFrame, nodes: DataFrame, often, n: int, percent: int) -> DataFrame:
    """(sig, node) of the nodes that share a signature with another one, sig being a signature in the class of the node's size or in
    the next one.  Nodes whose stored tokens do not suffice are read again from their texts."""

    def task(batches, whole):
        for large in batches:
            for batch in (large.slice(k, 500) for k in range(0, large.num_rows, 500)):
                sigs, short = [], []
                for size, tokens in zip(batch.column("n").to_pylist(), _rows(batch.column("tokens")), strict=True):
                    flags = often((tokens.view(np.uint64) >> np.uint64(32)).astype(np.int64) - (1 << 31))
                    done = whole or len(tokens) == size or len(tokens) - np.count_nonzero(flags) > errors(size, percent)
                    sigs.append(all_signatures(tokens, flags, size, percent) if done else np.zeros(0, np.int64))
                    short.append(not done)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("n"), pa.array(sigs, pa.list_(pa.int64())), pa.array(short, pa.bool_())], ["node", "n", "sigs", "short"]
                )

    schema = "node long, n long, sigs array<long>, short boolean"
    first = materialize(nodes.select("node", "n", F.col("prefix").alias("tokens")).mapInArrow(lambda it: trimmed(task(it, False)), schema), "signatures")
    sets = _sets_of(docs, first.where("short").select("node"), n).select("node", F.size("tokens").cast("long").alias("n"), "tokens")
    signed = first.unionByName(sets.mapInArrow(lambda it: trimmed(task(it, True)), schema)).select(F.explode("sigs").alias("sig"), "node", "n")
    many = signed.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    own = size_class(F.col("n"), percent)
    met = materialize(signed.join(many, "sig").select(F.explode(F.array(own, own + 1)).alias("class"), "sig", "node").select(F.xxhash64("sig", "class").alias("sig"), "node"), "signed")
    discard(first)
    return met


class _Group:
    """Rows of one group of a table: its columns of numbers as arrays, its one column of lists as values and offsets."""

    def __init__(self, columns: dict[str, np.ndarray], values: np.ndarray, offsets: np.ndarray):
        self.columns, self.values, self.offsets = columns, values, offsets

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def part(self, a: int, b: int) -> _Group:
        return _Group({k: v[a:b] for k, v in self.columns.items()}, self.values, self.offsets[a : b + 1])

    def lists(self) -> list[np.ndarray]:
        return [self.values[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]


def _groups(rows: DataFrame, keys: list[str], work: Callable[[_Group], Iterable[tuple[int, ...]]], schema: str) -> DataFrame:
    """work(rows of a group) of every group of keys; groups must be of bounded size, rows have one column of lists.
    A task takes its groups one after the other from its sorted rows; results are rows of longs."""
    listed = next(name for name, kind in rows.dtypes if kind.startswith("array"))
    names = [part.split()[0] for part in schema.split(", ")]

    def task(batches):
        def run(tables: list[pa.RecordBatch], last: bool):
            whole = pa.Table.from_batches(tables).combine_chunks()
            lists = whole[listed].combine_chunks()
            group = _Group({n: whole[n].to_numpy() for n in whole.column_names if n != listed}, lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy())
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([group[k][1:] != group[k][:-1] for k in keys])) + 1).tolist(), whole.num_rows]
            stop = len(edges) - 1 if last else len(edges) - 2
            out = [row for k in range(stop) for row in work(group.part(edges[k], edges[k + 1]))]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), whole.slice(edges[stop]).to_batches()

        held: list[pa.RecordBatch] = []
        for large in batches:
            for batch in (large.slice(k, 1000) for k in range(0, large.num_rows, 1000)):
                found, held = run([*held, batch], False)
                yield found
        if held:
            yield run(held, True)[0]

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: trimmed(task(it)), schema)


def _met(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows with block, lo and hi: every block of a group meets itself and every other one."""
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")


class _Sets:
    """Some nodes' tokens, numbered, so that one of them is compared with all others at once."""

    def __init__(self, rows: _Group):
        first = rows.offsets[0]
        self.tokens = rows.values[first : rows.offsets[-1]]
        self.start, self.stop = rows.offsets[:-1] - first, rows.offsets[1:] - first
        kinds, self.number = np.unique(self.tokens, return_inverse=True)
        self.mark = np.zeros(len(kinds), bool)

    def common(self, k: int) -> np.ndarray:
        """Tokens that each has in common with k."""
        own = self.number[self.start[k] : self.stop[k]]
        self.mark[own] = True
        found = np.add.reduceat(self.mark[self.number], self.start, dtype=np.int64)
        self.mark[own] = False
        return found


def _merge(tree: np.ndarray, k: int, near: np.ndarray) -> Iterator[int]:
    """Joins the trees of the places that are near to k's; gives a place of each tree that was another."""
    for t, other in {t: j for j, t in zip(np.flatnonzero(near).tolist(), tree[near].tolist(), strict=True)}.items():
        if t != tree[k]:
            tree[tree == t] = tree[k]
            yield other


def _possible(rows: _Group, percent: int) -> Iterator[tuple[int, int]]:
    """(a, b) of a spanning forest of the pairs whose plain prefixes do not rule them out: what one prefix holds up to
    the end of the other, and the other does not, is missing from the other set."""
    size, node, block = rows["n"], rows["node"], rows["block"]
    sets = _Sets(rows)
    within = rows["lo"][0] == rows["hi"][0]
    end = sets.tokens[sets.stop - 1]
    tree = np.arange(len(node))
    for k in range(len(node)):
        if (tree == tree[0]).all():
            return
        common = sets.common(k)
        own = sets.tokens[sets.start[k] : sets.stop[k]]
        lost_own = np.searchsorted(own, end, "right") - common
        lost = np.add.reduceat(sets.tokens <= own[-1], sets.start, dtype=np.int64) - common
        overlap = np.minimum(size[k] - lost_own, size - lost)
        near = 100 * overlap >= percent * (size[k] + size - overlap)
        for other in _merge(tree, k, near if within else near & (block != block[k])):
            yield int(node[k]), int(node[other])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Tokens that each set of left has in common with each of right."""
    tokens = np.unique(np.concatenate(left))
    tokens = tokens[np.isin(tokens, np.concatenate(right))]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(tokens), COLUMNS):
        part = tokens[k : k + COLUMNS]
        held = [np.array([np.isin(part, x, assume_unique=True) for x in side], np.float32) for side in (left, right)]
        out += held[0] @ held[1].T
    return out


def _links(rows: _Group, percent: int) -> Iterator[tuple[int, int, int]]:
    """Of the nodes of two blocks of a component: (node, n_links, node) counts the links of one block with the other, (a, 0, b) are
    the links of a spanning forest."""
    low, high = rows["lo"][0], rows["hi"][0]
    order = np.argsort(rows["node"], kind="stable")
    block, node, lists = rows["block"][order], rows["node"][order], rows.lists()
    sets = [lists[i] for i in order.tolist()]
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(a) or not len(b):
        return
    sizes = np.array([len(x) for x in sets])
    common = _overlaps([sets[i] for i in a], [sets[i] for i in b])
    linked = (common > 0) & (100 * common >= percent * (sizes[a][:, None] + sizes[b][None, :] - common))
    left, right = np.unique(node[a], return_index=True), np.unique(node[b], return_index=True)
    linked = np.logical_or.reduceat(np.logical_or.reduceat(linked, left[1], 0), right[1], 1) & (left[0][:, None] != right[0][None, :])
    yield from zip(left[0].tolist(), linked.sum(1).tolist(), left[0].tolist(), strict=True)
    if low != high:
        yield from zip(right[0].tolist(), linked.sum(0).tolist(), right[0].tolist(), strict=True)
    tree = np.concatenate([left[0], right[0]])
    at = np.flatnonzero(np.isin(right[0], left[0]))  # of one block, its nodes stand on both sides
    for k in range(len(left[0])):
        near = np.zeros(len(tree), bool)
        near[len(left[0]) :] = linked[k]
        for other in _merge(tree, k, near):
            yield int(left[0][k]), 0, int(right[0][other - len(left[0])])
        if len(at) and (tree == tree[0]).all():
            return


def _linked(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, n_links, b) as of _links, for all blocks of the components of labels."""
    placed = sets.join(labels, "node")
    sizes = placed.groupBy("component").agg(F.count("*").alias("c"), F.sum("size").alias("t"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_NODES), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("int")
    met = _met(placed.select("node", "tokens", "component").join(sizes, "component"), blocks).select("node", "tokens", "component", "block", "lo", "hi")
    return _groups(met, ["component", "lo", "hi"], lambda rows: _links(rows, percent), "a long, n_links long, b long")


def ngram_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row, where documents link when 100 * intersection >= percent * union.

    component_id is the smallest doc_id reachable by links; n_links counts the other sets that link
    with this one, all of them.  A text with words but fewer than n is one token; null texts
    and texts without words have the empty set, n_shingles 0, and link with nothing.  Rows of null doc_id link
    with nothing and have a null component_id.  Rows that repeat a doc_id are one document with several
    texts: it has the links of each.  An empty table gives no rows.  Very long texts are
    taken whole, other columns are not read.  percent lies between 1 and 100.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = materialize(docs.mapInArrow(lambda it: trimmed(_plain_task(it, n, percent)), "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "prefixes")
    rest = materialize(plain.drop("prefix"), "rows")
    usable = plain.where("doc_id is not null and n > 0")
    ids = rest.where("doc_id is not null and n > 0")
    classes = materialize(ids.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    copies = materialize(ids.join(classes, ["n", "d1", "d2"]).where("doc_id != node").select("doc_id", "d1", "d2").distinct(), "copies")
    nodes = dropped(usable, {k: F.col(k) for k in ("doc_id", "d1", "d2")}, copies).select(F.col("doc_id").alias("node"), "n", "prefix")
    often = token_filter(_frequent(nodes), "token")
    signed = _signed(docs, nodes, often, n, percent)
    same = [F.count("*").alias("c"), F.min("node").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(3)), 20)).alias("s")]
    groups = signed.groupBy("sig").agg(*same).where("c > 1").groupBy("c", "m", "x", "s").agg(F.min("sig").alias("sig")).select("sig", "c")
    met = _met(signed.join(groups, "sig"), F.ceil(F.col("c") / SIGNED_NODES).cast("int")).drop("c")
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100)
    # Two tokens that agree in their upper halves only leave more possible.
    some = nodes.select("node", "n", _halves("prefix").alias("prefix")).withColumn("prefix", F.slice("prefix", 1, (F.ceil(allowed * 0.6) + 24).cast("int")))
    near = materialize(_groups(met.join(some, "node"), ["sig", "lo", "hi"], lambda rows: _possible(rows, percent), "a long, b long").distinct(), "possible")
    discard(plain, signed)

    labels = materialize(components(near), "possible-components")
    sets = materialize(_sets_of(docs, labels.select("node"), n).where(F.size("tokens") > 0).withColumn("size", F.size("tokens").cast("long")), "sets")
    found = materialize(_linked(sets, labels, percent), "links")
    discard(sets)
    labels = materialize(components(found.where("n_links = 0 and a != b").select("a", "b")), "components")
    degrees = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
    owners = classes.join(labels, "node", "left").join(degrees, "node", "left").select(
        "n", "d1", "d2", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rest.join(owners, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows of null doc_id stay.
    Rows that repeat a doc_id stay or go together.  Columns of any name are passed on."""
    found = ngram_components(docs, n, percent)
    gone = materialize(found.where("doc_id is not null and component_id < doc_id").select("doc_id").distinct(), "dropped")
    return dropped(docs, {"doc_id": F.col("doc_id").cast("long")}, gone)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


QUERIES = {"op1_ngram_join": op1_ngram_join}
