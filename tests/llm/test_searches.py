"""Hard negatives and ranked lexical search against brute force, with nulls, ties, repeated rows and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import hard_negatives, maxscore

VECTORS = "vec_id long, label int, vector array<double>, code string, rank string"


def brute_negatives(rows, anchors, positives=5, negatives=3):
    kept = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and abs(x) < hard_negatives.LARGEST for x in v):
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    most = max((len(v) for _, v in kept.values()), default=0)
    kept = {i: (label, v + [0] * (most - len(v))) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in kept.items():
        if not anchors(a):
            continue
        scores = {i: int(sum(x * y for x, y in zip(v, w, strict=True))) for i, (_, w) in kept.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            fit = [i for i in order if kept[i][0] != label and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]][:negatives]
            out += [(a, p, r, i, scores[p], scores[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims, blocks", [(5, 40), (64, 4096), (70, 50)])
def test_hard_negatives(spark, dims, blocks):
    rng = random.Random(dims)
    centres = [[rng.gauss(0, 200) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(220):
        c = centres[rng.randrange(4)]
        rows.append((i, rng.randrange(3), [float(round(x + rng.gauss(0, 60))) for x in c]))
    rows += [(300 + i, i % 3, rows[7][2]) for i in range(40)]  # copies: ties
    rows += [(400, None, rows[0][2]), (401, 1, None), (402, 1, [1.0, None]), (403, 1, [float("nan")] * dims), (404, 1, [float("inf")] * dims), (405, 1, [1e30] * dims), (None, 1, rows[1][2])]
    rows += [(406, 1, [0.0] * dims), (407, 2, []), (408, 1, rows[3][2][: dims // 2]), (10, 2, rows[5][2]), (10, *rows[10][1:]), (12, *rows[12][1:])]
    rows += [(-4, 1, [-x for x in rows[4][2]]), (500, 77, rows[9][2])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    got = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, block_rows=blocks, block_anchors=blocks)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows, lambda i: i % 4 == 0)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 4 == 0).count() == 0


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(1)
    v = np.floor(rng.standard_normal((400, 64)) * 256).astype(np.int64)
    turn = hard_negatives.rotations(64)
    rows = object.__new__(hard_negatives._Rows)
    code, rows.norm, rows.length, rows.alignment = hard_negatives.encode(v.astype(float), turn)
    rows.ids, rows.label, rows.vector, rows.code = np.arange(400), np.zeros(400, np.int64), v, np.ascontiguousarray(code).view(np.uint64)
    low, high = hard_negatives.intervals(rows, slice(0, 60), rows, turn)
    score = v[:60] @ v.T
    assert (low <= score).all() and (score <= high).all()
    assert ((high - low) / (rows.norm[:60, None] * rows.norm)).mean() < 0.6


def brute_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(own(t))) for d, t in docs if d is not None]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, words = len(bags), sum(size for *_, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    queries = {}
    for q, t in items:
        if q is not None:
            queries.setdefault(q, Counter()).update(own(t))
    out = []
    for q, wanted in queries.items():
        found = []
        for d, b, size in bags:
            m = 25 + (75 * size * n) // words
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in wanted.items() if t in b)
            if score > 0:
                found.append((-score, d))
        out += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_words, block_queries", [(2_000_000, 20_000), (900, 4)])
def test_ranked_search(spark, shard_words, block_queries):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 20, 90))))) for i in range(700)]
    docs += [(800 + i, "same Words here w1 w2") for i in range(40)] + [(5, docs[5][1]), (None, "w1 w2 rare"), (900, None), (901, " ;; "), (902, "w1 " * 30_000), (903, "ÉÀ É x école Straße"), (-7, "same Words here")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 30))))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nothing-of-this"), (33, "w1 w1 W1"), (33, "w2"), (None, "w1"), (34, "same words HERE"), (35, "École éà É x"), (36, "w1")]
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, term string, shard int")
    q = spark.createDataFrame([(*x, "b") for x in items], "query_id long, text string, term string")
    got = maxscore.search(d, q, shard_words=shard_words, block_queries=block_queries)
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute_search(docs, items)


def test_ranked_search_of_nothing(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert maxscore.search(d, q).count() == 0
    assert maxscore.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), q.limit(0)).count() == 0


def test_lists_decode_what_they_hold():
    norms = np.arange(1, 400, dtype=np.int64)
    docs = np.arange(0, 399, 3)
    rows = list(maxscore._index_shard(0, {b"a": 0}, list(range(399)), [np.zeros(1 + (i % 3 == 0), np.int32) for i in range(399)]))
    r = rows[0].to_pylist()[0]
    one = maxscore.PostingList(r["df"], r["width"], r["firsts"], r["tops"], r["places"], r["tfs"], norms)
    found, impacts = one.decode(0, len(one.firsts))
    assert found.tolist() == list(range(399)) and len(docs) and (impacts <= np.repeat(one.bounds, maxscore.BLOCK)[:399]).all()
