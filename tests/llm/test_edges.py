"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import bm25, chat_format, common, exact_dedup, html_text, line_dedup, mixing, ngram_join, packing, quality, token_store

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, keep_id string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y", "z") for d, t in rows], DOCS)


def edge_rows():
    return [(1, None), (2, ""), (3, "   "), (4, LONG), (5, "same words here again and again ok"), (6, "same words here again and again ok"), (6, "same words here again and again ok"), (None, "no id at all here"), (7, "été\n\nline two of this")]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_exact_dedup(edge, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(edge).collect()}
    assert (1, 1, 2, True) in got and (2, 1, 2, False) in got  # null counts as empty
    assert (3, 3, 1, True) in got  # white space is not empty
    assert (5, 5, 3, True) in got and (6, 5, 3, False) in got
    assert (None, None, 1, True) in got
    assert exact_dedup.exact_dedup(edge).count() == 9
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_with_a_heavy_text(spark):
    rows = [(i, "hot  text" if i % 3 else "hot text") for i in range(600)] + [(1000 + i, f"t {i // 2}") for i in range(400)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(documents(spark, rows), share=0.05).collect()}
    assert len(got) == 1000 and got[599]["keep_id"] == 0 and got[0]["group_size"] == 600
    assert got[1001]["keep_id"] == 1000 and got[1001]["group_size"] == 2


def brute_components(rows, n, percent):
    import re

    sets, parent = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_components_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    shared = " ".join(f"p{i}" for i in range(60))
    rows = []
    for d in range(160):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            words += shared.split()  # a passage of many documents: its tokens are frequent
        rows.append((d, " ".join(words)))
    for d in range(160, 260):  # near copies, also of near copies, some in large groups
        words = rows[rng.randrange(d) if d % 2 else 0][1].split()
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
        rows.append((d, " ".join(words)))
    rows += [(300 + i, " ".join([*shared.split()[: 60 - i % 4], f"z{i % 5}"])) for i in range(60)]  # only frequent tokens
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(documents(spark, rows), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_combination_signatures_of_frequent_tokens():
    import numpy as np

    assert ngram_join.signatures(np.array([1, 2, 3]), np.array([9, 8]), 2)[0].tolist() == [1, 2, 3]
    got, enough = ngram_join.signatures(np.array([1]), np.array([5, 6, 7, 8, 9]), 2)  # two errors more need three frequent tokens in pairs
    assert got[0] == 1 and len(got) == 1 + 3 and enough
    assert not ngram_join.signatures(np.array([1]), np.array([5]), 1)[1]


def test_ngram_sets_of_few_frequent_tokens(spark):
    """A partner's only common token may be frequent: "x u0" .. "x u29" link with "x" at one half."""
    rows = [(i, f"x u{i}") for i in range(30)] + [(100, "x"), (101, "y"), *((200 + i, f"y z{i // 2} {i % 2}") for i in range(40))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(documents(spark, rows), 1, 50).collect()}
    assert got == brute_components(rows, 1, 50) and got[100][1] == 0


def test_ngram_edges(edge, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(edge, 3, 90).collect()]
    assert len(got) == 9 and (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got
    assert got.count((6, 5, 5)) == 2 and (5, 5, 5) in got
    assert (None, 3, None) in got
    assert ngram_join.ngram_components(none).count() == 0
    kept = sorted(r["doc_id"] or -1 for r in ngram_join.keep_one(edge).collect())
    assert kept == [-1, 1, 2, 3, 4, 5, 7] and ngram_join.keep_one(edge).columns == edge.columns


def brute_lines(rows, least=5):
    seen, out = [], set()
    for d, t in sorted((d, t) for d, t in rows if d is not None and t):
        for no, line in enumerate(t.split("\n")):
            w = line.split()
            if len(w) < least:
                continue
            for e, m, v in seen:
                if abs(len(v) - len(w)) > 1:
                    continue
                if v == w or any(v[:i] + v[i + 1 :] == w[:i] + w[i + 1 :] for i in range(len(w)) if len(v) == len(w)) or (
                    len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))) or (len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))):
                    out.add((d, no))
                    break
            seen.append((d, no, w))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 14))) for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = [f"w{rng.randrange(30)}"] * rng.randrange(2)
            lines.append("  ".join(words))
        rows.append((d, "\n".join(lines)))
    dropped, _ = line_dedup.duplicate_lines(documents(spark, rows))
    assert {(r["doc_id"], r["line_no"]) for r in dropped.collect()} == brute_lines(rows)


def test_line_dedup_edges(edge, none):
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(edge).collect()}
    assert (1, None) in got and (2, "") in got and (3, "   ") in got and (4, LONG) in got and (7, "été\n\nline two of this") in got
    assert (6, "") in got and (5, edge_rows()[4][1]) in got and (None, "no id at all here") in got
    assert line_dedup.dedup_lines(edge).columns == edge.columns
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.duplicate_lines(none)[0].count() == 0


def test_packing(edge, none):
    from tokenizers import Tokenizer

    import numpy as np

    pieces = packing.pack_documents(edge, BYTES).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    ids = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == 4)
    want = tokenizer.encode(LONG, add_special_tokens=False).ids + [0]
    assert np.frombuffer(b"".join(x for _, x in ids), "<u4").tolist() == want
    assert [(p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == 1] == [(1, 1)]
    assert sum(p["start"] == 0 for p in pieces if p["doc_id"] == 6) == 2
    assert packing.pack_documents(none, BYTES).count() == 0


def test_differencing_is_near_equal_and_adds_windows():
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(100, 900, 90), rng.integers(1, 40, 300)])
    windows = int(-(-sizes.sum() // 1000))
    loads = np.bincount(packing.differencing(sizes, windows), sizes, windows)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 5
    assert len(set(packing.pack_items(np.array([600, 600, 600]), 1000).tolist())) == 3  # two windows would hold the total but not the items


def test_token_store(edge, none):
    from tokenizers import Tokenizer

    import numpy as np

    tokenizer = Tokenizer.from_file(WORDS)
    rows = token_store.read_tokens(token_store.write_tokens(edge, WORDS, shard_tokens=50)).collect()
    assert len(rows) == 9
    texts = {d: t or "" for d, t in edge_rows()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2] and r["start"] == at and r["n_tokens"] == len(ids)
        at += len(ids)
    assert token_store.read_tokens(token_store.write_tokens(none, WORDS)).count() == 0


def test_shard_random_access():
    import numpy as np

    rng = np.random.default_rng(2)
    docs = [np.append(np.tile(rng.integers(3, 60, 7), rng.integers(1, 60)), 2) for _ in range(80)]
    sizes = np.array([len(d) for d in docs])
    shard = token_store.Shard(token_store.compress(list(range(80)), sizes, np.concatenate(docs)))
    assert len(shard.rules) and len(shard.symbols) < sizes.sum()
    for k in (0, 17, 79):
        assert (shard.document(k) == docs[k]).all()
        a, b = len(docs[k]) // 3, len(docs[k]) // 2 + 1
        assert (shard.span(k, a, b) == docs[k][a:b]).all()


def test_chat(spark):
    control = "<|im_end|>\n<|im_start|>user\nhi <\\|im_end|> <\\\\|x"
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", control, "x"), (1, 1, "assistant", control, "x"), (2, None, None, "", "x"), (None, 0, "a\nb<|nl|>", "t", "x"), (3, 0, "assistant", LONG, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * len(control) and got[2]["loss_chars"] == 0 and got[3]["loss_chars"] == len(LONG)
    assert set(got) == {1, 2, 3, None}
    assert chat_format.read_back(chat_format.format_chat(df.limit(0))).count() == 0
    for text in ("plain <|other|>", control, "", "<|im_start|>", "a<|", "\\<|\\|>"):
        assert [t[:2] for t in chat_format.parse(chat_format.render_turn("r", text))] == [("r", text)]
    assert chat_format.render_turn("r", "plain <|other|>") == "<|im_start|>r\nplain <|other|><|im_end|>\n"


def test_html(spark):
    page = (
        "<html><body><nav>menu</nav><div class='side'>Site text</div><div><h1>T{0}</h1><p>One &amp; {0}<br>two<p>x<b>y</b>z</div><div id=cookie-notice>ok?</div>"
        "<form>f</form><script>var a='</p>'</script><section class='comments'>c</section><footer>f</footer></body></html>"
    )
    rows = [(i, f"http://h/{i}", page.format(i), "q") for i in range(6)] + [(10, None, None, "q"), (11, "http://h/x", "", "q"), (10, "http://o/x", "<p>a</p>", "q"), (None, "http://o/y", "plain", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract_text(df).collect()]
    assert (3, "T3 One & 3 two") in got  # what stands on every page of the host is a template
    assert (10, "") in got and (10, "a") in got and (11, "") in got and (None, "plain") in got and len(got) == 10
    alone = html_text.extract_text(df.where("page_id = 3")).first()["text"]
    assert alone == "Site text T3 One & 3 two xyz"  # a single page shows no template
    assert html_text.extract_text(df.limit(0)).count() == 0
    article = "<body><main><article class=post><h1>H</h1><p>same</p></article><aside>s</aside></main></body>"
    assert html_text.Page(article).text(html_text.Page(article).candidates()[0]) == "H same"


def test_bm25(spark, edge, none):
    found = bm25.search(edge, edge.where("doc_id in (1, 4, 5)").select(F.col("doc_id").alias("query_id"), "text"), k=3).collect()
    by = {(r["query_id"], r["rank"]): r["doc_id"] for r in found}
    assert (1, 1) not in by and by[(4, 1)] == 4 and [by[(5, i)] for i in (1, 2, 3)] == [5, 6, 6]
    assert bm25.search(none, edge.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
    assert bm25.search(edge, edge.limit(0).select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_bm25_shards_give_the_brute_force_result(spark):
    import math

    rng = random.Random(9)
    rows = [(d, " ".join(f"t{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(1, 60)))) for d in range(400)]
    df = documents(spark, rows)
    got = {}
    for r in bm25.search(df, df.where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=5, shard_words=900, block_queries=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    words = {d: bm25.words_of(t) for d, t in rows}
    df_ = {}
    for w in words.values():
        for t in set(w):
            df_[t] = df_.get(t, 0) + 1
    mean = sum(map(len, words.values())) / len(rows)
    idf = {t: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for t, n in df_.items()}
    for q in range(0, 400, 40):
        terms = sorted(set(words[q]), key=lambda t: (-words[q].count(t) * idf[t], t))
        score = {d: round(sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 6) for d, w in words.items()}
        best = sorted((d for d in score if score[d] > 0), key=lambda d: (-score[d], d))[:5]
        assert [got[q][i + 1] for i in range(len(best))] == best


def test_bm25_thresholds_of_the_first_shards_hold_in_the_others(spark, monkeypatch):
    """Every shard once gave its own k best; now those after the first give what can still be among the k best of all."""
    tables = []
    keep = lambda df, label: tables.append((label, bm25_materialize(df, label))) or tables[-1][1]
    bm25_materialize = bm25.materialize
    monkeypatch.setattr(bm25, "materialize", keep)
    rng = random.Random(5)
    rows = [(d, " ".join(f"{'ab'[d % 2]}{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(5, 60)))) for d in range(600)]
    df = documents(spark, rows)
    queries = df.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    one = {tuple(r) for r in bm25.search(df, queries, k=5).collect()}
    many = {tuple(r) for r in bm25.search(df, queries, k=5, shard_words=600).collect()}
    assert one == many and len(many) == 12 * 5
    whole, *parts = [t.count() for label, t in tables if label == "bm25-found"]
    shards = -(-sum(len(t.split()) for _, t in rows) // 600)
    assert whole == 60 and sum(parts) < 12 * 5 * shards / 2


def test_bm25_skips_blocks_below_the_threshold(monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 8)
    monkeypatch.setattr(bm25, "DENSE", 6)
    rng = random.Random(6)
    texts = [" ".join(f"{'ab'[d % 2]}{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(1, 40))) for d in range(200)]
    terms = sorted({w for t in texts for w in bm25.words_of(t)})
    index = bm25.ShardIndex(np.arange(200), texts, terms, 20.0)
    queries = [(np.array([terms.index(w) for w in sorted(set(texts[q].split()))]), np.full(len(set(texts[q].split())), 1.5)) for q in range(20)]
    scored, whole = [], index._whole_scores
    index._whole_scores = lambda docs: scored.append(len(docs)) or whole(docs)
    full = [sorted(zip(s.tolist(), d.tolist(), strict=True)) for d, s in index.search(queries, 10)]
    least = np.array([f[-10][0] for f in full])
    bounded = [sorted(zip(s.tolist(), d.tolist(), strict=True)) for d, s in index.search(queries, 10, least)]
    assert bounded == full and sum(scored) < 20 * 200 / 2
    monkeypatch.setattr(bm25, "SUMS", 500)  # two queries at once
    assert [sorted(zip(s.tolist(), d.tolist(), strict=True)) for d, s in index.search(queries, 10, least)] == full
    high = list(index.search(queries, 10, np.full(20, 1e6)))
    assert all(len(d) == 0 for d, _ in high) and len(high) == 20


def test_bm25_words_are_those_of_the_pattern():
    odd = [chr(i) for i in range(0x3100) if chr(i) != "\ud800"]
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(odd) if rng.random() < 0.4 else rng.choice("abÉß_ -9½²\x1c\x85\u00a0—İ") for _ in range(50))
        assert bm25.words_of(text) == bm25._WORD.findall(text.lower())
        plain = "".join(rng.choice("abÉß_ -9½²\x1c\x85\u00a0—İ") for _ in range(50))
        assert bm25.words_of(plain) == bm25._WORD.findall(plain.lower())


def corpus(spark):
    """Ordinary sentences, junk and toxic texts with labels."""
    rng = random.Random(4)
    good = "the quick brown fox jumps over a lazy dog while many small birds sing in old green trees near quiet water".split()
    rows, marks = [], []
    for d in range(240):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        kind = "junk" if d % 8 == 0 else "toxic" if d % 8 == 1 else "clean"
        if kind == "junk":
            words = [w.upper() + "%%%" for w in words]
        if kind == "toxic":
            words[::5] = ["vile"] * len(words[::5])
        rows.append((d, " ".join(words)))
        if d < 160:
            marks.append((d, int(kind != "junk"), int(kind == "toxic")))
    return documents(spark, rows), labels(spark, marks)


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs, marks = corpus(spark)
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, marks).collect()}
    assert len(kept) == 240 and not any(kept[d] for d in range(0, 240, 8))
    assert sum(kept[d] for d in range(240) if d % 8) >= 205
    clash = docs.withColumn("most", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3))
    good = quality.keep_good(clash, marks)
    assert good.columns == clash.columns and {r["doc_id"] for r in good.collect()} == {d for d, k in kept.items() if k}


class BruteKneserNey:
    """Interpolated modified Kneser-Ney over tuples of symbols, counted in dictionaries."""

    def __init__(self, texts):
        from collections import Counter

        top = Counter()
        for t in texts:
            s = self.symbols(t)
            top.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        self.counts = {4: top}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.size = len(self.counts[1]) + 1
        self.totals = {}
        for k, counts in self.counts.items():
            n = [sum(c == i for c in counts.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] and n[3] else 0
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)] if y else [0.5, 0.75, 0.9]
            held, total = Counter(), Counter()
            for g, c in counts.items():
                held[g[:-1]] += d[min(c, 3) - 1]
                total[g[:-1]] += c
            self.totals[k] = d, held, total

    @staticmethod
    def symbols(text):
        import re

        out, before = ["border"] * 3, None
        for m in re.finditer(r"[\x00-\x20]+|[^\x00-\x20]+", text):
            word = m[0][0] > " "
            out += ["again", *m[0][1:]] if word and m[0] == before else list(m[0])
            before = m[0] if word else before
        return out

    def p(self, gram):
        if not gram:
            return 1 / self.size
        d, held, total = self.totals[len(gram)]
        lower = self.p(gram[1:])
        if gram[:-1] not in total:
            return lower
        c = self.counts[len(gram)].get(gram, 0)
        return ((c - d[min(c, 3) - 1] if c else 0) + held[gram[:-1]] * lower) / total[gram[:-1]]

    def log_p(self, text):
        import math

        s = self.symbols(text)
        return sum(math.log(self.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s)))


def test_quality_equals_a_brute_force_model(spark):
    docs, marks = corpus(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {900: "", 901: "Zz ^ \u4e2d\U0001f600", 902: "fox fox fox"}
    train = [texts[d] for d in range(0, 200, 3)]
    model = quality.train(spark.createDataFrame([(t,) for t in train], "text string"))
    brute = BruteKneserNey(train)
    got = {r["doc_id"]: (r["log_p"], r["chars"]) for r in quality.score(documents(spark, list(texts.items())), model).collect()}
    for d, t in texts.items():
        assert got[d][1] == len(t) and abs(got[d][0] - brute.log_p(t)) < 1e-5 * (1 + abs(got[d][0])), d
    context = ("o", "x", " ")
    symbols = {g[-1] for g in brute.counts[1]} | {"unseen"}
    assert abs(sum(brute.p((*context, s)) for s in symbols) - 1) < 1e-9


def test_quality_learns_from_all_trusted_texts(spark):
    """No trusted text is left out of the model, and all of them set thresholds, each measured by the half it is not in."""
    docs, marks = corpus(spark)
    trusted = marks.where("quality = 1").select("doc_id")
    whole = quality.train(docs.join(trusted, "doc_id", "left_semi"))
    by_id = lambda rows: {r["doc_id"]: r["log_p"] for r in rows.collect()}
    found, want = by_id(quality.score(docs, quality.fit(docs, marks))), by_id(quality.score(docs, whole))
    assert found.keys() == want.keys() and all(abs(found[d] - want[d]) < 1e-5 * (1 + abs(want[d])) for d in want)
    half = {r["doc_id"]: r["h"] for r in trusted.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    brute = [BruteKneserNey([texts[d] for d in sorted(half) if half[d] == h]) for h in (0, 1)]
    logs = {r["doc_id"]: r["logs"] for r in quality.score(docs, quality.fit(docs, marks)).collect()}
    for d in list(texts)[:40]:
        assert all(abs(logs[d][h] - brute[h].log_p(texts[d])) < 1e-5 * (1 + abs(logs[d][h])) for h in (0, 1)), d


def test_separator_is_a_semi_join(spark, monkeypatch):
    docs = spark.range(400).select((F.col("id") % 300).alias("k"), F.col("id").alias("other")).unionByName(spark.sql("select null as k, 1L as other"))
    members = spark.range(500).where("id % 3 = 0").select(F.col("id").alias("k"))
    want = sorted(map(tuple, docs.join(members, "k", "left_semi").collect()))
    for bits, most in ((1 << 23, 1 << 23), (1 << 9, 350), (1 << 9, 50)):  # one filter, several, and the join
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        monkeypatch.setattr(common, "FILTER_MOST", most)
        assert sorted(map(tuple, common.separator(docs, "k", members).collect())) == want
    assert common.separator(docs, "k", members.where("k < 0")).count() == 0


def test_quality_edges(spark, edge, none):
    docs, marks = corpus(spark)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs.unionByName(edge.where("doc_id < 4").withColumn("doc_id", F.col("doc_id") + 1000)), marks).collect()}
    assert got[1001] and got[1002]
    assert quality.classify(edge, labels(spark)).where("kept").count() == 9  # nothing is known, everything stays
    assert quality.keep_good(edge, labels(spark)).count() == 9
    assert quality.classify(none, marks).count() == 0


def test_mixing(spark):
    docs, marks = corpus(spark)
    plan, mixed = mixing.mix(docs, marks)
    plan = {r["doc_id"]: r for r in plan.collect()}
    clean = [plan[d] for d in range(240) if d % 8 > 1]
    assert sum(r["copies"] for r in clean) >= 0.97 * len(clean) and all(r["domain"] == "clean" for r in clean)
    assert sum(plan[d]["copies"] for d in range(1, 240, 8)) <= 6
    total = {k: sum(r["rate"] * r["n_tokens"] * r[f"p_{k}"] for r in plan.values()) for k in mixing.DOMAINS}
    supply = {k: sum(r["n_tokens"] * r[f"p_{k}"] for r in plan.values()) for k in mixing.DOMAINS}
    want = supply["clean"] / mixing.TARGETS["clean"]
    for k in mixing.DOMAINS:
        assert abs(total[k] - min(supply[k], mixing.TARGETS[k] * want)) < 0.03 * supply["clean"]
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan.values())


def test_mixing_edges(spark, edge, none):
    plan, mixed = mixing.mix(edge, labels(spark))
    assert plan.count() == 9 and mixed.count() == 9
    assert mixing.mix(none, labels(spark))[1].count() == 0
