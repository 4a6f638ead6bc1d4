"""The registered queries over the smallest tables: against their SQL, or against a brute-force version."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from behaviorlens.llm import registry
from tests.llm.test_edges import brute_components

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def test_every_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = sorted(map(repr, tables.sql(SQL[name]).project(", ".join(columns)).fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == want


def texts(tables):
    return tables.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_ngram_join(spark, tables):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op1_ngram_join"](spark, SF).collect()}
    assert got == brute_components(texts(tables), 3, 90)


def encoded(tables, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    rows = texts(tables)
    return {d: np.array([*e.ids, end], "<u4") for (d, _), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}


def test_token_store(spark, tables):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_token_store"](spark, SF).collect()}
    at, want = 0, {}
    for d, ids in sorted(encoded(tables, "word_bpe_49k.json", 2).items()):
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_packing(spark, tables):
    pieces = QUERIES["op7_pack"](spark, SF).collect()
    ids = encoded(tables, "byte_bpe_50k.json", 0)
    fill, by_doc = {}, {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        fill.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for spans, total in [(by_doc[d], len(ids[d])) for d in ids] + [(v, None) for v in fill.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 1024 if total is None else at == total
    tokens = sum(map(len, ids.values()))
    assert len(fill) <= -(-tokens // 1024) * 1.03 + 1


def test_pages(spark, tables):
    import html
    import re

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op6_html_text"](spark, SF).collect()}
    for page, source in tables.sql("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())
        assert got[page] == (want, len(want))


def test_quality_on_held_out_labels(spark):
    """On sf0.01: the smallest tables leave some ten trusted documents of a language for training."""
    larger = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op10_quality"](spark, larger).collect()}
    marks = duckdb.sql(f"SELECT doc_id, quality FROM '{larger}/labels.parquet'").fetchall()
    good, bad = [kept[d] for d, q in marks if q], [kept[d] for d, q in marks if not q]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_mixing_covers_every_document(spark, tables):
    rows = QUERIES["op4_mixing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == [d for d, _ in texts(tables)]
    assert all(0 <= r["rate"] <= 1 and r["copies"] in (0, 1) and abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in rows)


def test_pipeline(spark, tables):
    import corpus_pipeline

    documents = docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, seen = [docs.count()], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        seen.append(docs)
        if name != "packing":
            assert docs.columns == documents.columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] <= counts[3] <= counts[2]
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    want = {d for d, (_, c) in brute_components(rows, 5, 80).items() if c == d}
    assert {r["doc_id"] for r in seen[2].collect()} == want
    # Line dedup leaves few near copies, so the stage is also held against all documents.
    whole = {d for d, (_, c) in brute_components(texts(tables), 5, 80).items() if c == d}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, documents, SF).collect()}
    assert kept == whole and len(kept) < counts[0]
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in seen[3].collect()}
