"""The operators do the whole job: each test here fails on a version that cut it."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import bm25, html_text, line_dedup, ngram_join, registry
from tests.llm.test_edges import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def same_rows(found, want):
    columns = sorted(found.columns)
    return sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_bm25_scores_all_words_of_a_query(spark, tables):
    rare, common = [f"r{i}" for i in range(40)], [f"c{i}" for i in range(40)]
    rows = [(0, " ".join(rare + common))] + [(d, " ".join(common[:d])) for d in range(1, 41)]
    df = documents(spark, rows)
    found = bm25.search(df, df.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "text"), k=50).collect()
    assert {r["doc_id"] for r in found} == set(range(41))  # most share only words of small idf with the query
    sql = registry.oracle_sql()["op8_bm25"]
    assert "32" not in sql and same_rows(registry.queries()["op8_bm25"](spark, SF), tables.sql(sql))


def test_html_with_a_capital_dotted_i():
    page = "<html><head><title>\u0130</TITLE><style>p{}</style></head><body><p>text of \u0130zmir</p></body></html>"
    assert html_text.Page(page).text(set()) == "text of \u0130zmir"


def test_html_copies_of_a_page_are_no_templates(spark):
    alone = "<body><div><p>first of {0}</p></div><div>second of {0}</div></body>"
    rooted = "<body><article><h1>T{0}</h1><section>part of {0}</section></article></body>"
    rows = [(i, f"http://h/{i}", alone.format("x")) for i in range(10)] + [(10 + i, "http://h/same", rooted.format("y")) for i in range(10)]
    rows += [(20 + i, f"http://h/o{i}", f"<body><div>Site</div><div>only {i}</div></body>") for i in range(5)]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert {got[i] for i in range(10)} == {"first of x second of x"} and {got[i] for i in range(10, 20)} == {"Ty part of y"}
    assert [got[20 + i] for i in range(5)] == [f"only {i}" for i in range(5)]


@pytest.mark.parametrize("wrapper", ["no-sidebar", "elementor-widget", "has-menu", "widget", "search-page"])
def test_html_wrappers_of_the_article_stay(wrapper):
    for inner in ("<article><p>whole body text</p></article>", "<main><p>whole body text</p></main>", "<div class=post><p>whole body text</p></div>"):
        page = f"<body><p>Logo</p><div class='{wrapper}'>{inner}</div><div class=sidebar>side bar</div></body>"
        assert html_text.Page(page).text(set()) == "whole body text"
    inside = f"<body><main><h1>T</h1><div class='{wrapper}'><article>whole body text</article></div></main></body>"
    assert "whole body text" in html_text.Page(inside).text(set())


def test_html_labelled_boxes_still_go():
    page = "<body><main><p>the body of the page</p><div class='related-posts'><article>teaser</article></div><div id=ad-1>ad</div></main></body>"
    assert html_text.Page(page).text(set()) == "the body of the page"
    page = "<body><article><p>short</p></article><section class=comments><article>a longer remark of a reader</article></section></body>"
    assert html_text.Page(page).text(set()) == "short"


def brute_links(rows, n, percent):
    """Of each document, how many distinct sets other than its own link with it."""
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    distinct = set(sets.values())
    return {d: sum(100 * len(s & o) >= percent * len(s | o) for o in distinct if s and o and o != s) for d, s in sets.items()}


@pytest.mark.parametrize("nodes", [256, 7])
def test_ngram_join_counts_every_link(spark, monkeypatch, nodes):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    monkeypatch.setattr(ngram_join, "SIGNED_NODES", nodes)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = [(d, " ".join([*base[: 80 - d % 3], f"x{d}"])) for d in range(3)]  # three texts that all link
    for d in range(10, 60):  # a group of near copies that do not all link, and exact copies
        words = [f"g{i}" for i in range(60)]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"v{rng.randrange(30)}"
        rows.append((d, " ".join(words)))
    rows += [(100 + d, " ".join(f"u{rng.randrange(300)}" for _ in range(rng.randrange(40)))) for d in range(40)]
    rows += [(200, " ".join(f"t{i}" for i in range(70))), (201, " ".join(f"t{i}" for i in range(69)))]
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_components(documents(spark, rows), 3, 80).collect()}
    assert got == brute_links(rows, 3, 80) and got[0] == got[1] == got[2] == 2 and got[200] == 1


def test_line_dedup_takes_exact_copies_of_short_lines(spark, tables):
    df = documents(spark, [(1, "Les.\n\none two three four\n"), (2, "\n Les. \none two three five\nLes\n\t"), (3, "one two three four")])
    got = {(r["doc_id"], r["line_no"], r["keep_doc_id"], r["keep_line_no"], r["kind"]) for r in line_dedup.duplicate_lines(df)[0].collect()}
    assert got == {(2, 1, 1, 0, "copy"), (3, 0, 1, 2, "copy")}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert texts == {1: "Les.\n\none two three four\n", 2: "\none two three five\nLes\n\t", 3: ""}
    assert same_rows(registry.queries()["op3_line_dedup"](spark, SF), tables.sql(registry.oracle_sql()["op3_line_dedup"]))


def test_line_dedup_of_a_text_of_many_lines_and_clashing_columns(spark):
    text = "\n".join(f"line number {i % 700} of this long text" for i in range(5000))
    df = documents(spark, [(1, text), (2, "line number 3 of this long text")]).withColumn("__kept", F.lit(7)).withColumn("row", F.lit(8))
    got = {r["doc_id"]: (r["text"], r["__kept"], r["row"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got[2] == ("", 7, 8) and got[1][1:] == (7, 8) and got[1][0] == "line number 0 of this long text"  # one word apart
