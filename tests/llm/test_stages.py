"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from tests.llm.test_edges import LONG, documents, edge_rows

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "key", "maybe", "__kept", "__doc", "copies", "most"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_edge_rows(spark, name, stage):
    df = documents(spark, edge_rows())
    for c in CLASHES:
        df = df.selectExpr("*", f"'{c}' AS `{c}`")
    found = stage(spark, df, SF)
    assert stage(spark, df.limit(0), SF).count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, 4, 5, 6, 7, None}
        return
    assert found.columns == df.columns
    rows = found.collect()
    assert all(r[c] == c for r in rows for c in CLASHES)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[1] is None and texts[2] == ""
    if name == "line_dedup":
        assert texts[4] == LONG and texts[6] == "" and texts[None] == "no id at all here" and len(rows) == 9
    if name == "ngram_join":
        assert sorted(r["doc_id"] or -1 for r in rows) == [-1, 1, 2, 3, 4, 5, 7]


def test_packing_holds_small_batches_and_gives_memory_back(monkeypatch):
    """A long document and many empty ones: no Arrow batch is larger than ROWS, every piece comes, and memory is given back within the task."""
    import public_tokenizers
    import pyarrow as pa

    from behaviorlens.llm import packing

    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(packing, "KEPT_BYTES", 1 << 16, raising=False)
    texts = ["some words of prose " * 100_000, *[""] * 3000, "more words " * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    found = list(packing._pack_task([batch], str(public_tokenizers.path("byte_bpe_50k.json")), 0, 1024, 48, 50_000, 1 << 16))
    assert max(b.num_rows for b in found) <= 256 and calls
    rows = [r for b in found for r in b.to_pylist()]
    have = {}
    for r in rows:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
    assert have == {r["doc_id"]: r["doc_tokens"] for r in rows} and len(have) == len(texts)
