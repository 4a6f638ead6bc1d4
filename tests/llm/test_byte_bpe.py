"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from behaviorlens.llm import byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


EDGES = [
    (1, None), (2, ""), (3, "  a  b \n\n c\t d "), (4, "x" * 5000 + " " + "é" * 300), (5, "՘a   b\x1c c\x85d e"), (6, " lead"), (None, "no <|endoftext|> id"),
    (7, "a\n b"), (7, "中文字符" * 40), (8, "it's we'll 123 456, --- ..."), (9, "\n"), (10, " "), (11, "a  "), (12, "1\U00011de0 \U00011de0x"), (13, "Same words, same words"), (13, "Same words, same words"),
    (14, "  \xa0b  \xa0"), (15, "0123456789" * 7 + " " + "ab" * 31 + " " + "ab" * 32),
]


def test_edges(spark, library):
    rows = [(d, t, 9, "z") for d, t in EDGES]
    got = byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids long, words string")).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in EDGES]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forgetting_words_changes_nothing(spark, library):
    rows = [(i, " ".join(f"wört{(i * k) % 37}" for k in range(200))) for i in range(60)]
    got = byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"), remembered=5).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {d: library.encode_ordinary(t) for d, t in rows}


def test_a_file_whose_tokens_are_not_reached(spark, tmp_path):
    """"abcd" has no pair of tokens that makes it, and "xyz" is ranked below "xy"; a fold by rank would take both."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abcd": 256, b"xyz": 257, b"xy": 258, b"cd": 259}
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    assert set(byte_bpe.Ranks(file.read_bytes()).odd) == {b"abcd", b"xyz"}
    own = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "abcdx xyz wxyzabcdcd xyzxyz"
    got = byte_bpe.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), str(file)).first()["ids"]
    assert got == own.encode_ordinary(text)


def test_merges_by_the_rank_map_are_those_by_sorted_arrays(spark, library):
    from pyspark.sql import functions as F

    ranks = byte_bpe._ranks_of(byte_bpe.RANKS)
    words = [w.encode() for w in (" wörterbuch", "a", "ciónñas", "internationalization", " " * 40, "中文字符" * 5, "x" * 62, "y" * 63)]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    both = df.select("w", byte_bpe._let(ranks.map_column(), lambda r: F.struct(byte_bpe.possible_merges(F.col("w"), r, ranks.longest).alias("m"), byte_bpe.encode_word(F.col("w"), byte_bpe.possible_merges(F.col("w"), r, ranks.longest), r).alias("ids"))).alias("x"))
    found = {bytes(r["w"]): (r["x"]["m"], r["x"]["ids"]) for r in both.collect()}
    assert [found[w][0] for w in words] == byte_bpe.Stretches(ranks.ranks).of(words).to_pylist()
    assert all(found[w][1] == (library.encode_ordinary(w.decode()) if len(w) <= 62 and not w.isspace() else found[w][1]) for w in words)


def test_registered(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.op13_byte_bpe(spark, SF).collect()}
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(t or "")
        want[d] = (len(ids), hexed(",".join(map(str, ids)).encode()), hexed((t or "").encode()))
    assert got == want


def test_words_of_any_length_are_folded_without_python(spark, library):
    """Possible merges are found and merged by higher-order functions alone, of words of more than 62 bytes too."""
    import pyarrow as pa

    ranks = byte_bpe._ranks_of(byte_bpe.RANKS)
    words = [w.encode() for w in (" wörterbuch", "x" * 700, "a", "internationalization", "ab" * 31, "ab" * 31 + "c", "中文字符" * 40, "é" * 150, "the" * 90, " " * 65, "y", "z" * 61, "xyzzy" * 60)]
    given = spark.createDataFrame(pa.table(byte_bpe._by_position(words)))
    tables = spark.createDataFrame(byte_bpe._automaton_of(byte_bpe.RANKS).table, byte_bpe.Automaton.SCHEMA)
    got = given.crossJoin(tables.selectExpr("struct(moves, after, ends, ids) tables")).select(byte_bpe.fold_words(byte_bpe.F.col("tables"), ranks).alias("x")).first()["x"]
    assert got == [byte_bpe.merged(w, ranks.ranks)[0] for w in words]


def test_other_files_are_merged_pair_by_pair(spark):
    ranks = byte_bpe.Ranks(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*(bytes([i]) for i in range(256)), b"abcd", b"xyz", b"xy", b"cd", b"aa"])))
    words = [b"abcdx", b"xyz", b"wxyzab", b"a" * 7, b"a", b"abcd", b"cd" * 40]
    found = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", byte_bpe._let(ranks.map_column(), lambda r: byte_bpe.encode_pairwise(byte_bpe.F.col("w"), r)).alias("x")).collect()
    assert ranks.pairwise
    assert {bytes(r["w"]): r["x"] for r in found} == {w: [ranks.ranks[w]] if w in ranks.ranks else byte_bpe.merged(w, ranks.ranks)[0] for w in words}
