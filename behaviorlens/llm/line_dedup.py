"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is a duplicate of an earlier one when their words are at an edit distance
of at most one word (substituted, inserted or deleted).  Every line that could have such
a neighbour emits its variants with one word deleted as hashed keys; equal keys meet in
a shuffle, where the earliest line of a key is found by an aggregate, never by pairing
the key's lines; the distance of each line and its earliest neighbour is then verified.

Keys of a substitution carry the deleted word's place, so that all lines of a key are
within one word of each other.  An insertion is a key that is the whole line of one
and a variant of another.  So the earliest line of a key decides for all of its lines.

Two lines within one edit agree outside of one half, and of one piece of any finer
cut, so that only lines with such a partner (by hash) need to emit their variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm.common import materialize, table

#: Shorter lines only go as exact copies: one word of so few is too much to call the rest a repeat.
MIN_WORDS = 5
#: Pieces of the finer cut that a line's partners are looked for by.
PIECES = 8


#: ASCII white space within a line; a text without any of the odd kinds is taken as it is.
BLANK = r"[\x20\x09\x0B-\x0D]+"
ODD = ("  ", "\t", "\x0b", "\x0c", "\r")


def _spaced(text: Column) -> Column:
    """The text with one space for each run of white space within a line."""
    odd = F.lit(False)
    for mark in ODD:
        odd = odd | text.contains(mark)
    return F.when(odd, F.regexp_replace(text, BLANK, " ")).otherwise(text)


def _size(plain: Column) -> Column:
    """Number of words of a line with single spaces and none at its ends."""
    return F.when(plain == "", 0).otherwise(F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, plain, n of every line with words."""
    exploded = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(_spaced(F.col("text")), "\n", -1)).alias("line_no", "line"))
    plain = exploded.select("doc_id", "line_no", F.trim("line").alias("plain")).where("plain != ''")
    return plain.withColumn("n", _size(F.col("plain")))


def _span(n: Column, k: Column, g: Column, parts: int) -> tuple[Column, Column]:
    """Words before and after piece g of ``parts`` that are counted off the length k."""
    return F.floor(k * g / parts).cast("int"), F.floor(k * (parts - 1 - g) / parts).cast("int")


def _first_words(plain: Column, k: Column) -> Column:
    return F.call_function("substring_index", plain, F.lit(" "), k)


def _pieces(plain: Column, n: Column, parts: int) -> Column:
    """struct(k, g, key): hashed keys of which two lines within one edit share one.  A key is the
    line without piece g, pieces being counted off the shorter length k that a pair may have."""
    keys = []
    for k in (n, n - 1):
        for g in range(parts):
            head, tail = _span(n, k, F.lit(g), parts)
            key = F.xxhash64(k, F.lit(g), _first_words(plain, head), _first_words(plain, -tail))
            keys.append(F.struct(k.alias("k"), F.lit(g).alias("g"), key.alias("key")))
    return F.array(*keys)


def _with_partner(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of keyed (with a column key) that share their key with another row."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    return keyed.join(shared, "key", "left_semi").select(*columns)


def _line_set(lines: DataFrame, name: str) -> DataFrame:
    """(__doc, name): the line numbers of each document as bits of longs, so that a number is looked up in one step."""
    word, bit = F.expr("cast(line_no div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(line_no % 64 as int))")
    words = lines.groupBy(F.col("doc_id").alias("__doc"), word).agg(F.bit_or(bit).alias("bits"))
    found = words.groupBy("__doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    every = F.sequence(F.lit(0), F.array_max(F.map_keys("bits")))
    return found.select("__doc", F.transform(every, lambda w: F.coalesce(F.element_at("bits", w), F.lit(0).cast("long"))).alias(name))


def _in_line_set(name: str, line_no: Column) -> Column:
    word = F.get(F.col(name), F.floor(line_no / 64).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, (line_no % 64).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def _within_one(a: Column, b: Column) -> Column:
    """Whether the word lists differ by at most one word substituted, inserted or deleted."""
    n, m = F.size(a), F.size(b)
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")

    def tail(words: Column, start: Column) -> Column:
        return F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))

    return (
        F.when(at == 0, True)
        .when(n == m, tail(a, at + 1) == tail(b, at + 1))
        .when(m == n + 1, tail(a, at) == tail(b, at + 1))
        .when(n == m + 1, tail(a, at + 1) == tail(b, at))
        .otherwise(False)
    )


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(dropped, kept): dropped has doc_id, line_no, keep_doc_id, keep_line_no, kind of each
    duplicate, kept has doc_id, line_no of each line with words that stays.

    kind is 'copy' for a line whose words were seen before and 'edit' for the first line of its
    words, min_words or more, when an earlier such line is within one word of it; keep_* name that earlier line,
    the earliest of its neighbours.  Earlier means smaller (doc_id, line_no), lines numbered from 0.
    White space only separates words; case counts.  Null texts have no lines, lines
    without words are never duplicates, rows of null doc_id take no part,
    and rows that repeat a doc_id share the decisions on its line numbers.
    Very long lines are handled whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    where = F.struct("doc_id", "line_no")
    plain, n = F.col("plain"), F.col("n")
    seen = materialize(
        _lines(docs).select(
            "doc_id", "line_no", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("second"), plain).alias("h2"),
            F.when(n >= min_words, F.transform(_pieces(plain, n, 2), lambda p: p["key"])).alias("keys"),
        ), "lines",
    )
    first = materialize(seen.groupBy("h1", "h2").agg(F.min(where).alias("at"), F.first("keys").alias("keys")), "first-lines")
    possible = _with_partner(first.select("at.*", F.explode("keys").alias("key")), ["doc_id", "line_no"])
    # Texts travel once, with the numbers of their possible lines.
    wanted = _line_set(possible, "__lines")
    texts = docs.join(wanted, F.col("doc_id") == F.col("__doc"))
    numbered = F.transform(F.split(_spaced(F.col("text")), "\n", -1), lambda line, i: F.struct(i.alias("line_no"), F.trim(line).alias("plain")))
    chosen = texts.select("doc_id", F.inline(F.filter(numbered, lambda x: _in_line_set("__lines", x["line_no"]))))
    lines = chosen.withColumn("n", _size(plain)).where(n >= min_words).dropDuplicates(["doc_id", "line_no"])
    lines = materialize(lines.select(where.alias("at"), "plain", "n"), "possible-lines")
    pieces = lines.select("at", F.inline(_pieces(plain, n, PIECES)))
    found = _with_partner(pieces, ["at", "k", "g"]).groupBy("at").agg(F.collect_set(F.struct("k", "g")).alias("spans"))
    lines = materialize(lines.join(found, "at"), "close-lines")

    def places(span: Column) -> Column:
        """Places of the words of a piece that a partner may lack or replace."""
        head, tail = _span(n, span["k"], span["g"], PIECES)
        return F.sequence(head + 1, n - tail)

    def variant(p: Column) -> Column:
        """A hash of the line without word p."""
        return F.xxhash64(F.trim(F.concat_ws(" ", _first_words(plain, p - 1), _first_words(plain, p - n))))

    place = F.array_distinct(F.flatten(F.transform("spans", places)))
    each = lines.select("at", F.explode(F.transform(place, lambda p: F.struct(p.alias("p"), variant(p).alias("v")))).alias("x"))
    kinds = F.array(F.struct(F.lit("s").alias("kind"), F.xxhash64("x.p", "x.v").alias("key")), F.struct(F.lit("i").alias("kind"), F.col("x.v").alias("key")))
    emitted = each.select("at", F.inline(kinds)).distinct().unionByName(lines.select("at", F.lit("f").alias("kind"), F.xxhash64(plain).alias("key")))
    emitted = materialize(emitted, "variants")
    earliest = emitted.groupBy("key").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"first_{k}") for k in "sif"], F.count("*").alias("n")
    ).where("n > 1").drop("n")
    kind = F.col("kind")
    partner = F.when(kind == "s", F.col("first_s")).when(kind == "i", F.col("first_f")).otherwise(F.col("first_i"))
    found = (
        emitted.join(earliest, "key").select("at", partner.alias("before"))
        .where(F.col("before") < F.col("at")).distinct()
    )
    lines = lines.select("at", F.split("plain", " ").alias("words"))
    before = lines.select(F.col("at").alias("before"), F.col("words").alias("before_words"))
    near = (
        found.join(lines, "at").join(before, "before").where(_within_one(F.col("words"), F.col("before_words")))
        .groupBy("at").agg(F.min("before").alias("before"))
    )
    near = materialize(near, "near-lines")
    copies = seen.select("doc_id", "line_no", "h1", "h2").join(first.select("h1", "h2", "at"), ["h1", "h2"]).where(where != F.col("at"))
    columns = ["doc_id", "line_no", "keep_doc_id", "keep_line_no", "kind"]

    def rows(df: DataFrame, source: str, target: str, what: str) -> DataFrame:
        return df.select(
            F.col(f"{source}doc_id").alias("doc_id"), F.col(f"{source}line_no").alias("line_no"),
            F.col(f"{target}.doc_id").alias("keep_doc_id"), F.col(f"{target}.line_no").alias("keep_line_no"), F.lit(what).alias("kind"),
        ).select(columns)

    dropped = rows(copies, "", "at", "copy").unionByName(rows(near, "at.", "before", "edit"))
    kept = first.select("at").join(near.select("at"), "at", "left_anti").select("at.*")
    return dropped, kept


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with duplicate lines taken out of text; all columns and rows stay.  A text whose
    lines all go becomes empty.  Rows of null doc_id or null text are unchanged."""
    kept = _line_set(duplicate_lines(docs, min_words)[1], "__kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), "text").join(kept, F.col("key") == F.col("__doc"), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda line, i: (F.trim(_spaced(line)) == "") | _in_line_set("__kept", i))
    text = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.when(F.col("text").isNotNull(), F.concat_ws("\n", lines)))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {
    "op3_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, (i - 1)::INT AS line_no,
                   string_split(trim(regexp_replace(a[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w
            FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
        c AS (SELECT doc_id, line_no, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, line_no) AS r,
                     first_value(doc_id) OVER (PARTITION BY w ORDER BY doc_id, line_no) AS kd,
                     first_value(line_no) OVER (PARTITION BY w ORDER BY doc_id, line_no) AS kl FROM l WHERE w <> ['']),
        f AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS seq, doc_id, line_no, w FROM c WHERE r = 1 AND len(w) >= 5),
        v AS (SELECT seq, p, array_to_string(w[1:p - 1] || w[p + 1:], ' ') AS v FROM f, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
        s AS (SELECT seq, min(seq) OVER (PARTITION BY p, v) AS before FROM v),
        x AS (SELECT v.seq AS d, f.seq AS e FROM v JOIN f ON v.v = array_to_string(f.w, ' ')),
        n AS (SELECT seq, min(before) AS before FROM (
                  SELECT seq, before FROM s UNION ALL SELECT greatest(d, e), least(d, e) FROM x) WHERE before < seq GROUP BY seq)
        SELECT doc_id, line_no, kd AS keep_doc_id, kl AS keep_line_no, 'copy' AS kind FROM c WHERE r > 1
        UNION ALL
        SELECT a.doc_id, a.line_no, b.doc_id, b.line_no, 'edit' FROM n JOIN f a ON a.seq = n.seq JOIN f b ON b.seq = n.before"""
}
