"""Queries of the training-data operators and the SQL of those SQL can express."""

from __future__ import annotations

from behaviorlens.llm import (
    bm25,
    byte_bpe,
    chat_format,
    exact_dedup,
    hard_negatives,
    html_text,
    line_dedup,
    maxscore,
    mixing,
    ngram_join,
    packing,
    quality,
    token_store,
)

MODULES = (
    bm25,
    byte_bpe,
    chat_format,
    exact_dedup,
    hard_negatives,
    html_text,
    line_dedup,
    maxscore,
    mixing,
    ngram_join,
    packing,
    quality,
    token_store,
)


def queries():
    found = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql():
    found = {}
    for module in MODULES:
        found.update(getattr(module, "ORACLE_SQL", {}))
    return found
