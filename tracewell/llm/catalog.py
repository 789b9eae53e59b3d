"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from tracewell.llm import (
    align,
    ann,
    bpe,
    chat,
    html_text,
    mixing,
    ngram_join,
    pii,
    prefix_trie,
    rules,
    shards,
    simhash,
    tokencount,
)
from tracewell.llm.common import Query

MODULES = (bpe, tokencount, shards, mixing, chat, rules, pii, ngram_join, html_text, ann, simhash, align, prefix_trie)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
