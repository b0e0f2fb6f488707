"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, exact_dedup, merkle, mixing, ngram_join, packing, pii, quality, spelling, substring_dedup, toxicity, vectors, warc

MODULES = (substring_dedup, ngram_join, pii, mixing, vectors, quality, exact_dedup, toxicity, packing, chat, merkle, warc, spelling)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
