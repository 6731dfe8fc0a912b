"""Registered queries of the engine."""

from __future__ import annotations

from spanledger.plans import answer_queries, claim_queries, document_queries, text_queries

_MODULES = [text_queries, claim_queries, document_queries, answer_queries]


def queries() -> dict:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}


def flagship(spark, sf_dir: str):
    """BM25 ranking of the documents for every benchmark question."""
    return text_queries.bm25_topk(spark, sf_dir)
