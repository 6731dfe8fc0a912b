"""Registered queries on whole documents: extraction, passages, claims. Sequential parsing has no SQL; tests check it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from spanledger.operators import passages
from spanledger.session import table
from spanledger.sources import formats


#: Pages whose texts a worker holds at once.
PAGES = 128


def html_extract(spark, d):
    """Text and title of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES):
                b = whole.slice(at, PAGES)
                got = [formats.markup(h.as_py() or "") for h in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for _, t in got], pa.string()), pa.array([x for x, _ in got], pa.string())], names=["page_id", "title", "text"])

    return table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, title string, text string")


def chunk_documents(spark, d):
    """All passages, and whether each is its page's slice."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    c = passages.chunks(passages.one_page(docs, "doc_id", "text"))
    return c.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("page_text")), "doc_id").select("doc_id", "idx", "start", "end", "section", (F.substring("page_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("is_slice"))


def claim_rows(spark, d):
    """Claims of all documents by kind."""
    docs = table(spark, d, "documents")
    c = passages.claims(passages.chunks(passages.one_page(docs, "doc_id", "text")))
    return c.groupBy("doc_id", "kind").agg(F.count("*").alias("n_claims"), F.sum(F.size("quantities")).alias("n_values"))


QUERIES = [html_extract, chunk_documents, claim_rows]
ORACLE: dict[str, str] = {}
