"""Incremental ingest: a file stream becomes documents, passages and claims, once each.

Every micro-batch is a batch job on the new files; exact copies of stored documents (by SHA-256 in the workspace) are
left out by an anti-join. All tables of a batch change in one transaction (:mod:`spanledger.streaming.store`): a batch
that dies is finished or dropped when the next one begins, and its replay finds what is stored. Derived rows are
replaced, never patched: deleting, re-indexing, a new date and retention are changes of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.text import date_key
from spanledger.operators import graph, passages
from spanledger.sources import formats
from spanledger.streaming.store import PARTS, Store

STAGES = {"UPLOADED": 5, "PROCESSING": 8, "EXTRACTING": 20, "OCR": 35, "CHUNKING": 55, "EMBEDDING": 72, "INDEXING": 90, "READY": 100, "FAILED": 100}
DERIVED = ("passages", "claims")


def _stages(docs: DataFrame) -> DataFrame:
    way = F.when(F.col("status") == "READY", F.array(*[F.lit(s) for s in ("UPLOADED", "EXTRACTING", "CHUNKING", "INDEXING", "READY")])).otherwise(F.array(F.lit("UPLOADED"), F.lit("EXTRACTING"), F.lit("FAILED")))
    return docs.select("doc_id", F.posexplode(way).alias("step", "stage"), F.current_timestamp().alias("ts"), *PARTS)


def _derived(docs: DataFrame) -> dict[str, DataFrame]:
    """Passages and claims of documents, in the documents' partitions."""
    ready = docs.where("status = 'READY'")
    chunks = graph.cut(passages.chunks(ready).join(ready.select("doc_id", *PARTS), "doc_id"))
    return {"passages": chunks, "claims": passages.claims(chunks).join(ready.select("doc_id", *PARTS), "doc_id")}


def store_batch(files: DataFrame, root: str, workspace: str, plugins: dict | None = None) -> None:
    """Read, deduplicate and store one batch of ``name``, ``content``; of equal files the one with the first name."""
    store = Store(files.sparkSession, root)
    store.recover()
    docs = formats.read_files(files, plugins).withColumn("doc_id", F.substring(F.sha1(F.concat_ws("|", F.lit(workspace), "sha256", "name")), 1, 12))
    docs = docs.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in docs.columns]), "name").alias("d")).select("d.*")
    known = store.read("documents", workspace).where("status != 'FAILED'").select("sha256")
    docs = graph.cut(store.located(docs.join(known, "sha256", "left_anti"), workspace, store.new_batch()))
    if docs.isEmpty():
        return
    new = {"documents": docs, **_derived(docs), "status": _stages(docs)}
    store.change({name: (rows, None) for name, rows in new.items()})


def ingest_stream(spark: SparkSession, inbox: str, root: str, workspace: str = "public", plugins: dict | None = None, **trigger):
    """Start the stream over a folder; by default it takes what is there and ends."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(inbox)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.writeStream.foreachBatch(lambda df, _: store_batch(df, root, workspace, plugins)).option("checkpointLocation", f"{root}/_checkpoint/{workspace}").trigger(**(trigger or {"availableNow": True})).start()


def _chosen(store: Store, workspace: str, ids: DataFrame) -> DataFrame:
    return store.read("documents", workspace).join(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")


def delete_documents(store: Store, workspace: str, ids: DataFrame) -> None:
    """Remove documents (``doc_id``) and everything derived from them."""
    gone = graph.cut(_chosen(store, workspace, ids).select("doc_id", *PARTS))
    store.change({name: (None, gone) for name in ("documents", *DERIVED, "status", "vectors")})


def reindex(store: Store, workspace: str, ids: DataFrame) -> None:
    """Make passages and claims of documents (``doc_id``) anew from their stored pages."""
    docs = graph.cut(_chosen(store, workspace, ids))
    new = {**_derived(docs), "status": _stages(docs)}
    store.change({name: (rows, docs) for name, rows in new.items()})


def set_days(store: Store, workspace: str, days: DataFrame) -> None:
    """Give documents (``doc_id``) another partial date (``day``: year, month or day, or null); others are an error."""
    bad = days.where(~F.col("day").rlike(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$")).limit(1).collect()
    if bad:
        raise ValueError(f"not a date: {bad[0]['day']}")
    told = days.select("doc_id", F.col("day").alias("__day"))
    docs = graph.cut(store.read("documents", workspace).join(told, "doc_id").withColumn("day", F.col("__day")).withColumn("day_source", F.when(F.col("day").isNotNull(), "set by hand")).drop("__day"))
    store.change({"documents": (docs, docs)})


def purge(store: Store, workspace: str, keep_after: str) -> None:
    """Delete the documents that are dated before ``keep_after`` (a day); undated ones stay."""
    old = store.read("documents", workspace).where(F.col("day").isNotNull() & (date_key(F.col("day")) < keep_after))
    delete_documents(store, workspace, old.select("doc_id"))


def gaps(store: Store, workspace: str) -> DataFrame:
    """``doc_id``, ``gap``: readable documents with text but no passages (``missing``), and derived rows without a document (``orphan``)."""
    docs = store.read("documents", workspace)
    held = store.read("passages", workspace).select("doc_id").distinct()
    text = docs.where((F.col("status") == "READY") & F.exists("pages", lambda p: F.trim(p["text"]) != ""))
    missing = text.select("doc_id").join(held, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("gap"))
    orphan = None
    for name in (*DERIVED, "vectors"):
        rows = store.read(name, workspace).select("doc_id").distinct()
        orphan = rows if orphan is None else orphan.unionByName(rows)
    return missing.unionByName(orphan.distinct().join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("gap")))


def reconcile(store: Store, workspace: str) -> int:
    """Finish interrupted changes and mend every gap; returns how many documents were mended."""
    store.recover()
    found = graph.cut(gaps(store, workspace))
    n = found.count()
    orphans = found.where("gap = 'orphan'").select("doc_id")
    if not orphans.isEmpty():
        for name in (*DERIVED, "vectors"):
            rows = store.read(name, workspace).join(orphans, "doc_id", "left_semi").select("doc_id", *PARTS)
            store.change({name: (None, rows)})
    reindex(store, workspace, found.where("gap = 'missing'").select("doc_id"))
    return n


def embed(store: Store, workspace: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> int:
    """Bring the vectors in line with the passages; returns how many texts the embedder saw.

    Documents whose vectors are not those of their passages (by position and hash of the text) get theirs anew: from the
    vectors of equal texts that are stored, and for the rest from ``embedder``, once for each distinct text, in batches
    inside tasks.
    """
    p = store.read("passages", workspace).select("doc_id", "idx", F.xxhash64("text").alias("hash"), "text", *PARTS)
    have = store.read("vectors", workspace)
    both = p.select("doc_id", "idx", "hash", F.lit(1).alias("p")).join(have.select("doc_id", "idx", "hash", F.lit(1).alias("v")), ["doc_id", "idx", "hash"], "full")
    stale = graph.cut(both.where("p is null or v is null").select("doc_id").distinct())
    wanted = graph.cut(p.join(stale, "doc_id", "left_semi"))
    kept = have.groupBy("hash").agg(F.min("vector").alias("vector"))
    missing = graph.cut(wanted.groupBy("hash").agg(F.min("text").alias("text")).join(kept, "hash", "left_anti"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"hash": part["hash"], "vector": [list(map(float, v)) for v in embedder(part.text.tolist())]})

    fresh = missing.mapInPandas(run, "hash long, vector array<double>")
    vectors = graph.cut(wanted.drop("text").join(kept.join(wanted.select("hash").distinct(), "hash", "left_semi").unionByName(fresh), "hash"))
    gone = have.join(stale, "doc_id", "left_semi").select("doc_id", *PARTS)
    if not stale.isEmpty():
        store.change({"vectors": (vectors, gone)})
    return missing.count()


def stage_now(status: DataFrame) -> DataFrame:
    """Latest stage and progress of every document."""
    progress = F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))])
    g = status.groupBy("doc_id").agg(F.max_by("stage", F.struct("ts", "step")).alias("stage"))
    return g.withColumn("progress", progress[F.col("stage")])
