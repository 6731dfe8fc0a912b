"""Stored tables under deletion, re-indexing, dead writers, embeddings; stages as a stream."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanledger.plans.workspace import Workspace
from spanledger.streaming import ingest, stages
from spanledger.streaming.store import PARTS, SCHEMAS, Store

TABLES = ("documents", "passages", "claims", "status")


def write_inbox(path, names):
    path.mkdir(exist_ok=True)
    for n in names:
        (path / f"{n}.txt").write_text(f"The fee of {n} is $1,{len(n):02d}0 per year. It is due within {10 + len(n)} days.")


def content(ws):
    return {t: sorted(map(str, (r.asDict(recursive=True) for r in ws._table(t).drop("ts", "batch").collect()))) for t in TABLES}


def files_of(root, table):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/{table}") for f in fs if f.endswith(".parquet")}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def test_delete_and_reindex_touch_their_buckets_only(spark, tmp_path):
    write_inbox(tmp_path / "in", [f"doc{'x' * k}" for k in range(12)])
    ws = Workspace(spark, str(tmp_path / "store"))
    ws.ingest(str(tmp_path / "in"))
    docs = ws.documents().collect()
    victim, other = docs[0], next(d for d in docs if d["bucket"] != docs[0]["bucket"])
    before = {t: files_of(ws.root, t) for t in TABLES}
    ws.delete(ids(spark, victim["doc_id"]))
    for t in TABLES:
        assert ws._table(t).where(F.col("doc_id") == victim["doc_id"]).count() == 0 and ws._table(t).select("doc_id").distinct().count() == 11
        after = files_of(ws.root, t)
        kept = {f: m for f, m in before[t].items() if f"bucket={victim['bucket']}/" not in f}
        assert kept.items() <= after.items() and any(f not in after for f in before[t])
    # a changed page is seen by passages and claims after re-indexing, and the document has no stale ones
    row = ws._table("documents").where(F.col("doc_id") == other["doc_id"])
    changed = row.withColumn("pages", F.transform("pages", lambda p: F.struct(p["number"].alias("number"), F.lit("The yearly fee of the service is $77 for all.").alias("text"))))
    ws.store.change({"documents": (ingest.graph.cut(changed), row.select("doc_id", "workspace_id", "batch", "bucket"))})
    ws.reindex(ids(spark, other["doc_id"]))
    assert [r["text"] for r in ws._table("passages").where(F.col("doc_id") == other["doc_id"]).collect()] == ["The yearly fee of the service is $77 for all."]
    assert [r["sentence"] for r in ws.claims(other["doc_id"]).collect()] == ["The yearly fee of the service is $77 for all."] and ws.documents().count() == 11
    # the last document of a folder: the folder goes
    ws.delete(ws.documents().select("doc_id"))
    assert all(ws._table(t).count() == 0 for t in TABLES)
    ws.delete(ids(spark, "unknown"))


@pytest.mark.parametrize("dies_at", ["staging", "plan", "first table"])
def test_a_writer_that_dies_leaves_whole_tables(spark, tmp_path, monkeypatch, dies_at):
    write_inbox(tmp_path / "in", ["a", "bb", "ccc"])
    whole = Workspace(spark, str(tmp_path / "whole"))
    whole.ingest(str(tmp_path / "in"))
    ws = Workspace(spark, str(tmp_path / "store"))

    def dying(self, txn, plan):
        if dies_at == "first table":
            staged = self.spark.read.schema(SCHEMAS["documents"]).parquet(f"{txn}/documents")
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{self.root}/documents")
        raise RuntimeError("died")

    if dies_at == "staging":
        monkeypatch.setattr(ingest, "_stages", lambda docs: docs.select("no_such_column"))
    else:
        monkeypatch.setattr(Store, "_apply", dying)
    with pytest.raises(Exception):
        ws.ingest(str(tmp_path / "in"))
    monkeypatch.undo()
    ws.ingest(str(tmp_path / "in"))  # replays the batch after the recovery
    assert content(ws) == content(whole) and not os.listdir(f"{ws.root}/_pending")
    ws.ingest(str(tmp_path / "in"))
    assert content(ws) == content(whole)


def test_dates_retention_and_reconciling(spark, tmp_path):
    write_inbox(tmp_path / "in", ["a_2019-05-01", "b_2024-05-01", "c"])
    ws = Workspace(spark, str(tmp_path / "store"))
    ws.ingest(str(tmp_path / "in"))
    by_name = {r["name"]: r["doc_id"] for r in ws.documents().collect()}
    ws.set_days(spark.createDataFrame([(by_name["c.txt"], "2020-03")], "doc_id string, day string"))
    assert {r["name"]: r["day"] for r in ws.documents().collect()}["c.txt"] == "2020-03"
    with pytest.raises(ValueError):
        ws.set_days(spark.createDataFrame([(by_name["c.txt"], "soon")], "doc_id string, day string"))
    # lose a document's passages and keep a claim without its document: both are gaps
    parts = ["doc_id", "workspace_id", "batch", "bucket"]
    c = ws._table("documents").where(F.col("doc_id") == by_name["c.txt"]).select(*parts)
    ws.store.change({"passages": (None, c)})
    b = ws._table("documents").where(F.col("doc_id") == by_name["b_2024-05-01.txt"]).select(*parts)
    ws.store.change({"documents": (None, b)})
    assert {(r["doc_id"], r["gap"]) for r in ws.gaps().collect()} == {(by_name["c.txt"], "missing"), (by_name["b_2024-05-01.txt"], "orphan")}
    assert ws.reconcile() == 2 and ws.gaps().count() == 0
    assert ws._table("claims").select("doc_id").distinct().count() == 2 and ws._table("passages").where(F.col("doc_id") == by_name["c.txt"]).count() == 1
    ws.purge("2020-01-01")
    assert [r["name"] for r in ws.documents().collect()] == ["c.txt"] and ws._table("passages").select("doc_id").distinct().count() == 1


def test_vectors_follow_the_passages(spark, tmp_path):
    write_inbox(tmp_path / "in", ["a", "bb"])
    ws = Workspace(spark, str(tmp_path / "store"))
    ws.ingest(str(tmp_path / "in"))
    embedder = lambda texts: [[float(len(t)), float(t.count("e")), 1.0] for t in texts]
    assert ws.embed(embedder) == 2 and ws.embed(embedder) == 0
    first = ws.documents().first()["doc_id"]
    ws.delete(ids(spark, first))
    assert ws._table("vectors").where(F.col("doc_id") == first).count() == 0 and ws.embed(embedder) == 0
    write_inbox(tmp_path / "in", ["ccc"])
    ws.ingest(str(tmp_path / "in"))
    assert ws.embed(embedder) == 1 and ws._table("vectors").count() == 2
    q = spark.createDataFrame([("q", "What is the fee?")], "question_id string, question string")
    hits = ws.search(q, embedder=embedder).collect()
    assert len(hits) == 2 and {"lexical", "character", "dense"} <= set(hits[0]["channels"])


def machine(rows, order, final):
    """The state machine in plain Python: rows in order of time."""
    out, state = [], {}
    for d, s, t in sorted(rows, key=lambda r: (r[2], order.index(r[1]) if r[1] in order else len(order), r[1])):
        at, done = state.get(d, (-1, False))
        moves = not done and s in order and order.index(s) > at
        out.append((d, s, t, "advanced" if moves else "refused"))
        if moves:
            state[d] = (order.index(s), s in final)
    return sorted(out, key=str)


def run_stream(spark, folder, out, checkpoint):
    s = spark.readStream.schema("doc_id string, stage string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(folder)
    q = stages.transitions(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stages.SCHEMA).parquet(out).collect()
    return sorted(((r["doc_id"], r["stage"], r["ts"], r["kind"]) for r in rows), key=str)


def test_stage_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    first = [("a", "UPLOADED", at(0)), ("a", "EXTRACTING", at(1)), ("b", "UPLOADED", at(0)), ("b", "CHUNKING", at(2)), ("b", "EXTRACTING", at(3)), ("c", "UPLOADED", at(1)), ("c", "FAILED", at(2)), ("d", "SLEEPING", at(2))]
    second = [("a", "READY", at(5)), ("a", "INDEXING", at(6)), ("c", "READY", at(6)), ("e", "UPLOADED", at(90))]
    third = [("b", "READY", at(95)), ("e", "EXTRACTING", at(96))]
    folder = tmp_path / "log"
    folder.mkdir()

    def put(k, rows):
        pd.DataFrame([(d, s, t.isoformat()) for d, s, t in rows], columns=["doc_id", "stage", "ts"]).to_json(folder / f"{k}.json", orient="records", lines=True)
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))

    put(1, first)
    run_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    put(2, second)
    got = run_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    stuck = [r for r in got if r[3] == "stuck"]
    assert stuck == [("b", "CHUNKING", at(3), "stuck"), ("d", None, at(2), "stuck")]
    put(3, third)
    got = run_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r for r in got if r[3] == "stuck"] == stuck  # once
    want = machine(first + second + third, stages.ORDER, stages.FINAL)
    assert [r for r in got if r[3] != "stuck"] == want
    # the same log from the beginning, in one run
    again = run_stream(spark, str(folder), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert [r for r in again if r[3] != "stuck"] == want


def test_stage_windows_of_stream_and_table(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "READY", t0 + dt.timedelta(minutes=m)) for m in (0, 1, 6, 60)]
    spark.createDataFrame(rows, "doc_id string, stage string, ts timestamp").write.parquet(f"{tmp_path}/log")
    want = sorted(tuple(r) for r in stages.windows(spark.read.parquet(f"{tmp_path}/log")).collect())
    s = spark.readStream.schema("doc_id string, stage string, ts timestamp").parquet(f"{tmp_path}/log")
    stages.windows(s).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [r[2] for r in want] == [2, 1, 1] and got == want[:2]  # the last window is still open
