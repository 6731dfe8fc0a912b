"""Checks that try to refute an answer, as joins over answers, citations, pages and disputed points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import values as V

SEVERITY = {"ok": 0, "minor": 1, "major": 2, "critical": 3}


def value_keys(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``qid``, ``key``: the typed values (no bare numbers) of each text, by kind, rounded value and unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(q, f"{v.kind}|{v.dt or round(v.num, 2)}|{v.unit}", v.raw) for q, t in zip(f.qid, f.t) for v in V.values(t or "") if v.kind != "number"]
            yield pd.DataFrame(out, columns=["qid", "key", "raw"])

    return rows.select(F.col(id_col).cast("string").alias("qid"), F.col(text_col).alias("t")).mapInPandas(run, "qid string, key string, raw string")


def uncited_values(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Values of an answer (``qid``, ``text``) that no quote cited for it (``qid``, ``quote``) states."""
    return value_keys(answers, "qid", "text").join(value_keys(citations, "qid", "quote").select("qid", "key").distinct(), ["qid", "key"], "left_anti")


def undisclosed(citations: DataFrame, sources: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Disputed topics that a cited span overlaps and the answer does not name: ``qid``, ``topic``.

    ``citations``: qid, doc_id, page, start, end; ``sources``: topic, source, page, start, end; ``disclosed``: qid, topic.
    """
    s = sources.select("topic", F.col("source").alias("doc_id"), "page", F.col("start").alias("s0"), F.col("end").alias("s1"))
    hit = citations.join(s, ["doc_id", "page"]).where((F.col("start") < F.col("s1")) & (F.col("s0") < F.col("end")))
    return hit.select("qid", "topic").distinct().join(disclosed, ["qid", "topic"], "left_anti")


#: Wording by which a sentence takes something back or sets a condition.
EXCEPTION = r"(?i)\b(?:except(?:ion|ions|ing|ed)?|unless|however|provided that|notwithstanding|subject to|does not apply|do not apply|other than|only if|excluding|excludes|exempt|with the exception|waived?)\b"
SCAN_CONFIDENCE, LEAST_SENTENCE, SHARED_TERMS = 0.88, 25, 2


def exceptions(citations: DataFrame, pool: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentences that an answer does not cite although they speak of exceptions on its subject.

    ``citations``: qid, doc_id, page, start, end. ``pool``: doc_id, page, start, section, text, and qid for passages that
    belong to a question's subject (null: any passage). ``terms``: qid, term. Looked at are the question's own passages and
    those in a section that it cites; a sentence counts when it has exception wording, shares SHARED_TERMS stems with the
    question and no character with a cited span. Returns qid, doc_id, page, start, end, sentence.
    """
    held = pool.select("doc_id", "page", "section", "start", "text")
    at = citations.select("qid", "doc_id", "page", F.col("start").alias("s0"), F.col("end").alias("s1"))
    here = held.withColumn("upto", F.col("start") + F.length("text"))
    cited = at.join(here, ["doc_id", "page"]).where((F.col("s0") < F.col("upto")) & (F.col("start") < F.col("s1"))).select("qid", "doc_id", "section").distinct()
    near = held.join(cited, (held["doc_id"] == cited["doc_id"]) & held["section"].eqNullSafe(cited["section"])).select("qid", held["doc_id"], "page", "start", "text")
    looked = near.unionByName(pool.where("qid is not null").select("qid", "doc_id", "page", "start", "text")).distinct().where(F.col("text").rlike(EXCEPTION))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(q, d, p, s + a, s + b, t[a:b]) for q, d, p, s, t in zip(f.qid, f.doc_id, f.page, f.start, f.text) for a, b in V.sentences(t)]
            yield pd.DataFrame(out, columns=["qid", "doc_id", "page", "start", "end", "sentence"])

    said = looked.mapInPandas(run, "qid string, doc_id string, page int, start int, end int, sentence string")
    said = said.where((F.length("sentence") >= LEAST_SENTENCE) & F.col("sentence").rlike(EXCEPTION)).distinct()
    shared = T.content_terms(said, "sentence").join(terms.select(F.col("qid").cast("string").alias("qid"), "term").distinct(), ["qid", "term"])
    shared = shared.groupBy("qid", "doc_id", "page", "start", "end", "sentence").agg(F.count_distinct("term").alias("n")).where(F.col("n") >= SHARED_TERMS).drop("n")
    span = at.select(F.col("qid").cast("string").alias("qid"), "doc_id", "page", "s0", "s1")
    return shared.join(span, (shared["qid"] == span["qid"]) & (shared["doc_id"] == span["doc_id"]) & (shared["page"] == span["page"]) & (shared["start"] < span["s1"]) & (span["s0"] < shared["end"]), "left_anti")


def poor_scans(citations: DataFrame) -> DataFrame:
    """``qid``, ``lowest``: questions with a quote from a scan read with less confidence than SCAN_CONFIDENCE."""
    return citations.where(F.col("ocr_conf") < SCAN_CONFIDENCE).groupBy("qid").agg(F.min("ocr_conf").alias("lowest"))


def verdicts(answers: DataFrame, citations: DataFrame, quotes_ok: DataFrame, sources: DataFrame, disclosed: DataFrame) -> DataFrame:
    """``qid`` and verdict: refuted (a forged quote, an uncited value, a hidden dispute), weakened (one source), survived.

    ``quotes_ok``: qid, verbatim for each citation.
    """
    level = lambda df, name: df.select("qid", F.lit(SEVERITY[name]).alias("s"))
    q = F.col("qid").cast("string").alias("qid")
    found = level(quotes_ok.where(~F.col("verbatim")), "critical").select(q, "s")
    found = found.unionByName(level(uncited_values(answers, citations), "critical").select(q, "s")).unionByName(level(undisclosed(citations, sources, disclosed), "critical").select(q, "s"))
    single = citations.groupBy("qid").agg(F.count_distinct("doc_id").alias("n")).where("n < 2")
    found = found.unionByName(level(single, "minor").select(q, "s"))
    worst = found.groupBy("qid").agg(F.max("s").alias("s"))
    out = answers.select(q).join(worst, "qid", "left")
    return out.select("qid", F.when(F.col("s") >= SEVERITY["critical"], "refuted").when(F.col("s") >= 1, "weakened").otherwise("survived").alias("verdict"))
