"""The workspace: documents of one tenant and what can be asked of them, each answer a DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators import analysis as A
from spanledger.operators import answers, composer, conflicts, graph, positions, spans
from spanledger.operators import retrieval as R
from spanledger.streaming import ingest
from spanledger.streaming.store import Store


class Workspace:
    def __init__(self, spark: SparkSession, root: str, workspace_id: str = "public"):
        self.spark, self.root, self.id = spark, root, workspace_id

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    def ingest(self, inbox: str, plugins: dict | None = None) -> None:
        """Take in all new files of a folder and wait."""
        ingest.ingest_stream(self.spark, inbox, self.root, self.id, plugins).awaitTermination()

    def delete(self, ids: DataFrame) -> None:
        """Remove documents (``doc_id``) with all that is derived from them."""
        ingest.delete_documents(self.store, self.id, ids)

    def reindex(self, ids: DataFrame) -> None:
        ingest.reindex(self.store, self.id, ids)

    def set_days(self, days: DataFrame) -> None:
        ingest.set_days(self.store, self.id, days)

    def purge(self, keep_after: str) -> None:
        ingest.purge(self.store, self.id, keep_after)

    def gaps(self) -> DataFrame:
        return ingest.gaps(self.store, self.id)

    def reconcile(self) -> int:
        return ingest.reconcile(self.store, self.id)

    def embed(self, embedder) -> int:
        """Bring the stored vectors in line with the passages."""
        return ingest.embed(self.store, self.id, embedder)

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name, self.id)

    def documents(self) -> DataFrame:
        return self._table("documents").orderBy("name")

    def page(self, doc_id: str, number: int) -> DataFrame:
        return self._table("documents").where(F.col("doc_id") == doc_id).select("doc_id", F.explode("pages").alias("p")).where(F.col("p.number") == number).select("doc_id", "p.*")

    def claims(self, doc_id: str | None = None) -> DataFrame:
        c = self._table("claims")
        return c if doc_id is None else c.where(F.col("doc_id") == doc_id).orderBy("page", "start")

    def status(self) -> DataFrame:
        return ingest.stage_now(self._table("status"))

    def _scope(self, as_of: str | None) -> DataFrame:
        d = self._table("documents").where("status = 'READY'")
        return d if as_of is None else positions.documents_as_of(d, positions.parse_day(as_of)).where("used").drop("used", "reason")

    def conflicts(self, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(disputed points, their sources)."""
        docs = self._scope(as_of)
        c = self._table("claims").join(docs.select("doc_id"), "doc_id", "left_semi").drop("workspace_id", "batch", "bucket")
        return conflicts.disputed_points(conflicts.scan(c, docs.withColumn("ocr_conf", F.lit(None).cast("double"))))

    def timeline(self, day: str | None = None) -> DataFrame:
        _, sources = self.conflicts()
        return positions.introduces(sources) if day is None else positions.as_of(sources, positions.parse_day(day))

    def _passages(self, as_of: str | None) -> DataFrame:
        return self._table("passages").join(self._scope(as_of).select("doc_id"), "doc_id", "left_semi").withColumn("pid", F.concat_ws(":", "doc_id", "idx"))

    def search(self, questions: DataFrame, as_of: str | None = None, k: int = 8, postings: DataFrame | None = None, embedder=None, reranker=None) -> DataFrame:
        """``questions``: question_id, question. Passages by fused ranks, with relevance and the channels that found them.

        Channels are BM25, character n-grams and, with an ``embedder`` (texts to vectors), the stored vectors. A
        ``reranker`` (pairs of question and text to scores) orders what the fusion found, in batches inside tasks.
        """
        p = self._passages(as_of)
        args = (p, "pid", "text", questions, "question_id", "question")
        postings = R.index(p, "pid", "text") if postings is None else postings
        lexical, gram = R.bm25(*args, synonyms=True, postings=postings), R.char_ngram(*args)
        channels = {"lexical": (lexical, 1.0), "character": (gram, 0.6)}
        if embedder is not None:
            channels["dense"] = (self._dense(questions, as_of, embedder), 1.0)
        depth = 3 * k if reranker is not None else k
        fused = R.top(R.fuse(list(channels.values())).withColumnRenamed("fused", "score"), depth)
        found = None
        for name, (ranked, _) in channels.items():
            c = ranked.select("qid", "id", F.lit(name).alias("channel"))
            found = c if found is None else found.unionByName(c)
        found = found.groupBy("qid", "id").agg(F.array_sort(F.collect_list("channel")).alias("channels"))
        if reranker is not None:
            fused = R.rerank(fused, p.select(F.col("pid").alias("id"), "text"), questions.select(F.col("question_id").alias("qid"), "question"), reranker, k)
        cov = R.coverage(*args, postings=postings)
        both = fused.join(cov, ["qid", "id"], "left").join(gram.select("qid", "id", F.col("score").alias("char")), ["qid", "id"], "left").join(found, ["qid", "id"], "left")
        near = None
        if embedder is not None:
            both = both.join(channels["dense"][0].select("qid", "id", F.col("score").alias("cosine")), ["qid", "id"], "left")
            near = F.coalesce("cosine", F.lit(0.0))
        both = both.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("relevance", R.relevance(F.col("coverage"), F.coalesce("char", F.lit(0.0)), near))
        return both.join(p.select(F.col("pid").alias("id"), "doc_id", "idx", "page", "start", "end", "section", "text"), "id").orderBy("qid", "rank")

    def _dense(self, questions: DataFrame, as_of: str | None, embedder) -> DataFrame:
        @F.pandas_udf("array<double>")
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, v)) for v in embedder(texts.tolist())])

        held = self._table("vectors").join(self._scope(as_of).select("doc_id"), "doc_id", "left_semi").select(F.concat_ws(":", "doc_id", "idx").alias("id"), "vector")
        return R.dense(held, "id", "vector", questions.select("question_id", vector("question").alias("vector")), "question_id", "vector", k=R.DEPTH)

    def _evidence(self, questions: DataFrame, as_of: str | None, embedder=None, reranker=None) -> dict[str, DataFrame]:
        """What an answer is made of: evidence, analysed questions, disputes, missing terms, and the confidence's parts (``base``)."""
        p = self._passages(as_of)
        postings = R.index(p, "pid", "text")
        terms = R.query_terms(questions, "question_id", "question")
        known = graph.cut(R.known_terms(postings, R.count_of(p), terms))
        asked = A.analyse(questions.select(F.col("question_id").alias("qid"), "question"), "question")
        kinds = self._table("claims").select("doc_id", "idx", F.explode("quantities").alias("q")).groupBy("doc_id", "idx").agg(F.collect_set("q.kind").alias("kinds"))
        hits = self.search(questions, as_of, postings=postings, embedder=embedder, reranker=reranker).where(~T.addresses_ai(F.col("text")))
        hits = hits.join(asked.drop("question"), "qid").join(kinds, ["doc_id", "idx"], "left").join(R.anchored(postings, known).withColumn("anchored", F.lit(True)), ["qid", "id"], "left")
        gain = A.bonus(F.col("wants"), F.col("strict"), F.coalesce("kinds", F.array().cast("array<string>")), F.col("periods"), F.col("text"))
        c = hits.select("qid", F.col("doc_id").alias("doc"), F.col("id").alias("sentence_id"), "idx", F.md5(F.lower(T.normalize_ws(F.col("text"))).cast("binary")).alias("norm"), (0.7 * F.col("coverage") + 0.3 / (1 + F.col("rank")) + gain).alias("score"), F.coalesce("anchored", F.lit(False)).alias("anchored"), "coverage", "relevance", "page", "start", "end", "text")
        e = graph.cut(answers.select_evidence(c))
        points, sources = (graph.cut(x) for x in self.conflicts(as_of))
        told = graph.cut(A.relevant_disputes(e, asked, known, sources, points).join(points.select("topic", F.col("score").alias("dispute_score"), "severity", "same_document", "time_scoped", "value_kind"), "topic"))
        gone = A.missing_terms(terms, A.known_with_substitutes(postings, terms))
        union = answers.union_coverage(e.select("qid", F.col("sentence_id").alias("id")), postings, known)
        base = asked.select("qid").join(e.groupBy("qid").agg(F.max("coverage").alias("best"), F.max("relevance").alias("relevance"), F.count_distinct(F.when(F.col("coverage") >= 0.5, F.col("doc"))).alias("docs")), "qid", "left")
        base = base.join(union, "qid", "left").join(gone, "qid", "left")
        # the strongest of the reported disputes counts, as scoped in time if it is
        worst = told.groupBy("qid").agg(F.max_by(F.struct("dispute_score", F.col("coverage").alias("dispute_coverage"), "time_scoped"), F.struct("dispute_score", "topic")).alias("w"))
        base = base.join(worst, "qid", "left").select("qid", "best", "union_cov", "relevance", "docs", "missing", F.coalesce("share", F.lit(0.0)).alias("missing_share"), "w.*")
        return {"passages": p, "evidence": e, "asked": asked, "terms": terms, "sources": sources, "told": told, "base": graph.cut(base)}

    def ask(self, questions: DataFrame, as_of: str | None = None, model=None, embedder=None, reranker=None) -> DataFrame:
        """Status, level, headline, answer, confidence, evidence, disputes and missing terms of every question.

        Passages that address an AI are no evidence. A dispute that the evidence touches is reported, never decided.
        With a ``model`` (prompts to drafts in JSON) a question gets its finished draft where there is a readable one
        (:mod:`spanledger.operators.composer`), and the extractive answer otherwise; ``engine`` says which.
        """
        x = self._evidence(questions, as_of, embedder, reranker)
        e, told, base = x["evidence"], x["told"], x["base"]
        quantities = self._table("claims").select(F.col("doc_id").alias("doc"), "idx", F.explode("quantities").alias("q"))
        heads = answers.headlines(answers.supporting(e), x["asked"], x["terms"].groupBy("qid").agg(F.collect_set("term").alias("terms")), quantities)
        disputes = told.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("topic", "values"))).alias("disputes"))
        evidence = e.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "doc", "page", "start", "end", "text"))).alias("evidence"))
        used = answers.supporting(e).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("used"))
        out = x["asked"].select("qid", "question").join(base, "qid", "left").join(disputes, "qid", "left").join(evidence, "qid", "left").join(used, "qid", "left").join(heads, "qid", "left")
        out = answers.extractive(out)
        out = out.select("qid", "question", "status", answers.level(F.col("status"), F.col("confidence")).alias("level"), "confidence", "headline", "answer", "evidence", "disputes", "missing", F.lit("rules").alias("engine"))
        if model is None:
            return out
        done = self._drafted(questions, x, model)
        j = out.join(done.select("qid", *[F.col(c).alias(f"__{c}") for c in ("status", "level", "confidence", "headline", "answer")]), "qid", "left")
        drafted = F.col("__status").isNotNull()
        for c in ("status", "level", "confidence", "headline", "answer"):
            j = j.withColumn(c, F.when(drafted, F.col(f"__{c}")).otherwise(F.col(c))).drop(f"__{c}") if c != "status" else j.withColumn("engine", F.when(drafted, "model").otherwise("rules")).withColumn(c, F.coalesce(f"__{c}", c))
        return j.drop("__status")

    def _drafted(self, questions: DataFrame, x: dict[str, DataFrame], model) -> DataFrame:
        """Finished drafts; the passages offered are the evidence and the disputes' sources."""
        docs = self._table("documents").select("doc_id", F.col("name").alias("doc_name"), "day")
        p = x["passages"].select(F.col("pid").alias("chunk"), "doc_id", "page", "start", "end", "text")
        spans = x["told"].select("qid", "topic").join(x["sources"].select("topic", F.col("source").alias("doc_id"), "page", F.col("start").alias("s0"), "value", "sentence", "doc_name", "day", F.col("end").alias("s1")), "topic")
        placed = graph.cut(spans.join(p.select("chunk", "doc_id", "page", F.col("start").alias("c0"), F.col("end").alias("c1")), ["doc_id", "page"]).where((F.col("s0") >= F.col("c0")) & (F.col("s0") < F.col("c1"))))
        chunks = placed.select("qid", "chunk", F.lit(0).alias("o")).unionByName(x["evidence"].select("qid", F.col("sentence_id").alias("chunk"), F.col("place").cast("int").alias("o")))
        chunks = chunks.groupBy("qid", "chunk").agg(F.min("o").alias("o"))
        pid = F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("qid").orderBy("o", "chunk")))
        offered = chunks.withColumn("pid", pid).join(p, "chunk").join(docs, "doc_id").withColumn("ocr_conf", F.lit(None).cast("double"))
        offered = graph.cut(offered)
        source = F.struct("chunk", "doc_id", "doc_name", F.col("page").cast("int").alias("page"), F.col("s0").cast("int").alias("start"), F.col("s1").cast("int").alias("end"), "sentence", "day", F.lit(None).cast("double").alias("ocr_conf"))
        sides = placed.groupBy("qid", "topic", "value").agg(F.sort_array(F.collect_set(source)).alias("sources"))
        held = sides.groupBy("qid", "topic").agg(F.sort_array(F.collect_list(F.struct("value", "sources"))).alias("positions")).join(x["told"], ["qid", "topic"])
        cid = F.concat(F.lit("C"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("dispute_score"), "topic")))
        firm = (F.col("severity") == "high") & ~F.col("same_document") & ~F.col("time_scoped")
        candidates = graph.cut(held.select("qid", cid.alias("cid"), "topic", F.when(F.col("value_kind") == "assertion", "assertion").otherwise("value").alias("kind"), firm.alias("firm"), F.concat_ws(" against ", "values").alias("explanation"), "positions"))
        asked = composer.prompts(questions.select(F.col("question_id").alias("qid"), "question"), offered, candidates)
        told = graph.cut(composer.drafts(asked, model))
        return composer.finalize(told, offered, candidates, x["base"])

    def compare(self, left: str, right: str) -> DataFrame:
        """Disputed points between two documents."""
        _, s = self.conflicts()
        return positions.compare(s.withColumn("side", F.col("source")), left, right).where("state != 'unchanged'")

    def casefile(self) -> DataFrame:
        """Findings: disputes, injections, unreadable and undated documents, most severe first."""
        points, _ = self.conflicts()
        docs = self._table("documents")
        kinds = ("type", "severity", "subject")
        disputes = points.select(F.lit("conflict"), "severity", F.col("topic").cast("string"))
        pages = docs.select("doc_id", F.explode("pages").alias("p"))
        inj = pages.where(T.addresses_ai(F.col("p.text"))).select(F.lit("injection"), F.lit("high"), "doc_id").distinct()
        failed = docs.where("status = 'FAILED'").select(F.lit("unreadable"), F.lit("medium"), "doc_id")
        undated = docs.where("status = 'READY' and day is null").select(F.lit("undated"), F.lit("low"), "doc_id")
        out = disputes.toDF(*kinds).union(inj.toDF(*kinds)).union(failed.toDF(*kinds)).union(undated.toDF(*kinds))
        rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
        return out.orderBy(rank, "type", "subject")

    def verify_quotes(self, citations: DataFrame) -> DataFrame:
        """``citations``: doc_id, page, start, end, quote. Adds ``verbatim``: the stored page has it at that place."""
        pages = self._table("documents").select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.number").alias("page"), F.col("p.text").alias("page_text"))
        j = citations.join(pages, ["doc_id", "page"], "left")
        cut = F.substring("page_text", F.col("start") + 1, F.col("end") - F.col("start"))
        return j.withColumn("verbatim", F.coalesce(cut == F.col("quote"), F.lit(False))).drop("page_text")

    def locate(self, quotes: DataFrame, as_of: str | None = None) -> DataFrame:
        """``quotes``: qid, quote. ``qid``, ``doc_id``, ``page``, ``start`` and ``end`` of every page that a quote stands on."""
        pages = self._scope(as_of).select("doc_id", F.explode("pages").alias("p")).select(F.struct("doc_id", F.col("p.number").alias("page")).alias("id"), F.col("p.text").alias("text"))
        return spans.locate(pages, quotes).select("qid", "id.doc_id", "id.page", "start", "end")

    def report(self) -> str:
        """The case file as Markdown."""
        rows = self.casefile().collect()
        return "\n".join(["# Case file", *(f"- **{r['severity']}** {r['type']}: {r['subject']}" for r in rows)])
