"""Answers drafted by a language model, of which nothing reaches the reader that the documents do not say.

A model gets passages (``offered``) and disputed points (``candidates``) and returns a draft as JSON. Every quote of a
draft is looked up in the passage that it names: one join, then native string functions; what stands there is widened to
its sentence and cited, what does not is dropped and counted. A conflict needs two verified positions. A firm disputed
point is reported whatever the draft says about it. All questions of a table are finished together; no step sees a
single question alone, and a draft that is missing or broken leaves its question to the extractive answer.

The model is a callable from a list of prompts to a list of texts and runs in batches inside tasks (:func:`drafts`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spanledger.functions import text as T
from spanledger.functions import values as V
from spanledger.operators import answers, graph, passages

_SOURCE = "struct<passage:string,quote:string>"
DRAFT_SCHEMA = (
    "status string, headline string, answer string, confidence string, caveats array<string>,"
    f" claims array<struct<text:string,sources:array<{_SOURCE}>>>,"
    " extracted_claims array<struct<subject:string,predicate:string,value:string,date:string,passage:string,quote:string>>,"
    " conflicts array<struct<candidate_id:string,summary:string,resolution:string,positions:array<struct<passage:string,claim:string,quote:string>>>>,"
    " dismissed_candidates array<struct<candidate_id:string,reason:string>>"
)
# What a model's own words for its confidence count, and what a quote that is not there costs.
OWN_CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.35}
OTHER_CONFIDENCE, BAD_QUOTE, MOST_BAD = 0.5, 0.12, 0.3
UNRESOLVED_CAP, CONFLICT_CAP, WITHHELD_CAP = 0.6, 0.5, 0.2

DISCARDED = "A conflict in the draft had no two positions that the documents state; it was left out."
NO_PAIR = "The draft spoke of a conflict without two sources that can be verified."
KEPT = "The draft took one disagreement for settled, but the documents state values that exclude each other; it is reported."
WITHHELD = "No quote of the draft stands in the documents; the answer was withheld."
TOO_WEAK = "The evidence is too weak for an answer."
NOT_FOUND = "**The documents hold no reliable answer.**"
DISAGREE = "**The documents disagree; no single answer is supported.**"


def drafts(prompts: DataFrame, model: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """``qid``, ``draft`` and ``failure`` of every prompt (``qid``, ``prompt``).

    The prompts of a batch that fails are tried one by one; the reason of one that fails alone is its ``failure``.
    """

    def tried(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            told, why = list(model(part.prompt.tolist())), None
            if len(told) != len(part):
                raise ValueError(f"{len(told)} drafts for {len(part)} prompts")
        except Exception as e:  # whatever a plug-in raises becomes the reason
            if len(part) > 1:
                for k in range(len(part)):
                    yield from tried(part.iloc[k : k + 1])
                return
            told, why = [None], f"{type(e).__name__}: {e}"[:200]
        yield pd.DataFrame({"qid": part.qid, "draft": told, "failure": why})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                yield from tried(f.iloc[at : at + batch])

    return prompts.select(F.col("qid").cast("string").alias("qid"), "prompt").mapInPandas(run, "qid string, draft string, failure string")


def prompts(questions: DataFrame, offered: DataFrame, candidates: DataFrame, most: int = 2_400) -> DataFrame:
    """``qid``, ``prompt``: passages without sentences that address an AI, disputed points with their positions, the question.

    ``questions``: qid, question; ``offered``: qid, pid, doc_name, page, day, text; ``candidates``: qid, cid, positions.
    """

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return pd.Series([passages.redact(t)[:most] for t in texts])

    number = F.regexp_extract("pid", r"(\d+)", 1).cast("int")
    head = F.concat(F.lit("["), "pid", F.lit("] "), F.concat_ws(", ", "doc_name", F.concat(F.lit("page "), F.col("page").cast("string")), "day"))
    p = offered.select("qid", F.struct(number.alias("n"), F.concat(head, F.lit("\n"), shown("text")).alias("t")).alias("x"))
    p = p.groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("x")).select("qid", F.concat_ws("\n\n", F.col("x.t")).alias("passages"))
    said = F.concat_ws(" | ", F.transform("positions", lambda v: F.concat(v["value"], F.lit(" ("), F.concat_ws("; ", v["sources"]["doc_name"]), F.lit(")"))))
    c = candidates.select("qid", F.struct(F.col("cid").alias("n"), F.concat("cid", F.lit(": "), said).alias("t")).alias("x"))
    c = c.groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("x")).select("qid", F.concat_ws("\n", F.col("x.t")).alias("points"))
    j = questions.select("qid", "question").join(p, "qid", "left").join(c, "qid", "left")
    return j.select("qid", F.concat_ws("\n\n", F.concat(F.lit("Passages\n"), "passages"), F.concat(F.lit("Disputed points\n"), "points"), F.concat(F.lit("Question\n"), "question")).alias("prompt"))


def pattern_of(quote: Column) -> Column:
    """A pattern that finds the words of a quote in any case with any blanks between them."""
    bare = F.regexp_replace(quote, "^[\\s.…\"']+|[\\s.…\"']+$", "")
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit("(?iu)"), F.array_join(words, r"\s+"))


def locate(rows: DataFrame, text_col: str = "text", quote_col: str = "quote") -> DataFrame:
    """Adds ``at`` and ``upto``: where in its text a quote stands (verbatim, else in any case and spacing), else null.

    Lengths are in characters. A quote that is there only in another typography (curly quotes, dashes) is the whole text.
    """
    t, q = F.col(text_col), F.col(quote_col)
    bare = F.regexp_replace(q, "^[\\s.…\"']+|[\\s.…\"']+$", "")
    verbatim = F.when(bare != "", F.nullif(F.instr(t, bare), F.lit(0)))
    r = rows.withColumn("__v", verbatim).withColumn("__r", F.when(F.col("__v").isNull() & (bare != ""), F.regexp_substr(t, pattern_of(q))))
    at = F.coalesce(F.col("__v"), F.nullif(F.instr(t, F.col("__r")), F.lit(0))) - 1
    size = F.when(F.col("__v").isNotNull(), F.length(bare)).otherwise(F.length("__r"))
    whole = at.isNull() & T.contains_quote(t, q)
    return r.withColumn("at", F.when(whole, 0).otherwise(at)).withColumn("upto", F.when(whole, F.length(t)).otherwise(F.col("at") + size)).drop("__v", "__r")


SPANS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


@F.pandas_udf(SPANS)
def sentence_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"a": a, "b": b} for a, b in V.sentences(t or "")] for t in texts])


def verified(quotes: DataFrame, offered: DataFrame) -> DataFrame:
    """Adds to ``qid``, ``pid``, ``quote`` whether the passage has the quote (``ok``), and its sentence: chunk, doc_id,
    doc_name, page, day, ocr_conf, ``start`` and ``end`` in the page, ``cited``.
    """
    o = offered.select("qid", "pid", "chunk", "doc_id", "doc_name", "page", "day", "ocr_conf", F.col("start").alias("__from"), "text", sentence_spans("text").alias("__spans"))
    j = locate(quotes.join(o, ["qid", "pid"], "left"))
    ok = F.coalesce(T.contains_quote(F.col("text"), F.col("quote")), F.lit(False))
    around = F.filter("__spans", lambda s: (s["a"] <= F.col("at")) & (F.col("at") < s["b"]))
    a = F.coalesce(F.get(around, F.lit(0))["a"], F.col("at"))
    b = F.greatest(F.col("upto"), F.coalesce(F.get(around, F.lit(0))["b"], F.col("upto")))
    j = j.withColumn("ok", ok).withColumn("__a", F.when(ok, a)).withColumn("__b", F.when(ok, b))
    j = j.withColumn("start", F.col("__from") + F.col("__a")).withColumn("end", F.col("__from") + F.col("__b")).withColumn("cited", F.substring("text", F.col("__a") + 1, F.col("__b") - F.col("__a")))
    return j.drop("__from", "__spans", "__a", "__b", "at", "upto", "text")


def quotes_of(parsed: DataFrame) -> DataFrame:
    """Every quote of the drafts with its use: ``part`` (0 claims, 1 extracted, 2 conflicts), ``i``, ``j``, ``role``, ``said``."""
    claims = parsed.select("qid", F.posexplode("d.claims").alias("i", "c")).select("qid", "i", F.posexplode("c.sources").alias("j", "s"))
    claims = claims.select("qid", F.lit(0).alias("part"), "i", "j", F.lit("support").alias("role"), "s.passage", "s.quote", F.lit(None).cast("string").alias("said"))
    facts = parsed.select("qid", F.posexplode("d.extracted_claims").alias("i", "c")).select("qid", F.lit(1).alias("part"), "i", F.lit(0).alias("j"), F.lit("support").alias("role"), "c.passage", "c.quote", F.col("c.value").alias("said"))
    sides = parsed.select("qid", F.posexplode("d.conflicts").alias("i", "c")).select("qid", "i", F.posexplode("c.positions").alias("j", "s"))
    sides = sides.select("qid", F.lit(2).alias("part"), "i", "j", F.lit("conflict").alias("role"), "s.passage", "s.quote", F.col("s.claim").alias("said"))
    out = claims.unionByName(facts).unionByName(sides).withColumnRenamed("passage", "pid")
    return out.withColumn("pid", F.coalesce("pid", F.lit(""))).withColumn("quote", F.coalesce("quote", F.lit("")))


SOURCE_SCHEMA = "array<struct<chunk:string,doc_id:string,doc_name:string,page:int,start:int,end:int,sentence:string,day:string,ocr_conf:double>>"


def _positions(v: DataFrame) -> DataFrame:
    """Reported conflicts with two different verified sentences: qid, i, positions (one for each value, first use first)."""
    distinct = v.groupBy("qid", "i", "chunk", "start", "end").agg(F.min_by(F.struct("said", "doc_id", "doc_name", "page", "cited", "day", "ocr_conf"), "j").alias("x"), F.min("j").alias("j"))
    many = distinct.groupBy("qid", "i").agg(F.count("*").alias("n")).where("n >= 2").select("qid", "i")
    d = distinct.join(many, ["qid", "i"])
    value = T.clip(F.coalesce("x.said", F.lit("")), 90)
    source = F.struct("chunk", "x.doc_id", "x.doc_name", "x.page", "start", "end", F.col("x.cited").alias("sentence"), "x.day", "x.ocr_conf")
    by_value = d.groupBy("qid", "i", F.lower(F.trim(value)).alias("key")).agg(F.min("j").alias("j"), F.min_by(value, "j").alias("value"), F.sort_array(F.collect_list(F.struct("j", source.alias("s")))).alias("ss"))
    return by_value.groupBy("qid", "i").agg(F.sort_array(F.collect_list(F.struct("j", "value", F.col("ss.s").alias("sources")))).alias("p")).select("qid", "i", F.transform("p", lambda p: F.struct(p["value"].alias("value"), p["sources"].alias("sources"))).alias("positions"))


def dispute_lines(conflicts: Column) -> Column:
    """The positions of all conflicts, one line for each with its sources."""
    source = lambda s: F.concat(s["doc_name"], F.when(s["day"].isNotNull(), F.concat(F.lit(" ("), s["day"], F.lit(")"))).otherwise(F.lit("")))
    line = lambda c: lambda p: F.concat(F.lit("- **"), F.when(c["kind"] == "assertion", T.clip(F.get(p["sources"], F.lit(0))["sentence"], 120)).otherwise(p["value"]), F.lit("**: "), F.array_join(F.transform(p["sources"], source), "; "))
    return F.array_join(F.transform(conflicts, lambda c: F.array_join(F.transform(c["positions"], line(c)), "\n")), "\n\n")


def dispute_headline(conflicts: Column) -> Column:
    first = F.get(conflicts, F.lit(0))
    told = F.array_join(F.transform(F.slice(first["positions"], 1, 3), lambda p: p["value"]), " vs ")
    return F.when((first["kind"] != "assertion") & (F.length(told) <= 60), told).otherwise(F.lit("Sources disagree"))


def with_labels(answer: Column, labels: Column) -> Column:
    """Marks of passages become marks of citations (``labels``: array of pid, label); those without one go."""
    one, two = "\x01", "\x02"
    t = F.regexp_replace(answer, r"(?<=[\[,;]\s{0,3})P(\d+)(?=\s{0,3}[,;\]])", f"{one}P$1{two}")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, rf"\[\s*{one}", one), rf"{two}\s*[,;]\s*{one}", two + one), rf"{two}\s*\]", two)
    put = lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))
    t = F.aggregate(labels, t, lambda s, x: F.replace(s, F.concat(F.lit(one), x["pid"], F.lit(two)), put(x)))
    t = F.regexp_replace(t, rf"{one}P\d+{two}", "")
    t = F.aggregate(labels, t, lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"\b"), x["pid"], F.lit(r"\b")), put(x)))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(\[S\d+\])\1+", "$1"), r" +(?=[.,;])", ""))


def finalize(told: DataFrame, offered: DataFrame, candidates: DataFrame, base: DataFrame) -> DataFrame:
    """One row for every question of ``base`` that has a readable draft.

    ``told``: qid, draft (JSON). ``offered``: qid, pid (P1..), chunk, doc_id, doc_name, page, start, text, day, ocr_conf.
    ``candidates``: qid, cid (C1..), topic, kind, firm, explanation, positions (value, sources of SOURCE_SCHEMA).
    ``base``: qid, best, union_cov, relevance, missing_share, dispute_score, dispute_coverage, time_scoped.
    Returns qid, status, level, headline, answer, confidence, caveats, conflicts, citations, matrix, n_quotes, n_bad.
    """
    parsed = told.select("qid", F.from_json("draft", DRAFT_SCHEMA).alias("d"))
    readable = F.col("d").isNotNull() & (F.col("d.status").isNotNull() | F.col("d.answer").isNotNull() | F.col("d.claims").isNotNull())
    parsed = graph.cut(parsed.where(readable))  # each table that is cut is read several times below
    uses = quotes_of(parsed)
    distinct = uses.select("qid", "pid", "quote", "role").distinct()
    checked = graph.cut(verified(distinct, offered))
    counts = checked.groupBy("qid").agg(F.count("*").alias("n_quotes"), F.sum((~F.col("ok")).cast("long")).alias("n_bad"))
    v = graph.cut(uses.join(checked.where("ok"), ["qid", "pid", "quote", "role"]))
    # conflicts that the draft reports with two verified positions
    head = parsed.select("qid", F.posexplode("d.conflicts").alias("i", "c")).select("qid", "i", F.trim("c.candidate_id").alias("cid"), F.coalesce("c.summary", F.lit("")).alias("summary"), F.coalesce("c.resolution", F.lit("")).alias("note"))
    known = candidates.select("qid", "cid", "topic", "kind", "firm", "explanation", F.col("positions").cast(f"array<struct<value:string,sources:{SOURCE_SCHEMA}>>").alias("held"))
    reported = head.join(_positions(v.where("part = 2")), ["qid", "i"]).join(known.drop("held"), ["qid", "cid"], "left")
    kind = F.coalesce("kind", F.lit("assertion"))
    reported = graph.cut(reported)
    discarded = head.join(reported.select("qid", "i"), ["qid", "i"], "left_anti").groupBy("qid").agg(F.count("*").alias("n_discarded"))
    reported = reported.select("qid", F.struct(F.lit(0).alias("o"), "i").alias("ord"), "cid", "topic", kind.alias("kind"), "positions", F.col("summary").alias("explanation"), "note", F.lit(False).alias("forced"))
    # candidates that the draft dismisses or does not mention
    gone = parsed.select("qid", F.posexplode("d.dismissed_candidates").alias("i", "c")).select("qid", "i", F.col("c.candidate_id").alias("cid"), F.coalesce(F.trim("c.reason"), F.lit("")).alias("reason"))
    gone = gone.groupBy("qid", "cid").agg(F.min("i").alias("i"), F.min_by("reason", "i").alias("reason"))
    fate = known.join(parsed.select("qid"), "qid").join(reported.select("qid", "cid", F.lit(True).alias("told")), ["qid", "cid"], "left").join(gone, ["qid", "cid"], "left")
    fate = graph.cut(fate.where("told is null"))
    surfaced = fate.where("firm").select("qid", F.struct(F.lit(1).alias("o"), F.coalesce("i", F.regexp_extract("cid", r"(\d+)", 1).cast("int") + 1000).alias("i")).alias("ord"), "cid", "topic", "kind", F.col("held").alias("positions"), "explanation", F.coalesce("reason", F.lit("")).alias("note"), F.lit(True).alias("forced"))
    insisted = fate.where("firm and i is not null").groupBy("qid").agg(F.count("*").alias("n_insisted"))
    honoured = fate.where("not firm and i is not null").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "reason"))).alias("x")).select("qid", F.concat_ws("; ", F.slice(F.col("x.reason"), 1, 3)).alias("honoured"))
    left = fate.where("not firm and i is null").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("cid", "explanation"))).alias("x")).select("qid", F.slice(F.col("x.explanation"), 1, 2).alias("unaddressed"))
    disputes = reported.unionByName(surfaced)
    # citations: of verified uses in their order, then of the surfaced disputes; a reported conflict's sources are its own
    used = v.join(head.join(reported.select("qid", F.col("ord.i").alias("i"), F.lit(True).alias("stands")), ["qid", "i"]).select("qid", "i", F.lit(2).alias("part"), "stands"), ["qid", "part", "i"], "left")
    used = used.withColumn("role", F.when(F.col("part") < 2, "support").when(F.col("stands"), "conflict").otherwise("support"))
    columns = ["qid", "chunk", "doc_id", "doc_name", "page", "start", "end", F.col("cited").alias("quote"), "ocr_conf", "role"]
    cites = used.select(*columns, F.struct("part", "i", "j").alias("ord"))
    more = surfaced.select("qid", "ord", F.posexplode("positions").alias("a", "p")).select("qid", "ord", "a", F.posexplode("p.sources").alias("b", "s"))
    more = more.select("qid", "s.chunk", "s.doc_id", "s.doc_name", "s.page", "s.start", "s.end", F.col("s.sentence").alias("quote"), "s.ocr_conf", F.lit("conflict").alias("role"), F.struct((F.lit(3) + F.col("ord.i") * 100 + F.col("a")).cast("int").alias("part"), F.col("ord.i").alias("i"), F.col("b").alias("j")).alias("ord"))
    cites = graph.cut(cites.unionByName(more))
    labels = graph.cut(answers.number_citations(cites.select("qid", "chunk", "start", "end", "role", "ord")))
    details = cites.groupBy("qid", "chunk", "start", "end").agg(F.min(F.struct("doc_id", "doc_name", "page", "quote", "ocr_conf")).alias("x"))
    cited = labels.join(details, ["qid", "chunk", "start", "end"]).select("qid", "label", "role", "chunk", "start", "end", "x.*")
    number = F.regexp_extract("label", r"(\d+)", 1).cast("int")
    book = cited.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), F.struct("label", "role", "chunk", "doc_id", "doc_name", "page", "start", "end", "quote").alias("c")))), lambda x: x["c"]).alias("citations"),
        F.count_distinct("doc_id").alias("docs"), F.min("ocr_conf").alias("ocr"))
    of_pid = v.join(labels.select("qid", "chunk", "start", "end", "label"), ["qid", "chunk", "start", "end"])
    of_pid = of_pid.groupBy("qid", "pid").agg(F.min_by("label", F.struct("part", "i", "j")).alias("label")).groupBy("qid").agg(F.collect_list(F.struct("pid", "label")).alias("labels"))
    facts = parsed.select("qid", F.posexplode("d.extracted_claims").alias("i", "c")).select("qid", "i", "c.subject", "c.predicate", "c.value", "c.date")
    rows = v.where("part = 1").join(labels.select("qid", "chunk", "start", "end", "label"), ["qid", "chunk", "start", "end"]).join(facts, ["qid", "i"])
    matrix = rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.struct("subject", "predicate", "value", "date", "doc_id", "doc_name", "page", "label", F.col("cited").alias("quote")).alias("r")))), lambda x: x["r"]).alias("matrix"))
    points = disputes.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct("cid", "topic", "kind", "positions", "explanation", "note", "forced").alias("c")))), lambda x: x["c"]).alias("conflicts"), F.max("forced").alias("forced"))
    out = base.select("qid", "best", "union_cov", "relevance", "missing_share", "dispute_score", "dispute_coverage", "time_scoped").join(parsed, "qid")
    for part in (counts, discarded, insisted, honoured, left, book, of_pid, matrix, points):
        out = out.join(part, "qid", "left")
    return _worded(out)


def _worded(x: DataFrame) -> DataFrame:
    """Status, text and confidence of joined drafts."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = x.withColumn("n_quotes", zero("n_quotes").cast("long")).withColumn("n_bad", zero("n_bad").cast("long"))
    labels = F.coalesce("labels", F.array().cast("array<struct<pid:string,label:string>>"))
    disputed = F.col("conflicts").isNotNull()
    own = F.coalesce("d.status", F.lit("answered"))
    status = F.when(disputed, "conflict").when(own == "conflict", "partial").otherwise(own)
    x = x.withColumn("status", status).withColumn("answer", with_labels(F.coalesce("d.answer", F.lit("")), labels)).withColumn("headline", F.coalesce("d.headline", F.lit("")))
    forced = F.coalesce("forced", F.lit(False))
    listed = F.array_join(F.transform(F.filter("citations", lambda c: c["role"] == "support"), lambda c: F.concat(F.lit("- "), c["quote"], F.lit(" ["), c["label"], F.lit("]"))), "\n")
    lines = F.concat(F.lit(DISAGREE + "\n\n"), dispute_lines(F.col("conflicts")))
    x = x.withColumn("answer", F.when(disputed & (forced | (F.col("answer") == "")), lines).when(F.col("status").isin("answered", "partial") & (F.col("answer") == ""), F.coalesce(listed, F.lit(""))).otherwise(F.col("answer")))
    x = x.withColumn("headline", F.when(disputed & (forced | (F.trim("headline") == "")), dispute_headline(F.col("conflicts"))).otherwise(F.col("headline")))
    docs = zero("docs")
    sure = answers.answer_confidence(F.col("best"), F.col("union_cov"), F.col("relevance"), docs, zero("missing_share"), ocr=F.col("ocr"))
    against = answers.conflict_confidence(zero("dispute_score"), zero("dispute_coverage"), F.coalesce("time_scoped", F.lit(False)), ocr=F.col("ocr"))
    rule = F.coalesce(F.when((F.col("status") == "conflict") & F.col("dispute_score").isNotNull(), against).otherwise(sure), F.lit(0.0))
    said = F.coalesce("d.confidence", F.lit("medium"))
    model = F.lit(OTHER_CONFIDENCE)
    for word, worth in OWN_CONFIDENCE.items():
        model = F.when(said == word, worth).otherwise(model)
    score = F.when(rule > 0, 0.5 * rule + 0.5 * model).otherwise(0.5 * model) - F.least(F.lit(MOST_BAD), BAD_QUOTE * F.col("n_bad"))
    open_points = F.col("unaddressed").isNotNull() & (F.col("status") != "conflict")
    score = F.when(open_points, F.least(score, F.lit(UNRESOLVED_CAP))).otherwise(score)
    score = F.when(F.col("status") == "conflict", F.least(score, F.lit(CONFLICT_CAP))).otherwise(score)
    bare = F.col("citations").isNull() & F.col("status").isin("answered", "partial")
    score = F.greatest(F.lit(0.0), F.least(F.lit(answers.CAP), F.when(bare, F.least(score, F.lit(WITHHELD_CAP))).otherwise(score)))
    x = x.withColumn("confidence", F.round(score, 3)).withColumn("__bare", bare)
    x = x.withColumn("__weak", ~F.col("__bare") & (F.col("status") != "insufficient") & (F.col("confidence") < answers.ABSTAIN))
    note = lambda when, text: F.when(when, text)
    caveats = F.concat(
        F.filter(F.coalesce("d.caveats", F.array().cast("array<string>")), lambda c: F.trim(c) != ""),
        F.filter(F.array(
            note(zero("n_discarded") > 0, F.lit(DISCARDED)),
            note(zero("n_insisted") > 0, F.lit(KEPT)),
            note(F.col("honoured").isNotNull(), F.concat(F.lit("Possible conflicts that the draft judged not to be real: "), "honoured")),
            note((own == "conflict") & ~disputed, F.lit(NO_PAIR)),
            note(open_points, F.concat(F.lit("A possible conflict is not addressed: "), F.concat_ws("; ", "unaddressed"))),
            note(F.col("n_bad") > 0, F.concat(F.col("n_bad").cast("string"), F.lit(" of "), F.col("n_quotes").cast("string"), F.lit(" quotes do not stand in the documents and were dropped."))),
            note(F.col("__bare"), F.lit(WITHHELD)), note(F.col("__weak"), F.lit(TOO_WEAK)),
        ), lambda c: c.isNotNull()))
    x = x.withColumn("caveats", caveats)
    withheld = F.col("__bare") | F.col("__weak")
    silent = withheld | (F.col("status") == "insufficient")
    x = x.withColumn("answer", F.when(withheld, F.lit(NOT_FOUND)).when(silent, F.concat_ws("\n\n", F.lit(NOT_FOUND), F.nullif(F.col("answer"), F.lit("")))).otherwise(F.col("answer")))
    x = x.withColumn("headline", F.when(silent, "").otherwise(F.col("headline"))).withColumn("status", F.when(silent, "insufficient").otherwise(F.col("status")))
    x = x.withColumn("matrix", F.when(~silent, F.col("matrix")))
    return x.select("qid", "status", answers.level(F.col("status"), F.col("confidence")).alias("level"), "headline", "answer", "confidence", "caveats", "conflicts", "citations", "matrix", "n_quotes", "n_bad")
