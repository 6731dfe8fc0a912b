"""What a question asks for, and which disputes an answer to it has to report; many questions are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators import retrieval as R

# How questions ask (a word that must be there, kinds of values wanted, whether only those will do).
TIME_WORDS = ["day", "days", "week", "weeks", "month", "months", "year", "years", "hour", "hours", "minute", "minutes"]
ASKS = [
    (["how many"], "quantity", ["number"], True),
    (["how long", "how often"], "quantity", ["duration"], True),
    (["how much", "how big", "how large", "how old"], "quantity", ["money", "number", "percent"], True),
    (["when", "what date", "which date", "by when", "date of"], "date", ["date"], True),
    (["budget", "cost", "price", "fee", "salary", "revenue", "amount", "spend", "liability", "cap", "worth", "payment amount"], "quantity", ["money"], False),
    (["percent", "percentage", "rate", "margin", "turnover"], "quantity", ["percent", "money"], False),
    (["period", "notice", "duration", "deadline", "term", "terms"], "generic", ["duration"], False),
    (["headcount", "employees", "number of"], "generic", ["number"], False),
]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _has(text: Column, phrases: list[str]) -> Column:
    return text.rlike(r"\b(?:" + "|".join(phrases) + r")\b")


def analyse(questions: DataFrame, text_col: str) -> DataFrame:
    """Adds ``qtype``, ``wants`` (kinds of values), ``strict`` and ``periods`` (years and months); null asks for nothing."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = F.lit(None)
    for phrases, qtype, wants, strict in reversed(ASKS):
        kinds = F.array(*[F.lit(w) for w in wants])
        if phrases == ["how many"]:
            kinds = F.when(_has(t, TIME_WORDS), F.array(F.lit("number"), F.lit("duration"))).otherwise(kinds)
        found = F.when(_has(t, phrases), F.struct(F.lit(qtype).alias("qtype"), kinds.alias("wants"), F.lit(strict).alias("strict"))).otherwise(found)
    who, yes = t.rlike(r"^\s*who\b"), t.rlike(r"^\s*(?:is|are|does|do|did|can|could|will|was|were|has|have|should|must|may)\b")
    a = questions.withColumn("__a", found)
    soft = F.when(who, "who").when(yes, "yesno").otherwise(F.coalesce("__a.qtype", F.lit("generic")))
    qtype = F.when(F.col("__a.strict"), F.col("__a.qtype")).otherwise(soft)
    periods = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b((?:19|20)[0-9]{2}|" + "|".join(MONTH_NAMES) + r")\b"), F.lit(1)))
    return a.select(*questions.columns, qtype.alias("qtype"), F.coalesce("__a.wants", F.array().cast("array<string>")).alias("wants"), F.coalesce("__a.strict", F.lit(False)).alias("strict"), periods.alias("periods"))


def bonus(wants: Column, strict: Column, kinds: Column, periods: Column, text: Column) -> Column:
    """What a passage's score gains by values of a wanted kind and by the question's periods, or loses without them."""
    low = F.lower(text)
    kind = F.when(F.size(wants) == 0, 0.0).when(F.arrays_overlap(wants, kinds), 0.12).when(strict, -0.1).otherwise(-0.04)
    period = F.when(F.size(periods) == 0, 0.0).when(F.exists(periods, lambda p: F.contains(low, p)), 0.1).otherwise(-0.05)
    return kind + period


def missing_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """``qid``, ``missing`` (terms that no passage has, nor a substitute for them) and ``share`` of the question's terms.

    ``terms``: qid, term of all questions; ``known``: the terms (with substitutes, see :func:`known_with_substitutes`).
    """
    gone = terms.join(known.select("term").distinct(), "term", "left_anti").where((F.length("term") > 2) & ~F.col("term").isin(R.GENERIC))
    n = terms.groupBy("qid").agg(F.count("*").alias("n"))
    g = gone.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("missing"))
    return n.join(g, "qid", "left").select("qid", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), (F.coalesce(F.size("missing"), F.lit(0)).cast("double") / F.col("n")).alias("share"))


def known_with_substitutes(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``term`` of the questions' terms that the corpus has, as such, by a synonym, or by all words of what it is short for."""
    there = postings.select(F.col("term").alias("other")).distinct()
    asked = terms.select("term").distinct()
    ways = asked.join(F.broadcast(R.substitutes(postings.sparkSession)), "term").select("term", "way", F.size("others").alias("all"), F.explode("others").alias("other"))
    whole = ways.join(there, "other").groupBy("term", "way").agg(F.first("all").alias("all"), F.count("*").alias("n")).where(F.col("n") == F.col("all"))
    return asked.join(there, asked["term"] == there["other"], "left_semi").unionByName(whole.select("term")).distinct()


def relevant_disputes(evidence: DataFrame, analysed: DataFrame, known: DataFrame, sources: DataFrame, points: DataFrame, most: int = 2) -> DataFrame:
    """Disputed points that a question's answer has to report: ``qid``, ``topic``, ``coverage``, ``values``.

    ``evidence``: qid, doc, page, start, end, place; ``analysed``: qid, wants, strict, periods; ``known``: qid, term, idf;
    ``sources`` and ``points`` as ``conflicts.disputed_points`` gives them. A point counts where one of its sources
    overlaps a span of the best three, its sources' words cover half of the question's weight and hold an anchor, it is of
    a wanted kind (or the question is not strict), and it names the question's period if there is one.
    """
    spans = evidence.where("place <= 3").select("qid", F.col("doc").alias("source"), "page", F.col("start").alias("s0"), F.col("end").alias("s1"))
    met = spans.join(sources, ["source", "page"]).where((F.col("start") < F.col("s1")) & (F.col("s0") < F.col("end"))).select("qid", "topic").distinct()
    said = sources.groupBy("topic").agg(F.concat_ws(" ", F.array_sort(F.collect_set(F.lower("sentence")))).alias("said"), F.array_sort(F.collect_set("value")).alias("values"), F.first("value_kind").alias("kind"))
    met = met.join(said, "topic").join(analysed.select("qid", "wants", "strict", "periods"), "qid")
    fits = (F.size("wants") == 0) | F.array_contains("wants", F.col("kind")) | ~F.col("strict") | (F.col("kind") == "assertion")
    period = (F.size("periods") == 0) | F.exists("periods", lambda p: F.contains("said", p))
    met = met.where(fits & period)
    words = T.content_terms(met.select("qid", "topic", "said"), "said").select("qid", "topic", "term").distinct()
    total = known.groupBy("qid").agg(F.sum("idf").alias("total"))
    anchor = R.anchors(known).withColumn("anchor", F.lit(1))
    cov = words.join(known.select("qid", "term", "idf"), ["qid", "term"]).join(anchor, ["qid", "term"], "left")
    cov = cov.groupBy("qid", "topic").agg(F.sum("idf").alias("got"), F.max("anchor").alias("anchor")).join(total, "qid")
    cov = cov.withColumn("coverage", F.col("got") / F.col("total")).where("coverage >= 0.5 and anchor = 1")
    out = cov.join(points.select("topic", F.col("score").alias("weight")), "topic").select("qid", "topic", (F.col("weight") + F.col("coverage")).alias("score"), "coverage")
    out = R.top(out.withColumnRenamed("topic", "id"), most).withColumnRenamed("id", "topic")
    return out.join(said.select("topic", "values"), "topic").select("qid", "topic", "coverage", "values")
