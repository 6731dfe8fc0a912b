"""Registered text and ranking queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from spanledger.functions import text as T
from spanledger.operators import retrieval as R
from spanledger.session import table


def tokens_count(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"))


def stem_vocabulary(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).withColumn("stem", T.stem(F.col("token")))


def term_df_idf(spark, d):
    docs = table(spark, d, "documents")
    df = R.document_frequencies(docs, "text")
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark, d):
    return R.bm25(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", k=10)


def char_ngram_topk(spark, d):
    return R.char_ngram(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", k=3)


def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return R.dense(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5)


def rrf_fusion(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    args = (docs, "doc_id", "text", b, "item_id", "text")
    postings, totals = R.asked_index(docs, "doc_id", "text", R.query_terms(b, "item_id", "text"))
    lexical = R.bm25(*args, k=R.DEPTH, postings=postings, totals=totals)
    cov = R.top(R.coverage(*args, postings=postings).withColumnRenamed("coverage", "score"), R.DEPTH)
    return R.fuse([(lexical, 1.0), (cov, 0.6)])


def term_coverage(spark, d):
    return R.coverage(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def number_within(rows, key: str, order: str, width: int = 1 << 14):
    """Adds ``n``: the place of a row among those of its key, by the long ``order``.

    Rows are numbered inside ranges of ``order`` and the ranges' counts are summed up, so no key is one task.
    """
    cell = F.floor(F.col(order) / width)
    counts = rows.groupBy(key, cell.alias("__cell")).agg(F.count("*").alias("__rows"))
    upto = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__cell", F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__start"))
    inside = rows.withColumn("__cell", cell).withColumn("__n", F.row_number().over(Window.partitionBy(key, "__cell").orderBy(order)))
    return inside.join(starts, [key, "__cell"]).withColumn("n", F.col("__start") + F.col("__n")).drop("__cell", "__n", "__start")


def quote_verify(spark, d):
    """Which documents hold a benchmark text verbatim; candidates meet on the quote's longest token."""
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    tok = F.explode(T.tokenize(F.col("quote"))).alias("tok")
    w = Window.partitionBy("item_id").orderBy(F.desc(F.length("tok")), "tok")
    key = quotes.select("item_id", "quote", tok).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("tok")).join(key, "tok").select("doc_id", "item_id", "quote")
    return held.join(docs, "doc_id").where(T.contains_quote(F.col("text"), F.col("quote"))).select("item_id", "doc_id")


def dedupe_sha256(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies"))
    return docs.join(first, "sha256").select("doc_id", "sha256", "kept_id", "copies", (F.col("doc_id") != F.col("kept_id")).alias("duplicate"))


def unique_names(spark, d):
    """Names from sources: the n-th document of a source gets its number, in order of ids."""
    docs = table(spark, d, "documents").select("doc_id", T.safe_name(F.concat("source", F.lit(".txt"))).alias("base"))
    docs = number_within(docs, "base", "doc_id")
    return docs.select("doc_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(F.regexp_replace("base", r"\.txt$", ""), F.lit(" ("), F.col("n"), F.lit(").txt"))).alias("name"))


def injection_scan(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text", F.lit("conversation").alias("kind"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text", F.lit("document").alias("kind"))
    return c.unionByName(docs).groupBy("kind").agg(F.count("*").alias("n"), F.sum(T.addresses_ai(F.col("text")).cast("long")).alias("n_injections"))


def negations(spark, d):
    return table(spark, d, "documents").select("doc_id", T.negation_count(F.col("text")).cast("long").alias("n_negations"))


def quote_forms(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.quote_form(F.col("text")).alias("form"))


def partial_date_order(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").substr(1, 10).alias("day"))
    p = F.when(F.col("o_orderkey") % 3 == 0, F.substring("day", 1, 4)).when(F.col("o_orderkey") % 3 == 1, F.substring("day", 1, 7)).otherwise(F.col("day"))
    o = o.withColumn("partial", p)
    return o.groupBy("partial").agg(F.count("*").alias("n"), F.sum(T.dates_compatible(F.col("partial"), F.col("day")).cast("long")).alias("n_compatible")).withColumn("sort_key", T.date_key(F.col("partial")))


def followup_context(spark, d):
    """Questions with few terms, or a pronoun in front, take the previous question of their conversation along."""
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    terms = F.size(F.array_distinct(T.content(T.tokenize(F.col("text")), T.QUESTION_FILLER)))
    c = c.withColumn("prev", F.lag("text").over(w)).withColumn("n_terms", terms)
    pronoun = F.lower("text").rlike(r"^\s*(and|but|what about|how about|it|its|that|this|those|these|they|them|their|he|she|why|so)\b")
    joined = F.col("prev").isNotNull() & ((F.col("n_terms") <= 1) | (pronoun & (F.col("n_terms") <= 2)))
    return c.select("conv_id", "turn", F.when(joined, F.concat_ws(" ", "prev", "text")).otherwise(F.col("text")).alias("effective"), joined.alias("follow_up"))


def question_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n_questions"), F.max("turn").alias("last_turn"))


QUERIES = [tokens_count, stem_vocabulary, term_df_idf, bm25_topk, char_ngram_topk, dense_topk, rrf_fusion, term_coverage, quote_verify, dedupe_sha256, unique_names, injection_scan, negations, quote_forms, partial_date_order, followup_context, question_counts]

_TOK = f"docs_tok AS (SELECT doc_id AS id, unnest({T.tokens_sql('text')}) AS t FROM documents)"
_KEEP = f"t NOT IN ({T.stop_sql()}) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$'))"
_VOCAB = f"vocab AS (SELECT t, {T.stem_sql('t')} AS term FROM (SELECT DISTINCT t FROM (SELECT t FROM docs_tok UNION ALL SELECT t FROM q_tok)))"
_QTOK = f"q_tok AS (SELECT item_id AS qid, unnest({T.tokens_sql('text')}) AS t FROM benchmark)"
_POST = f"postings AS (SELECT id, term, count(*) AS tf FROM docs_tok JOIN vocab USING (t) WHERE {_KEEP} GROUP BY id, term)"
_QTERM = f"""q_all AS (SELECT DISTINCT qid, t, term FROM q_tok JOIN vocab USING (t) WHERE {_KEEP}),
q_few AS (SELECT DISTINCT qid, term FROM q_all WHERE t NOT IN ({", ".join("'" + w + "'" for w in T.QUESTION_FILLER)})),
q_terms AS (SELECT * FROM q_few UNION ALL SELECT DISTINCT qid, term FROM q_all WHERE qid NOT IN (SELECT qid FROM q_few))"""
_DF = "dfs AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings GROUP BY term)"
_BASE = f"WITH {_TOK},\n{_QTOK},\n{_VOCAB},\n{_POST},\n{_DF}"
_BM25 = f"""lens AS (SELECT id, sum(tf) AS dl FROM postings GROUP BY id), av AS (SELECT sum(dl) / (SELECT count(*) FROM documents) AS avgdl FROM lens),
scored AS (SELECT qid, id, round(sum(idf * tf * 2.4 / (tf + 1.4 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM postings JOIN q_terms USING (term) JOIN dfs USING (term) JOIN lens USING (id), av GROUP BY qid, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM scored)"""
_COV = """cov AS (SELECT qid, id, round(sum(idf) / max(total), 6) AS coverage FROM postings JOIN q_terms USING (term) JOIN dfs USING (term)
  JOIN (SELECT qid, sum(idf) AS total FROM q_terms JOIN dfs USING (term) GROUP BY qid) USING (qid) GROUP BY qid, id)"""
_GRAMS = """unnest(CASE WHEN length(w) < 3 THEN [w] ELSE list_concat(list_concat([substr(w, CAST(k AS BIGINT), 3) for k in range(1, length(w) - 1)], [substr(w, CAST(k AS BIGINT), 4) for k in range(1, length(w) - 2)]), [substr(w, CAST(k AS BIGINT), 5) for k in range(1, length(w) - 3)]) END)"""
_PREV = "lag(text) OVER (PARTITION BY conv_id ORDER BY turn)"

ORACLE = {
    "tokens_count": f"SELECT doc_id, CAST(len({T.tokens_sql('text')}) AS INTEGER) AS n_tokens FROM documents",
    "stem_vocabulary": f"WITH {_TOK} SELECT t AS token, count(*) AS n, any_value(s) AS stem FROM docs_tok JOIN (SELECT t, {T.stem_sql('t')} AS s FROM (SELECT DISTINCT t FROM docs_tok)) USING (t) GROUP BY t",
    "term_df_idf": f"{_BASE} SELECT term, df, round(idf, 6) AS idf FROM dfs",
    "bm25_topk": f"{_BASE}, {_QTERM}, {_BM25} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank < 10",
    "term_coverage": f"{_BASE}, {_QTERM}, {_COV} SELECT * FROM cov",
    "rrf_fusion": f"""{_BASE}, {_QTERM}, {_BM25}, {_COV},
c2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, id) - 1 AS rank FROM cov)
SELECT qid, id, round(sum(part), 9) AS fused FROM (SELECT qid, id, 1.0 / (20 + rank) AS part FROM ranked WHERE rank < 24 UNION ALL SELECT qid, id, 0.6 / (20 + rank) FROM c2 WHERE rank < 24) GROUP BY qid, id""",
    "char_ngram_topk": f"""WITH ws AS (SELECT 0 AS q, doc_id AS id, ' ' || unnest({T.tokens_sql('text')}) || ' ' AS w FROM documents UNION ALL SELECT 1, item_id, ' ' || unnest({T.tokens_sql('text')}) || ' ' FROM benchmark),
g AS (SELECT q, id, gram, count(*) AS tf FROM (SELECT q, id, {_GRAMS} AS gram FROM ws) GROUP BY q, id, gram),
i AS (SELECT gram, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM g WHERE q = 0 GROUP BY gram),
v AS (SELECT q, id, gram, (1 + ln(tf)) * idf AS v FROM g JOIN i USING (gram)),
n AS (SELECT q, id, sqrt(sum(v * v)) AS n FROM v GROUP BY q, id),
s AS (SELECT a.id AS qid, b.id AS id, round(sum(a.v * b.v) / (max(na.n) * max(nb.n)), 6) AS score FROM (SELECT * FROM v WHERE q = 1) a JOIN (SELECT * FROM v WHERE q = 0) b USING (gram) JOIN n na ON na.q = 1 AND na.id = a.id JOIN n nb ON nb.q = 0 AND nb.id = b.id GROUP BY a.id, b.id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 3""",
    "dense_topk": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS qid, v.id AS id, round(list_cosine_similarity(v.v, q.v), 6) AS score FROM v, v q WHERE q.id % 50 = 0 AND q.id != v.id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 5""",
    "quote_verify": r"""WITH q AS (SELECT item_id, regexp_replace(lower(trim(regexp_replace(translate(text, '’‘“”–—', '''''""--'), '\s+', ' ', 'g'))), '^[ .…"'']+|[ .…"'']+$', '', 'g') AS f FROM benchmark),
p AS (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(translate(text, '’‘“”–—', '''''""--'), '\s+', ' ', 'g'))), '^[ .…"'']+|[ .…"'']+$', '', 'g') AS f FROM documents)
SELECT item_id, doc_id FROM q, p WHERE length(q.f) >= 8 AND contains(p.f, q.f)""",
    "quote_forms": r"""SELECT item_id, regexp_replace(lower(trim(regexp_replace(translate(text, '’‘“”–—', '''''""--'), '\s+', ' ', 'g'))), '^[ .…"'']+|[ .…"'']+$', '', 'g') AS form FROM benchmark""",
    "dedupe_sha256": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS copies, doc_id != min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents",
    "unique_names": "SELECT doc_id, CASE WHEN n = 1 THEN source || '.txt' ELSE source || ' (' || CAST(n AS VARCHAR) || ').txt' END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)",
    "injection_scan": f"""WITH a AS (SELECT 'conversation' AS kind, text FROM conversations UNION ALL SELECT 'document', text FROM documents)
SELECT kind, count(*) AS n, CAST(sum(CASE WHEN {T.addresses_ai_sql('text')} THEN 1 ELSE 0 END) AS BIGINT) AS n_injections FROM a GROUP BY kind""",
    "negations": f"""WITH t AS (SELECT doc_id, lower(text) AS x FROM documents)
SELECT doc_id, CAST(len([w for w in regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_'']+') if w IN ({", ".join("'" + w + "'" for w in T.NEGATIVE_WORDS)}) OR ends_with(w, 'n''t')]) + len(regexp_extract_all(x, '\\b(failed|fails) to\\b')) AS BIGINT) AS n_negations FROM t""",
    "partial_date_order": """WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN substr(day, 1, 4) WHEN o_orderkey % 3 = 1 THEN substr(day, 1, 7) ELSE day END AS partial, day FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day FROM orders))
SELECT partial, count(*) AS n, CAST(sum(CASE WHEN starts_with(day, partial) OR starts_with(partial, day) THEN 1 ELSE 0 END) AS BIGINT) AS n_compatible, partial || CASE length(partial) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS sort_key FROM o GROUP BY partial""",
    "followup_context": f"""WITH c AS (SELECT conv_id, turn, text, {_PREV} AS prev, len(list_distinct([t for t in {T.tokens_sql('text')} if t NOT IN ({T.stop_sql(T.QUESTION_FILLER)}) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$'))])) AS n_terms FROM conversations WHERE role = 'user'),
f AS (SELECT *, prev IS NOT NULL AND (n_terms <= 1 OR (n_terms <= 2 AND regexp_matches(lower(text), '^\\s*(and|but|what about|how about|it|its|that|this|those|these|they|them|their|he|she|why|so)\\b'))) AS follow_up FROM c)
SELECT conv_id, turn, CASE WHEN follow_up THEN prev || ' ' || text ELSE text END AS effective, follow_up FROM f""".replace("\\\\", "\\"),
    "question_counts": "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_questions, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
}
