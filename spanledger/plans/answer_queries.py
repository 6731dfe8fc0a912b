"""Registered queries on drafted answers: scripted drafts about rendered documents, and what is left of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.operators import answers, composer, graph, passages, spans, versions
from spanledger.operators import positions as P
from spanledger.operators import retrieval as R
from spanledger.plans.claim_queries import _COVERAGE, _S, _pos, rendered_documents, sources
from spanledger.session import table

#: Scores of the base that the scripted questions share.
DISPUTE_SCORE = 0.9


def _texts(spark, d):
    """k, the three texts, the old and the new value, of every supplier."""
    docs = rendered_documents(spark, d).withColumn("k", F.regexp_extract("doc_id", r"_(\d+)\.", 1).cast("long"))
    text = lambda kind: F.max(F.when(F.col("doc_id").startswith(kind), F.col("text")))
    x = docs.groupBy("k").agg(text("contract").alias("t1"), text("amendment").alias("t2"), text("email").alias("t3"))
    value = lambda t: F.regexp_extract(t, r"\$[0-9,]+[0-9]", 0)
    return x.withColumn("old", value("t1")).withColumn("new", value("t2"))


def _draft():
    """The scripted draft of a supplier, by k % 5: forged, good, partly forged, dismissing, reporting a conflict."""
    quote = lambda p, q: F.struct(F.lit(p).alias("passage"), q.alias("quote"))
    claims = lambda *sources: F.array(F.struct(F.lit("limit").alias("text"), F.array(*sources).alias("sources")))
    forged = F.lit("The credit limit of this account is unlimited.")
    good1, good2 = quote("P1", F.upper(F.substring("t1", 5, 200))), quote("P2", F.col("t2"))
    case = F.col("k") % 5
    told = F.when(case == 0, claims(quote("P1", forged))).when(case == 1, claims(good1)).when(case == 2, claims(good1, quote("P1", forged))).when(case == 3, claims(good2))
    side = lambda p, v, q: F.struct(F.lit(p).alias("passage"), v.alias("claim"), q.alias("quote"))
    sides = F.array(side("P1", F.col("old"), F.col("t1")), side("P2", F.col("new"), F.col("t2")))
    conflicts = F.when(case == 4, F.array(F.struct(F.lit("C1").alias("candidate_id"), F.lit("two limits").alias("summary"), sides.alias("positions"))))
    gone = F.when(case == 3, F.array(F.struct(F.lit("C1").alias("candidate_id"), F.lit("amended").alias("reason"))))
    status = F.when(case == 4, "conflict").otherwise("answered")
    return F.to_json(F.struct(status.alias("status"), F.concat(F.lit("limit "), "old").alias("headline"), F.lit("See [P1].").alias("answer"), F.lit("medium").alias("confidence"), told.alias("claims"), conflicts.alias("conflicts"), gone.alias("dismissed_candidates")))


def verified_answers(spark, d):
    """What quote checks, disputed points and penalties leave of a scripted draft about each supplier's credit limit."""
    x = _texts(spark, d)
    p = F.explode(F.array(*[F.struct(F.lit(f"P{n}").alias("pid"), F.concat(F.lit(f"{name}_"), F.col("k").cast("string")).alias("doc"), F.col(f"t{n}").alias("text")) for n, name in ((1, "contract"), (2, "amendment"), (3, "email"))])).alias("p")
    none = F.lit(None).cast("string")
    offered = x.select(F.col("k").cast("string").alias("qid"), p).select("qid", "p.pid", F.col("p.doc").alias("chunk"), F.col("p.doc").alias("doc_id"), F.col("p.doc").alias("doc_name"), F.lit(1).alias("page"), F.lit(0).alias("start"), "p.text", none.alias("day"), F.lit(None).cast("double").alias("ocr_conf"))
    source = lambda kind, t: F.struct(*[F.concat(F.lit(f"{kind}_"), F.col("k").cast("string")).alias(c) for c in ("chunk", "doc_id", "doc_name")], F.lit(1).alias("page"), F.lit(0).alias("start"), F.length(t).alias("end"), F.col(t).alias("sentence"), none.alias("day"), F.lit(None).cast("double").alias("ocr_conf"))
    sides = F.array(F.struct(F.col("old").alias("value"), F.array(source("contract", "t1"), source("email", "t3")).alias("sources")), F.struct(F.col("new").alias("value"), F.array(source("amendment", "t2")).alias("sources")))
    held = x.where("old != new").select(F.col("k").cast("string").alias("qid"), F.lit("C1").alias("cid"), F.col("k").alias("topic"), F.lit("value").alias("kind"), (F.col("k") % 2 == 0).alias("firm"), F.lit("two limits").alias("explanation"), sides.alias("positions"))
    disputed = F.when(F.col("old") != F.col("new"), 1.0)
    base = x.select(F.col("k").cast("string").alias("qid"), *[F.lit(1.0).alias(c) for c in ("best", "union_cov", "relevance")], F.lit(0.0).alias("missing_share"), (disputed * DISPUTE_SCORE).alias("dispute_score"), disputed.alias("dispute_coverage"), F.lit(False).alias("time_scoped"))
    told = x.select(F.col("k").cast("string").alias("qid"), _draft().alias("draft"))
    out = composer.finalize(told, offered, held, base)
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    return out.select(F.col("qid").cast("long").alias("suppkey"), "status", "level", "headline", "confidence", "n_quotes", "n_bad", F.when(F.col("citations").isNull(), F.lit(0).cast("long")).otherwise(size("citations")).alias("n_citations"), F.when(F.col("conflicts").isNull(), F.lit(0).cast("long")).otherwise(size("conflicts")).alias("n_conflicts"))


def version_changes(spark, d):
    """What the rendered amendment of each supplier changes in its contract."""
    docs = rendered_documents(spark, d).where(~F.col("doc_id").startswith("email"))
    c = passages.claims(passages.chunks(passages.one_page(docs, "doc_id", "text")))
    side = F.when(F.col("doc_id").startswith("contract"), "left").otherwise("right")
    c = c.withColumn("pair", F.regexp_extract("doc_id", r"_(\d+)\.", 1).cast("long")).withColumn("side", side)
    return versions.changes(c).select(F.col("pair").alias("suppkey"), "state", "kind", "value_l", "value_r", "direction", "delta", "description")


def board_neighbours(spark, d):
    """Nodes of the case board within two steps of the orders of the first day."""
    s = sources(spark, d)
    first = s.agg(F.min("day").alias("first"))
    seeds = graph.cut(s.join(F.broadcast(first), F.col("day") == F.col("first")).select("source").distinct())
    edges = P.board_edges(P.board_around(s, seeds, 2))
    return graph.neighbourhood(edges, seeds.select(F.col("source").cast("string").alias("id")), 2).select("id", "hops")


def evidence_cover(spark, d):
    """The two documents that cover most of a benchmark question's terms together."""
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    terms = R.query_terms(b, "item_id", "text")
    postings, _ = R.asked_index(docs, "doc_id", "text", terms)
    known = R.known_terms(postings, R.count_of(docs), terms)
    return answers.cover_terms(postings, known.select("qid", "term", F.col("idf").alias("w")), 2)


def quote_spans(spark, d):
    """Where benchmark texts stand in documents, asked for as they are, in capitals, or with other blanks (item_id % 3)."""
    form = F.when(F.col("item_id") % 3 == 1, F.upper("text")).when(F.col("item_id") % 3 == 2, F.regexp_replace("text", r"\s+", "  ")).otherwise(F.col("text"))
    asked = table(spark, d, "benchmark").select("item_id", form.alias("quote"))
    out = spans.locate(table(spark, d, "documents"), asked, "doc_id", "text", "item_id", "quote")
    return out.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "start", "end")


QUERIES = [quote_spans, evidence_cover, verified_answers, version_changes, board_neighbours]

ORACLE = {
    "quote_spans": r"""
WITH q AS (SELECT item_id, list_transform(regexp_split_to_array(trim(lower(text), E' \t\n\r'), '\s+'), lambda w: regexp_escape(w)) AS ws FROM benchmark),
p AS (SELECT item_id, ws[1] AS anchor, array_to_string(ws, '\s+') AS pattern FROM q),
f AS (SELECT item_id, doc_id, text, regexp_extract(lower(text), '(?s)^.*?(' || pattern || ')', 1) AS found, regexp_extract(lower(text), '(?s)^(.*?)' || pattern, 1) AS head FROM p, documents WHERE regexp_matches(lower(text), pattern))
SELECT item_id, doc_id, CAST(length(head) AS INTEGER) AS "start", CAST(length(head) + length(found) AS INTEGER) AS "end" FROM f""",
    "evidence_cover": f"""{_COVERAGE}, hit AS (SELECT qid, id, term, idf FROM q_terms JOIN dfs USING (term) JOIN postings USING (term)),
g1 AS (SELECT qid, id, round(sum(idf), 6) AS gain FROM hit GROUP BY qid, id), b1 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY gain DESC, id) = 1),
done AS (SELECT DISTINCT qid, term FROM hit JOIN b1 USING (qid, id)), rest AS (SELECT hit.* FROM hit LEFT JOIN done USING (qid, term) WHERE done.qid IS NULL),
g2 AS (SELECT qid, id, round(sum(idf), 6) AS gain FROM rest GROUP BY qid, id), b2 AS (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY gain DESC, id) = 1)
SELECT qid, id, 1 AS step, gain FROM b1 UNION ALL SELECT qid, id, 2, gain FROM b2""",
    "version_changes": """
WITH r AS (SELECT s_suppkey AS k, 1000 + CAST(trunc(abs(s_acctbal)) AS INTEGER) AS v, s_suppkey % 3 = 0 AS changed FROM supplier),
x AS (SELECT *, v + CASE WHEN changed THEN 900 ELSE 0 END AS w FROM r)
SELECT CAST(k AS BIGINT) AS suppkey, CASE WHEN changed THEN 'changed' ELSE 'unchanged' END AS state, 'money' AS kind, '$' || format('{:,}', v) AS value_l, '$' || format('{:,}', w) AS value_r,
  CASE WHEN changed THEN 'increased' END AS direction, CASE WHEN changed THEN CAST(900 AS DOUBLE) END AS delta, CASE WHEN changed THEN 'increased by $900 (+' || printf('%.1f', 900.0 / v * 100) || '%)' END AS description FROM x""",
    "board_neighbours": f"""{_S}, {_pos('src')},
e0 AS (SELECT DISTINCT CAST(source AS VARCHAR) AS a, CAST(src.topic AS VARCHAR) || '=' || src.value AS b FROM src JOIN pos ON pos.topic = src.topic AND pos.value = src.value WHERE n_positions > 1
  UNION SELECT CAST(topic AS VARCHAR) || '=' || value, CAST(topic AS VARCHAR) || '=' || nxt FROM (SELECT *, lead(value) OVER (PARTITION BY topic ORDER BY place) AS nxt FROM pos WHERE n_positions > 1) WHERE nxt IS NOT NULL),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
h0 AS (SELECT DISTINCT CAST(source AS VARCHAR) AS id FROM src WHERE day = (SELECT min(day) FROM src)),
h1 AS (SELECT DISTINCT b AS id FROM e JOIN h0 ON a = id WHERE b NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT b AS id FROM e JOIN h1 ON a = id WHERE b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1))
SELECT id, 0 AS hops FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "verified_answers": f"""
WITH r AS (SELECT s_suppkey AS k, 1000 + CAST(trunc(abs(s_acctbal)) AS INTEGER) AS v FROM supplier),
x AS (SELECT k, k % 5 AS c, '$' || format('{{:,}}', v) AS old, '$' || format('{{:,}}', v + CASE WHEN k % 3 = 0 THEN 900 ELSE 0 END) AS new, k % 3 = 0 AS disputed, k % 3 = 0 AND k % 2 = 0 AS firm FROM r),
y AS (SELECT *, CASE WHEN c IN (2, 4) THEN 2 ELSE 1 END AS n_quotes, CASE WHEN c IN (0, 2) THEN 1 ELSE 0 END AS n_bad,
  CASE WHEN c = 4 OR firm THEN 'conflict' WHEN c = 0 THEN 'insufficient' ELSE 'answered' END AS status FROM x),
z AS (SELECT *, 0.5 * CASE WHEN status = 'conflict' AND disputed THEN 0.55 * {DISPUTE_SCORE} + 0.45 ELSE 0.97 END + 0.5 * 0.6 - 0.12 * n_bad AS s FROM y),
w AS (SELECT *, round(CASE status WHEN 'conflict' THEN least(s, 0.5) WHEN 'insufficient' THEN 0.2 ELSE CASE WHEN disputed AND c != 3 THEN least(s, 0.6) ELSE s END END, 3) AS confidence FROM z)
SELECT CAST(k AS BIGINT) AS suppkey, status, CASE status WHEN 'conflict' THEN 'CONFLICTED' WHEN 'insufficient' THEN 'INSUFFICIENT' ELSE CASE WHEN confidence >= 0.68 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END END AS level,
  CASE WHEN status = 'insufficient' THEN '' WHEN firm AND c != 4 THEN old || ' vs ' || new ELSE 'limit ' || old END AS headline,
  CAST(confidence AS DOUBLE) AS confidence, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_bad AS BIGINT) AS n_bad,
  CAST(CASE WHEN c = 4 THEN 2 WHEN firm THEN 3 WHEN c = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_citations, CAST(CASE WHEN status = 'conflict' THEN 1 ELSE 0 END AS BIGINT) AS n_conflicts FROM w""",
}
