"""Registered queries on stated values: a line item states a part's discount on its ship date, by an order.

Formal sources are line items of status F, amending ones those with return flag R.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from spanledger.functions import text as T
from spanledger.operators import answers, conflicts, graph, passages, positions as P, retrieval as R
from spanledger.session import table
from spanledger.streaming import stages

DAY = "1997-06-30"


def sources(spark, d):
    l = table(spark, d, "lineitem")
    pct = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return l.select(F.col("l_partkey").alias("topic"), F.concat(pct, F.lit("%")).alias("value"), F.col("l_orderkey").alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), (F.col("l_linestatus") == "F").alias("formal"), (F.col("l_returnflag") == "R").alias("amends"), "l_suppkey")


def claim_conflicts(spark, d):
    return P.value_conflicts(sources(spark, d))


def disputed_points(spark, d):
    return P.disputed(P.positions(sources(spark, d))).select("topic", "value", "place", "n_statements", "n_sources", "oldest", "newest", "formal_newest", "amends")


def likely_current(spark, d):
    return P.likely_current(P.positions(sources(spark, d)))


def as_of_snapshot(spark, d):
    return P.as_of(sources(spark, d), DAY)


def timeline_introduces(spark, d):
    return P.introduces(sources(spark, d))


def corroboration(spark, d):
    return P.corroboration(P.positions(sources(spark, d)))


def supersession_pairs(spark, d):
    s = sources(spark, d)
    return P.supersession_pairs(s, P.positions(s))


def board_edges(spark, d):
    return P.board_edges(sources(spark, d))


def compare_suppliers(spark, d):
    """Parts of the first two suppliers, side by side."""
    s = sources(spark, d).withColumn("side", F.col("l_suppkey").cast("string"))
    return P.compare(s, "1", "2")


def documents_as_of(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("day"))
    return P.documents_as_of(o, DAY)


def values_equal_matrix(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("money", "duration", "percent", "number")])).alias("kind")
    a = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), kinds)
    b = F.col("a") * (1 + (F.col("p_partkey") % 11) / 200)
    return a.withColumn("b", b).select("p_partkey", "kind", P.values_equal(F.col("kind"), F.col("a"), F.col("b"), F.lit("USD"), F.lit("USD")).alias("equal"))


def conflict_components(spark, d):
    """Orders linked by stating different discounts for one part in one month, as components."""
    s = sources(spark, d).withColumn("month", F.substring("day", 1, 7))
    w = Window.partitionBy("topic", "month").orderBy("value", "source")
    chain = s.withColumn("nxt", F.lead("source").over(w)).where("nxt is not null and nxt != source")
    return graph.components(chain.select(F.col("source").alias("a"), F.col("nxt").alias("b")))


def evidence_greedy(spark, d):
    """Documents as evidence for the benchmark questions: best coverage, anchored, one of equal texts, two of a source."""
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    terms = R.query_terms(b, "item_id", "text")
    postings, _ = R.asked_index(docs, "doc_id", "text", terms)
    known = graph.cut(R.known_terms(postings, R.count_of(docs), terms))
    known = graph.cut(known.join(R.anchors(known).withColumn("anchor", F.lit(True)), ["qid", "term"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False))))
    # rows that the choice below drops for their score or want of an anchor never meet the texts
    cov = graph.cut(answers.near_best(R.covered(postings, known, F.max("anchor").alias("anchored")).withColumnRenamed("coverage", "score")))
    norm = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), F.md5(F.lower(T.normalize_ws(F.col("text"))).cast("binary")).alias("norm"))
    c = cov.join(norm, "id").select("qid", "doc", F.col("id").alias("sentence_id"), "norm", "score", "anchored")
    return answers.select_evidence(c).select("qid", "doc", "sentence_id", "score", "place")


def confidence_levels(spark, d):
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    cov = R.coverage(docs, "doc_id", "text", b, "item_id", "text")
    g = cov.groupBy("qid").agg(F.max("coverage").alias("best"), F.count(F.when(F.col("coverage") >= 0.5, 1)).alias("supporting"))
    s = answers.answer_confidence(F.col("best"), F.col("best"), F.col("best"), F.col("supporting"), F.lit(0.0))
    g = g.withColumn("confidence", F.round(s, 3))
    status = F.when(F.col("confidence") < answers.ABSTAIN, "insufficient").otherwise("answered")
    return g.select("qid", "confidence", answers.level(status, F.col("confidence")).alias("level"))


def status_machine(spark, d):
    """Latest event of each user as its stage, with the share of the way it has come."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))
    return g


def ingest_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Events of a user as stages, in their order; a purchase ends the way.
EVENT_STAGES = ["signup", "view", "click", "purchase"]


def stage_transitions(spark, d):
    """The stage machine as a stream over the events of all users: moves, refusals, and users that were silent for a day."""
    e = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(f"{d}/events.parquet*")
    log = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), "ts")
    moved = stages.transitions(log, EVENT_STAGES, ("purchase",), "1 hour", "1 day")
    out = graph.own_folder(spark, "stages")
    moved.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stages.SCHEMA).parquet(f"{out}/rows")
    return rows.groupBy(F.col("doc_id").cast("long").alias("user_id"), "stage", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def retention_purge(spark, d):
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    kept = o.crossJoin(F.broadcast(last)).where(F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 365 DAYS"))
    return kept.select("o_orderkey", "o_orderdate")


def cache_misses(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id").join(e.where("label % 2 = 0").select("vec_id"), "vec_id", "left_anti")


def casefile_stats(spark, d):
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    j = docs.join(lab.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n_documents"), F.count("quality").alias("n_reviewed"), F.sum(F.coalesce((F.col("quality") == 0).cast("long"), F.lit(0))).alias("n_unreadable"), F.sum(F.when(T.addresses_ai(F.col("text")), 1).otherwise(0)).alias("n_injections"), F.sum("n_chars").alias("n_chars"))


def rendered_documents(spark, d):
    """Three dated documents for each supplier that state its account's credit limit; for every third one the amendment differs.

    The table is small and its documents are much work, so suppliers are dealt over tasks by a fixed number, which Spark does not reduce.
    """
    v = (1000 + F.abs(F.col("s_acctbal")).cast("int")).alias("v")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), v).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    limit = lambda v: F.concat(F.lit("credit limit of account Acme"), F.translate(F.lpad(F.col("k").cast("string"), 7, "0"), "0123456789", "abcdefghij"), F.lit(" is $"), F.format_number(v, 0))
    changed = F.col("v") + F.when(F.col("k") % 3 == 0, 900).otherwise(0)
    kinds = F.array(
        F.struct(F.lit("contract_").alias("name"), F.lit(".txt").alias("end"), F.lit("2023-01-01").alias("day"), F.concat(F.lit("The "), limit(F.col("v")), F.lit(".")).alias("text")),
        F.struct(F.lit("amendment_").alias("name"), F.lit(".txt").alias("end"), F.lit("2024-01-15").alias("day"), F.concat(F.lit("The "), limit(changed), F.lit(" as amended.")).alias("text")),
        F.struct(F.lit("email_").alias("name"), F.lit(".eml").alias("end"), F.lit("2024-02-02").alias("day"), F.concat(F.lit("Reminder that the "), limit(F.col("v")), F.lit(".")).alias("text")),
    )
    x = s.select("k", F.explode(kinds).alias("x"))
    name = F.concat("x.name", F.col("k").cast("string"), "x.end")
    return x.select(name.alias("doc_id"), name.alias("name"), "x.day", "x.text", F.lit(None).cast("double").alias("ocr_conf"))


def _rendered_scan(spark, d):
    docs = rendered_documents(spark, d)
    return conflicts.scan(passages.claims(passages.chunks(passages.one_page(docs, "doc_id", "text"))), docs)


def rendered_conflicts(spark, d):
    """Conflicts between the claims of rendered documents: passages, claims, candidate pairs, value tests."""
    f = _rendered_scan(spark, d)
    account = F.regexp_extract("sentence_a", "account ([A-Za-z]+)", 1)
    return f.select(account.alias("account"), "doc_name_a", "doc_name_b", "value_kind", "value_a", "value_b", "severity", "same_document")


def rendered_disputes(spark, d):
    """Disputed points of rendered documents and the value that likely holds."""
    points, src = conflicts.disputed_points(_rendered_scan(spark, d))
    account = src.groupBy("topic").agg(F.first(F.regexp_extract("sentence", "account ([A-Za-z]+)", 1)).alias("account"))
    now = P.likely_current(P.positions(src)).select("topic", "value", "basis")
    out = points.join(account, "topic").join(now, "topic")
    return out.select("account", "n_positions", "n_sources", "value_kind", "severity", "value", "basis")


QUERIES = [rendered_conflicts, rendered_disputes, claim_conflicts, disputed_points, likely_current, as_of_snapshot, timeline_introduces, corroboration, supersession_pairs, board_edges, compare_suppliers, documents_as_of, values_equal_matrix, conflict_components, evidence_greedy, confidence_levels, status_machine, ingest_windows, stage_transitions, retention_purge, cache_misses, casefile_stats]

_S = "WITH src AS (SELECT l_partkey AS topic, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%' AS value, l_orderkey AS source, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus = 'F' AS formal, l_returnflag = 'R' AS amends, l_suppkey FROM lineitem)"


def _pos(src: str, name: str = "pos") -> str:
    return f"""{name}0 AS (SELECT topic, value, count(*) AS n_statements, count(DISTINCT source) AS n_sources, min(day) AS oldest, max(day) AS newest, max(CASE WHEN formal THEN day END) AS formal_newest, bool_or(amends) AS amends FROM {src} GROUP BY topic, value),
{name} AS (SELECT *, count(*) OVER (PARTITION BY topic) AS n_positions, row_number() OVER (PARTITION BY topic ORDER BY oldest, value) - 1 AS place FROM {name}0)"""


def _cur(pos: str = "pos", name: str = "cur") -> str:
    return f"""{name}p AS (SELECT a.topic, a.value, a.n_positions, a.place, a.newest,
  a.amends AND a.formal_newest IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pos} b WHERE b.topic = a.topic AND b.value != a.value AND coalesce(b.formal_newest, b.newest) >= a.formal_newest) AS win,
  NOT EXISTS (SELECT 1 FROM {pos} b WHERE b.topic = a.topic AND b.value != a.value AND b.newest >= a.newest) AS latest
  FROM {pos} a WHERE a.n_positions > 1),
{name} AS (SELECT topic, max(n_positions) AS n_positions, coalesce(arg_min(value, place) FILTER (WHERE win), max(value) FILTER (WHERE latest)) AS value,
  CASE WHEN count(*) FILTER (WHERE win) > 0 THEN 'amendment' WHEN count(*) FILTER (WHERE latest) > 0 THEN 'recency' END AS basis FROM {name}p GROUP BY topic)"""


from spanledger.plans import text_queries as _t  # noqa: E402

_COVERAGE = f"{_t._BASE}, {_t._QTERM}, {_t._COV}"

_R = """WITH r AS (SELECT s_suppkey AS k, 'Acme' || translate(lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij') AS account, 1000 + CAST(trunc(abs(s_acctbal)) AS INTEGER) AS v FROM supplier),
x AS (SELECT k, account, '$' || format('{:,}', v) AS old, '$' || format('{:,}', v + 900) AS new FROM r WHERE k % 3 = 0 AND 900 > 0.01 * (v + 900))"""

ORACLE = {
    "rendered_conflicts": f"""{_R} SELECT account, 'contract_' || k || '.txt' AS doc_name_a, 'amendment_' || k || '.txt' AS doc_name_b, 'money' AS value_kind, old AS value_a, new AS value_b, 'high' AS severity, false AS same_document FROM x
UNION ALL SELECT account, 'amendment_' || k || '.txt', 'email_' || k || '.eml', 'money', new, old, 'high', false FROM x""",
    "rendered_disputes": f"{_R} SELECT account, CAST(2 AS BIGINT) AS n_positions, CAST(3 AS BIGINT) AS n_sources, 'money' AS value_kind, 'high' AS severity, new AS value, 'amendment' AS basis FROM x",
    "claim_conflicts": f"{_S}, v AS (SELECT topic, value, count(*) AS n FROM src GROUP BY topic, value) SELECT topic, CAST(sum(n) AS BIGINT) AS n_statements, count(*) AS n_values, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS n_conflicts FROM v GROUP BY topic",
    "disputed_points": f"{_S}, {_pos('src')} SELECT topic, value, CAST(place AS INTEGER) AS place, n_statements, n_sources, oldest, newest, formal_newest, amends FROM pos WHERE n_positions > 1",
    "likely_current": f"{_S}, {_pos('src')}, {_cur()} SELECT * FROM cur",
    "as_of_snapshot": f"""{_S}, known AS (SELECT * FROM src WHERE day <= '{DAY}'), {_pos('known')}, {_cur()},
n AS (SELECT topic, count(*) AS known, max(value) AS only_value FROM pos GROUP BY topic),
up AS (SELECT topic, count(*) AS upcoming FROM (SELECT topic, value FROM src GROUP BY topic, value HAVING min(day) > '{DAY}') GROUP BY topic)
SELECT t.topic, CASE WHEN known IS NULL THEN 'not_yet' WHEN known = 1 THEN 'settled' WHEN cur.value IS NOT NULL THEN 'likely' ELSE 'disputed' END AS status,
CASE WHEN known = 1 THEN only_value ELSE cur.value END AS value, basis, coalesce(known, 0) AS positions_known, coalesce(upcoming, 0) AS upcoming
FROM (SELECT DISTINCT topic FROM src) t LEFT JOIN n USING (topic) LEFT JOIN cur USING (topic) LEFT JOIN up USING (topic)""",
    "timeline_introduces": f"""{_S}, f AS (SELECT topic, value, min(day) AS key FROM src GROUP BY topic, value), g AS (SELECT f.topic, f.value, f.key, min(source) AS source FROM f JOIN src ON src.topic = f.topic AND src.value = f.value AND src.day = f.key GROUP BY f.topic, f.value, f.key)
SELECT topic, value, source, key, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY key, value) AS nth FROM g) WHERE nth > 1""",
    "corroboration": f"{_S}, {_pos('src')} SELECT topic, value, n_sources, n_sources >= 2 AS corroborated FROM pos WHERE n_positions > 1",
    "supersession_pairs": f"""{_S}, {_pos('src')}, {_cur()},
m AS (SELECT topic, value, max(day) AS key FROM src GROUP BY topic, value),
latest AS (SELECT m.topic, m.value, m.key, max(source) AS source FROM m JOIN src ON src.topic = m.topic AND src.value = m.value AND src.day = m.key GROUP BY m.topic, m.value, m.key),
j AS (SELECT latest.*, cur.value AS winner FROM latest JOIN cur ON cur.topic = latest.topic WHERE cur.value IS NOT NULL),
p AS (SELECT o.topic, o.source AS older, n.source AS newer FROM j o JOIN j n ON o.topic = n.topic WHERE o.value != o.winner AND n.value = n.winner AND o.key < n.key AND o.source != n.source)
SELECT older, newer, count(DISTINCT topic) AS n_topics, CASE WHEN count(DISTINCT topic) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM p GROUP BY older, newer""",
    "board_edges": f"""{_S}, {_pos('src')}
SELECT CAST(source AS VARCHAR) AS a, CAST(src.topic AS VARCHAR) || '=' || src.value AS b, count(*) AS weight, 'states' AS kind FROM src JOIN pos ON pos.topic = src.topic AND pos.value = src.value WHERE n_positions > 1 GROUP BY 1, 2
UNION ALL SELECT CAST(topic AS VARCHAR) || '=' || value, CAST(topic AS VARCHAR) || '=' || nxt, 1, 'conflicts' FROM (SELECT *, lead(value) OVER (PARTITION BY topic ORDER BY place) AS nxt FROM pos WHERE n_positions > 1) WHERE nxt IS NOT NULL""",
    "compare_suppliers": f"""{_S}, x AS (SELECT topic, l_suppkey AS s, value, row_number() OVER (PARTITION BY topic, l_suppkey ORDER BY day DESC, value DESC) AS rn FROM src WHERE l_suppkey IN (1, 2)),
g AS (SELECT topic, max(CASE WHEN s = 1 THEN value END) AS left_value, max(CASE WHEN s = 2 THEN value END) AS right_value FROM x WHERE rn = 1 GROUP BY topic)
SELECT *, CASE WHEN right_value IS NULL THEN 'only_left' WHEN left_value IS NULL THEN 'only_right' WHEN left_value = right_value THEN 'unchanged' ELSE 'changed' END AS state FROM g""",
    "documents_as_of": f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 != 0 THEN strftime(o_orderdate, '%Y-%m') END AS day FROM orders)
SELECT *, CASE WHEN day IS NULL THEN 'undated' WHEN day || '-01' > '{DAY}' THEN 'later' END AS reason, coalesce(day || '-01' <= '{DAY}', false) AS used FROM o""",
    "values_equal_matrix": """WITH a AS (SELECT p_partkey, p_retailprice AS a, p_retailprice * (1 + (p_partkey % 11) / 200) AS b, kind FROM part, (VALUES ('money'), ('duration'), ('percent'), ('number')) k(kind))
SELECT p_partkey, kind, CASE kind WHEN 'percent' THEN abs(a - b) <= 0.05 ELSE abs(a - b) <= CASE kind WHEN 'money' THEN 0.01 WHEN 'duration' THEN 0.03 ELSE 0.005 END * greatest(abs(a), abs(b), 1e-9) END AS equal FROM a""",
    "evidence_greedy": f"""{_COVERAGE},
known AS (SELECT qid, term, idf, max(idf) OVER (PARTITION BY qid) AS highest FROM q_terms JOIN dfs USING (term) WHERE term NOT IN ({", ".join("'" + w + "'" for w in R.GENERIC)})),
anchor AS (SELECT qid, term FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, term) AS nth FROM known WHERE idf >= 0.75 * highest) WHERE nth <= 2),
hit AS (SELECT DISTINCT qid, id, true AS anchored FROM postings JOIN anchor USING (term)),
c AS (SELECT qid, source AS doc, id AS sentence_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS norm, coverage AS score, coalesce(anchored, false) AS anchored FROM cov JOIN documents ON doc_id = id LEFT JOIN hit USING (qid, id)),
s1 AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, sentence_id) AS r FROM c),
s2 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc, norm ORDER BY score DESC, doc, sentence_id) AS n FROM s1 WHERE score >= greatest(0.45 * best, 0.18) AND (r = 1 OR anchored)),
s3 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, doc, sentence_id) AS m FROM s2 WHERE n = 1),
s4 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, sentence_id) AS place FROM s3 WHERE m <= 2)
SELECT qid, doc, sentence_id, score, CAST(place AS INTEGER) AS place FROM s4 WHERE place <= 5""",
    "confidence_levels": f"""{_COVERAGE},
g AS (SELECT qid, max(coverage) AS best, count(*) FILTER (WHERE coverage >= 0.5) AS supporting FROM cov GROUP BY qid),
s AS (SELECT qid, round(greatest(0, least(0.97, 0.65 * best + 0.35 * best + CASE WHEN supporting >= 2 THEN 0.08 ELSE 0 END - CASE WHEN best < 0.5 THEN (0.5 - best) * 0.5 ELSE 0 END)), 3) AS confidence FROM g)
SELECT qid, confidence, CASE WHEN confidence < 0.4 THEN 'INSUFFICIENT' WHEN confidence >= 0.68 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""",
    "status_machine": "SELECT user_id, stage, n_events, last_ts FROM (SELECT user_id, event_type AS stage, count(*) OVER (PARTITION BY user_id) AS n_events, ts AS last_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "ingest_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stage_transitions": """WITH e AS (SELECT user_id, event_type AS stage, ts, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS place FROM events),
o AS (SELECT *, max(place) OVER (PARTITION BY user_id ORDER BY ts, coalesce(place, 4), stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
m AS (SELECT *, CASE WHEN place > coalesce(before, -1) THEN 'advanced' ELSE 'refused' END AS kind FROM o),
u AS (SELECT user_id, max(place) AS reached, max(ts) AS ts FROM m GROUP BY user_id),
s AS (SELECT user_id, CASE reached WHEN 0 THEN 'signup' WHEN 1 THEN 'view' WHEN 2 THEN 'click' END AS stage, ts, 'stuck' AS kind FROM u
  WHERE coalesce(reached, -1) < 3 AND ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
SELECT user_id, stage, kind, count(*) AS n, max(ts) AS last_ts FROM (SELECT user_id, stage, kind, ts FROM m UNION ALL SELECT user_id, stage, kind, ts FROM s) GROUP BY ALL""",
    "retention_purge": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY",
    "cache_misses": "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)",
    "casefile_stats": f"""SELECT lang, count(*) AS n_documents, count(quality) AS n_reviewed, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unreadable, CAST(sum(CASE WHEN {T.addresses_ai_sql('text')} THEN 1 ELSE 0 END) AS BIGINT) AS n_injections, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
}
