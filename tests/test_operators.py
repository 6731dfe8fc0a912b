import random

from pyspark.sql import functions as F

from spanledger.operators import answers, conflicts, graph, passages, positions, retrieval

SRC = "topic string, value string, source string, day string, formal boolean, amends boolean"


def claims_of(spark, docs):
    d = spark.createDataFrame([(str(k), n, t, day) for k, (n, t, day) in enumerate(docs)], "doc_id string, name string, text string, day string")
    c = passages.claims(passages.chunks(passages.one_page(d, "doc_id", "text"))).persist()
    return conflicts.scan(c, d.withColumn("ocr_conf", F.lit(None).cast("double")))


def test_passages_are_page_slices():
    page = "\n".join(["# Scope", *["This sentence tells of the terms of payment and delivery of goods." for _ in range(40)], "TERMINATION", "Either party may end it."])
    rows = passages.chunk_pages([(1, page)], "Title")
    assert all(page[r["start"] : r["end"]] == r["text"] for r in rows)
    assert [r["section"] for r in rows][0] == "Scope" and rows[-1]["section"] == "Termination" and len(rows) > 3
    assert passages.heading("12. Payment Terms") and passages.heading("Plain words, ended.") is None


def test_three_way_dispute(spark):
    found = claims_of(spark, [("contract.txt", "Invoices are payable Net 30 from the invoice date.", "2023-01-01"), ("amendment.txt", "Invoices are payable Net 45 from the invoice date, as amended.", "2024-01-15"), ("email.eml", "Reminder: invoices are payable Net 30 from the invoice date.", "2024-02-02"), ("other.txt", "Either party may terminate this agreement with 60 days notice.", None)]).persist()
    points, sources = conflicts.disputed_points(found)
    p = points.collect()
    assert len(p) == 1 and p[0]["n_positions"] == 2 and p[0]["n_sources"] == 3
    current = positions.likely_current(positions.positions(sources)).collect()[0]
    assert (current["value"], current["basis"]) == ("Net 45", "amendment")


def test_guards_keep_pairs_apart(spark):
    found = claims_of(spark, [("a.txt", "Alice earns a salary of $90,000 per year.", None), ("b.txt", "Bob earns a salary of $95,000 per year.", None), ("c.txt", "Either party may terminate with notice of sixty (60) days.", None), ("d.txt", "Either party may terminate with 2 months written notice.", None)])
    assert found.count() == 0


def test_as_of_states(spark):
    rows = [("t", "Net 30", "c", "2023-01-01", True, False), ("t", "Net 45", "a", "2024-01-15", True, True), ("u", "$1", "x", None, True, False), ("u", "$2", "y", None, True, False)]
    s = spark.createDataFrame(rows, SRC)
    state = lambda day: {r["topic"]: (r["status"], r["value"], r["upcoming"]) for r in positions.as_of(s, day).collect()}
    assert state("2020-01-01") == {"t": ("not_yet", None, 2), "u": ("not_yet", None, 0)}
    assert state("2023-12-31")["t"] == ("settled", "Net 30", 1)
    assert state("2024-01-15")["t"] == ("likely", "Net 45", 0)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_evidence_and_levels(spark):
    rows = [(1, "a", 1, "x", 0.9, False), (1, "a", 2, "y", 0.8, True), (1, "a", 3, "z", 0.7, True), (1, "b", 4, "x", 0.6, False), (1, "b", 5, "q", 0.5, True), (1, "c", 6, "r", 0.1, True)]
    got = answers.select_evidence(spark.createDataFrame(rows, "qid int, doc string, sentence_id int, norm string, score double, anchored boolean")).orderBy("place").collect()
    assert [r["sentence_id"] for r in got] == [1, 2, 5]


def test_synonyms_rank(spark):
    p = spark.createDataFrame([("1", "The headcount is 40."), ("2", "The sky is blue.")], "id string, text string")
    q = spark.createDataFrame([("q", "How many employees are there?")], "qid string, text string")
    assert [r["id"] for r in retrieval.bm25(p, "id", "text", q, "qid", "text", synonyms=True).collect()] == ["1"]


def test_review_refutes_forged_answers(spark):
    from spanledger.operators import review

    a = spark.createDataFrame([("1", "It is Net 45."), ("2", "It is Net 30."), ("3", "It is Net 30.")], "qid string, text string")
    c = spark.createDataFrame([(q, d, 1, 0, 20, "payable Net 30") for q, d in (("1", "x"), ("2", "x"), ("3", "y"), ("3", "z"))], "qid string, doc_id string, page int, start int, end int, quote string")
    ok = c.select("qid", F.lit(True).alias("verbatim"))
    s = spark.createDataFrame([(7, "y", 1, 10, 30)], "topic long, source string, page int, start int, end int")
    told = spark.createDataFrame([("3", 7)], "qid string, topic long")
    got = lambda t: {r["qid"]: r["verdict"] for r in review.verdicts(a, c, ok, s, t).collect()}
    assert got(told) == {"1": "refuted", "2": "weakened", "3": "survived"}
    assert got(told.limit(0))["3"] == "refuted"
