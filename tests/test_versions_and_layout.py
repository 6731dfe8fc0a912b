"""Versions of a document, pages from boxes, uncited exceptions, neighbourhoods."""

import random

import pytest
from pyspark.sql import functions as F

from spanledger.operators import graph, passages, positions, review, versions
from spanledger.sources import layout

OLD = "# Coverage Limits\nThe maximum claim limit is $500,000 per policy year.\nThe waiting period is 30 days before a claim can be filed.\n# Premium\nThe annual premium is $1,200 for a standard plan.\n# Retention\nClaim records are kept for 5 years."
NEW = "# Coverage Limits\nThe maximum claim limit is $1,000,000 per policy year.\nThe waiting period is 14 days before a claim can be filed.\n# Premium\nThe annual premium is $1,200 for a standard plan.\n# Deductible\nThe deductible is $250 for every approved claim."


def test_changes_between_two_versions(spark):
    docs = spark.createDataFrame([("old", OLD), ("new", NEW)], "doc_id string, text string")
    c = passages.claims(passages.chunks(passages.one_page(docs, "doc_id", "text")))
    c = c.withColumn("pair", F.lit(1)).withColumn("side", F.when(F.col("doc_id") == "old", "left").otherwise("right"))
    rows = versions.changes(c).collect()
    changed = {r["kind"]: r for r in rows if r["state"] == "changed"}
    assert (changed["money"]["value_l"], changed["money"]["value_r"], changed["money"]["delta"], changed["money"]["description"]) == ("$500,000", "$1,000,000", 500000.0, "increased by $500,000 (+100.0%)")
    assert (changed["duration"]["direction"], changed["duration"]["delta"], changed["duration"]["description"]) == ("decreased", -16.0, "decreased by 16 days (-53.3%)")
    assert all(r["doc_id_l"] == "old" and r["doc_id_r"] == "new" and r["sentence_l"] in OLD and r["sentence_r"] in NEW for r in changed.values())
    state = lambda s, c: {r[c] for r in rows if r["state"] == s}
    assert "$1,200" in state("unchanged", "value_l") and "$250" in state("only_right", "value_r") and "5 years" in state("only_left", "value_l")


def test_matching_is_one_to_one_and_stable(spark):
    rng = random.Random(3)
    pairs = sorted({(p, f"l{rng.randrange(8)}", f"r{rng.randrange(8)}") for p in range(3) for _ in range(30)})
    rows = [(*x, rng.choice([0.5, 0.6, 0.7, 0.8])) for x in pairs]
    want = []
    used = set()
    for p, l, r, s in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (p, l) not in used and (p, r) not in used:
            used |= {(p, l), (p, r)}
            want.append((p, l, r, s))
    got = versions.matched(spark.createDataFrame(rows, "pair int, l string, r string, score double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_descriptions_and_the_guard_of_numbers(spark):
    rows = [("date", None, None, "2023-03-03", "2023-03-05", None), ("percent", 5.0, 7.5, None, None, None), ("number", 142.0, 128.0, None, None, None), ("money", 0.0, 1.5, None, None, "CHF"), ("duration", 1.0, 2.0, None, None, "hour"), ("number", 3.0, 3.0, None, None, None)]
    d = spark.createDataFrame(rows, "k string, a double, b double, x string, y string, u string")
    got = [r["t"]["text"] for r in d.select(versions.described(d.k, d.a, d.b, d.x, d.y, d.u).alias("t")).collect()]
    assert got == ["moved 2 days later", "increased by 2.5 percentage points", "decreased by 14 (-9.9%)", "increased by 1.5 CHF", "increased by 1 hour (+100.0%)", "unchanged"]
    g = spark.createDataFrame([("Up by 1,200 to 3.5", ["was 2", "1200 and 3.5"]), ("Up by 9", ["8"]), (None, ["8"])], "s string, f array<string>")
    assert [r["n"] for r in g.select(versions.new_numbers(g.s, g.f).alias("n")).collect()] == [[], ["9"], []]


def test_pages_from_boxes(spark):
    boxes = [("d", 1, 10.0, 50.5, 60.0, 60.5, "March", 0.9), ("d", 1, 200.0, 50.0, 240.0, 60.0, "96.2%", 0.8), ("d", 1, 10.0, 10.0, 50.0, 20.0, "Month", 1.0), ("d", 1, 200.0, 11.0, 232.0, 21.0, "On", 1.0), ("d", 1, 236.0, 10.0, 270.0, 20.0, "time", 1.0), ("d", 1, 300.0, 10.0, 310.0, 20.0, "  ", 0.1), ("d", 2, None, 1.0, 2.0, 3.0, "lost", 0.5), ("d", 3, 0.0, 0.0, 9.0, 9.0, "alone", None)]
    got = {r["page"]: (r["text"], r["ocr_conf"]) for r in layout.page_texts(spark.createDataFrame(boxes, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, conf double")).collect()}
    assert got == {1: ("Month | On time\nMarch | 96.2%", round((11 + 4.5 + 4) / 21, 6)), 3: ("alone", None)}


def test_uncited_exceptions(spark):
    text = "The notice period for termination is 60 days. However, the notice period for termination is waived during probation. Unless it rains, tea is served."
    pool = spark.createDataFrame([(None, "d", 1, 0, "Terms", text), ("q", "e", 1, 5, None, "No notice of termination is needed, provided that both agree."), (None, "f", 1, 0, "Other", "Unless agreed, the notice of termination is void.")], "qid string, doc_id string, page int, start int, section string, text string")
    terms = spark.createDataFrame([("q", "notic"), ("q", "terminat"), ("q", "period"), ("q", "notice"), ("q", "termination"), ("q", "terminate")], "qid string, term string")
    cited = spark.createDataFrame([("q", "d", 1, 0, 45)], "qid string, doc_id string, page int, start int, end int")
    got = {(r["doc_id"], r["start"], r["sentence"]) for r in review.exceptions(cited, pool, terms).collect()}
    at = text.index("However")
    assert got == {("d", at, text[at : text.index(" Unless")]), ("e", 5, "No notice of termination is needed, provided that both agree.")}
    both = spark.createDataFrame([("q", "d", 1, 0, len(text))], "qid string, doc_id string, page int, start int, end int")
    assert {r["doc_id"] for r in review.exceptions(both, pool, terms).collect()} == {"e"}
    scans = spark.createDataFrame([("q", 0.9), ("r", 0.7), ("r", 0.8), ("s", None)], "qid string, ocr_conf double")
    assert [tuple(r) for r in review.poor_scans(scans).collect()] == [("r", 0.7)]


def test_days_of_as_of_questions():
    assert [positions.parse_day(t) for t in ("2023", "2024-02", " 2024-02-03 ")] == ["2023-12-31", "2024-02-29", "2024-02-03"]
    for bad in ("soon", "2024-13", "2024-02-30", "0000", ""):
        with pytest.raises(ValueError):
            positions.parse_day(bad)


def test_neighbourhood_is_breadth_first(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(1, None)]
    seeds = [3, 7, 99]
    at, last = {s: 0 for s in seeds}, seeds
    for hop in (1, 2, 3):
        last = [y for y in {b for a, b in edges if a in last} | {a for a, b in edges if b in last} if y is not None and y not in at]
        at |= {y: hop for y in last}
    got = graph.neighbourhood(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(s,) for s in seeds], "id int"), 3)
    assert {r["id"]: r["hops"] for r in got.collect()} == at


def test_shares_round_from_the_binary_value(spark):
    rnd = random.Random(3)
    xs = [900 / v * 100 for v in (1600, 2880, 4800, 8000, 1000, 1440)] + [12.35, 0.05, -0.05, 0.25, -0.75, 99.95, 0.0] + [rnd.uniform(-1e5, 1e5) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(versions.one_decimal(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{x:+.1f}" for x in xs]
