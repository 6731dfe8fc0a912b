"""Quotes located by the phrase join against the search in one text."""

import random

from spanledger.operators import passages, spans


def located(spark, texts, quotes):
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "qid long, quote string")
    return {(r.qid, r.id): (r.start, r.end) for r in spans.locate(t, q).collect()}


def expected(texts, quotes):
    out = {(k, j): passages.find_span(t or "", q or "") for j, t in enumerate(texts) for k, q in enumerate(quotes)}
    return {key: span for key, span in out.items() if span}


def test_cases(spark):
    texts = ["Due  in\nMay or June", "in or in May", "undue in Mayfair", None, "", "  Ünder the Blue sky 𝒳 of the blue Sky.", "a a a b a a a a b", "The fee is due. THE fee is due."]
    quotes = ["due in may", "in May", "due", "MAY", "the blue sky", "sky 𝒳 of", "a a b", "a b", "a", None, " ", "due inmay", "fee is due. the fee is du", " in", "of the blue sky."]
    assert located(spark, texts, quotes) == expected(texts, quotes)


def test_random_texts(spark):
    pick = random.Random(5)
    vocabulary = ["a", "ab", "ba", "abc", "B", "Ab.", "c"]
    gap = [" ", "  ", "\n", " "]

    def text(n):
        return "".join(w + pick.choice(gap) for w in pick.choices(vocabulary, k=n))

    texts = [text(pick.randint(0, 60)) for _ in range(40)]
    quotes = [text(pick.randint(1, 7)).strip() for _ in range(120)]
    quotes += [t[k : k + pick.randint(2, 30)].strip() for t in texts if len(t) > 5 for k in [pick.randrange(len(t) - 2)]]
    got, want = located(spark, texts, quotes), expected(texts, quotes)
    assert len(want) > 500 and got == want


def test_empty_tables_and_other_columns(spark):
    t = spark.createDataFrame([(1, "one two three four five six", "x")], "doc long, text string, qid string")
    q = spark.createDataFrame([(7, "TWO three  four five SIX", "y")], "k long, quote string, id string")
    args = {"id_col": "doc", "qid_col": "k"}
    assert [tuple(r) for r in spans.locate(t, q, **args).collect()] == [(7, 1, 4, 27)]
    assert spans.locate(t.limit(0), q, **args).count() == 0 and spans.locate(t, q.limit(0), **args).count() == 0
