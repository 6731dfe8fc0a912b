import pytest

from spanledger.functions import values as V


@pytest.mark.parametrize("text, want", [
    ("The value is $480,000.", ("money", 480000.0, "USD")),
    ("A budget of $2.4 million was approved.", ("money", 2400000.0, "USD")),
    ("It costs EUR 1,500 per seat.", ("money", 1500.0, "EUR")),
    ("within sixty (60) days", ("duration", 60.0, "day")),
    ("2 months", ("duration", 60.0, "day")),
    ("twenty-four (24) months", ("duration", 720.0, "day")),
    ("Net 45", ("duration", 45.0, "day")),
    ("3 hours", ("duration", 3.0, "hour")),
    ("ten business days", ("duration", 10.0, "business day")),
    ("tested weekly", ("duration", 7.0, "day")),
    ("1.5% per month", ("percent", 1.5, "%")),
    ("142 employees", ("number", 142.0, "")),
])
def test_first_value(text, want):
    v = V.values(text)[0]
    assert (v.kind, v.num, v.unit) == want


@pytest.mark.parametrize("text, want", [("March 3, 2023", "2023-03-03"), ("3 March 2023", "2023-03-03"), ("June 2024", "2024-06"), ("03/04/2023", "2023-03-04"), ("13/04/23", "2023-04-13"), ("2023-02-30", None)])
def test_dates(text, want):
    assert [d for d, _, _ in V.dates(text)] == ([want] if want else [])


def test_references_are_no_numbers():
    assert V.values("See Section 4.2 in 2023, Table 3 on page 12") == []


def test_context():
    s = "As of Dec 31, 2023 the company has 142 employees."
    day, n = V.add_context(s, V.values(s))
    assert day.scope_date and n.stative and n.anchor == "employe" and n.raw == "142 employees"


def test_sentences_keep_offsets():
    t = "He met Dr. Smith. Then he left!\n- A list line\nIt cost 3. 5 apples were left."
    spans = list(V.sentences(t))
    assert [t[a:b] for a, b in spans][:3] == ["He met Dr. Smith.", "Then he left!", "- A list line"]
    assert all(t[a:b] == t[a:b].strip() for a, b in spans)


def test_stems_agree_with_native(spark):
    from pyspark.sql import functions as F
    from spanledger.functions import text as T

    words = "terminated termination terminate policies boxes classes running national stopped agreements usually uses ties abs 2200 a1s fully press bus analysis operational quickly hopping".split()
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [V.stem(w) for w in words]


def test_long_line_of_sentences_is_read_in_linear_time():
    import time

    text = "The limit is 5 days. " * 30_000
    start = time.monotonic()
    assert sum(1 for _ in V.sentences(text)) == 30_000
    assert time.monotonic() - start < 10


def test_a_sentence_is_read_once(monkeypatch):
    made = []
    plain = V.Line.__init__
    monkeypatch.setattr(V.Line, "__init__", lambda self, text: (made.append(text), plain(self, text))[1])
    s = "Every worker named Alice gets twenty days and $5 by March 2031."
    vs = V.add_context(s, V.values(s))
    V.qualifiers(s, vs)
    assert len(made) == 1 and [v.kind for v in vs] == ["duration", "money", "date"]
