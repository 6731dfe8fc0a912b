"""Where quotes stand in texts: a phrase join on word positions, for many quotes and many texts at once.

A text is its words (runs of characters that are not blank) with their positions. A quote of five words or more is looked up
by three neighbouring words inside it, a shorter one by the word inside it, in each case by the choice that occurs least
often in the texts; a quote of one or two words by the words of the vocabulary that end, begin or contain it. Such places
are joined with their texts and compared there, word by word. Only places of words that quotes have leave the first pass over
the texts, and only texts with a place are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators.graph import cut

#: What separates words besides ASCII's blanks, in all scripts.
OTHER_BLANKS = "\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
GRAM = 3


def _plain(text: Column) -> Column:
    """The text, null as empty, with a blank for each of the other blanks; places in it stay the same."""
    return F.translate(F.coalesce(text, F.lit("")), OTHER_BLANKS, " " * len(OTHER_BLANKS))


def _pieces(text: Column) -> Column:
    """The words of a text, each with the blanks before it."""
    return F.regexp_extract_all(_plain(text), F.lit(r"\s*\S+"), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(_plain(text), F.lit(r"\S+"), F.lit(0))


def _lower_words(text: Column) -> Column:
    return words(F.lower(text))


def _grams(held: DataFrame, *sizes: int) -> DataFrame:
    """``gram`` (the hash of so many neighbouring words) and ``pos`` for every place in ``ws``, for all ``sizes`` in one pass."""
    rest = [c for c in held.columns if c != "ws"]
    hashed = held.select(*rest, F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))

    def of(size: int) -> Column:
        last = F.size("hs") - size
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct(k.alias("pos"), F.xxhash64(F.lit(size), *[F.get("hs", k + j) for j in range(size)]).alias("gram")))

    return hashed.select(*rest, F.inline(F.concat(*map(of, sizes))))


def _inner(quotes: DataFrame) -> DataFrame:
    """Choices (``qid``, ``k``: the place in the quote, ``gram``) of quotes that have words between the first and the last."""
    size = F.size("ws")
    of = lambda q, n: _grams(q.select("qid", F.slice("ws", 2, F.size("ws") - 2).alias("ws")), n)
    both = of(quotes.where(size >= GRAM + 2), GRAM).unionByName(of(quotes.where((size > 2) & (size < GRAM + 2)), 1))
    return both.select("qid", (F.col("pos") + 1).alias("k"), "gram")


def _brief(quotes: DataFrame, held: DataFrame) -> DataFrame:
    """Choices of quotes of one or two words: the words of the texts that end with the first one, or contain it if it is the only one."""
    first = quotes.where(F.size("ws") <= 2).select("qid", F.size("ws").alias("n"), F.element_at("ws", 1).alias("part"))
    of_length = lambda n: F.array_sort(F.collect_set(F.when(F.col("n") == n, F.length("part"))))
    # one row, or none where no quote is so short: then the texts are not read for this
    lengths = first.agg(of_length(1).alias("l1"), of_length(2).alias("l2")).where("size(l1) + size(l2) > 0")
    vocabulary = held.crossJoin(F.broadcast(lengths)).select(F.explode(F.array_distinct("ws")).alias("word"), "l1", "l2").distinct()
    long = F.length("word")
    ends = vocabulary.select("word", F.explode(F.filter("l2", lambda n: n <= long)).alias("len"))
    ends = ends.select("word", F.lit(2).alias("n"), F.substring("word", long - F.col("len") + 1, F.col("len")).alias("part"))
    inside = vocabulary.select("word", F.explode(F.filter("l1", lambda n: n <= long)).alias("len"))
    inside = inside.select("word", "len", F.explode(F.sequence(F.lit(1), long - F.col("len") + 1)).alias("from"))
    inside = inside.select("word", F.lit(1).alias("n"), F.substring("word", F.col("from"), F.col("len")).alias("part")).distinct()
    return ends.unionByName(inside).join(first, ["n", "part"]).select("qid", F.lit(0).alias("k"), F.xxhash64(F.lit(1), F.xxhash64("word")).alias("gram"))


def _places(held: DataFrame, quotes: DataFrame) -> DataFrame:
    """Places (``qid``, ``id``, ``at``) where a quote may begin. The texts are read once for all quotes of three words or more."""
    inner, brief = cut(_inner(quotes)), cut(_brief(quotes, held))
    wanted = inner.select("gram").union(brief.select("gram")).distinct()
    postings = cut(_grams(held, 1, GRAM).join(wanted, "gram", "left_semi"))
    often = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # a quote of which one choice is nowhere stands nowhere
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "gram")).alias("best")
    rarest = inner.join(often, "gram", "left").groupBy("qid").agg(best).where("best.n > 0").select("qid", "best.k", "best.gram")
    return postings.join(rarest.unionByName(brief), "gram").select("qid", "id", (F.col("pos") - F.col("k")).alias("at")).where("at >= 0").distinct()


def locate(texts: DataFrame, quotes: DataFrame, id_col: str = "id", text_col: str = "text", qid_col: str = "qid", quote_col: str = "quote") -> DataFrame:
    """``qid``, ``id``, ``start`` and ``end`` (characters from 0, the end not included) of every text that a quote stands in.

    A quote stands where its characters do, verbatim, and the first such place is told; else where its words do, with any
    blanks between them and in any case, and again the first is told. Its first word may end a longer one, its last word may
    begin one. ``passages.find_span`` says the same of one text. Edge cases: null and blank quotes and null or empty texts
    give no row; ids, in both tables, are taken to be unique (rows that repeat one give their places together, the first is
    told); letters whose lower case has another length count by their own length. Other columns do not matter.
    """
    told = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = quotes.select(F.col(qid_col).alias("qid"), F.col(quote_col).alias("quote")).withColumn("ws", _lower_words(F.col("quote"))).where(F.size("ws") > 0)
    held = told.select("id", _lower_words(F.col("text")).alias("ws"))
    found = _places(held, asked).join(asked.withColumnRenamed("ws", "qs"), "qid").join(told, "id").withColumn("ws", words(F.col("text")))
    n, at = F.size("qs"), F.col("at")
    here = F.transform(F.slice("ws", at + 1, n), F.lower)
    first, last = F.element_at("qs", 1), F.element_at("qs", -1)
    same = F.when(n == 1, F.contains(F.element_at(here, 1), first)).otherwise(
        (F.size(here) == n) & F.endswith(F.get(here, F.lit(0)), first) & F.startswith(F.get(here, n - 1), last) & (F.slice(here, 2, F.greatest(n - 2, F.lit(0))) == F.slice("qs", 2, F.greatest(n - 2, F.lit(0)))))
    found = found.where(same)

    # characters before the k-th word
    pieces = _pieces(F.col("text"))
    before = lambda k: F.length(F.array_join(F.slice(pieces, 1, k + 1), "")) - F.length(F.get("ws", k))
    head = F.get("ws", at)
    start = before(at) + F.when(n == 1, F.instr(F.lower(head), first) - 1).otherwise(F.length(head) - F.length(first))
    end = F.when(n == 1, start + F.length(first)).otherwise(before(at + n - 1) + F.length(last))
    word_for_word = F.instr(F.col("text"), F.col("quote"))
    verbatim = F.when(word_for_word > 0, F.struct((word_for_word - 1).alias("start"), (word_for_word - 1 + F.length("quote")).alias("end")))
    spans = found.select("qid", "id", verbatim.alias("exact"), F.struct(start.alias("start"), end.alias("end")).alias("loose"))
    best = spans.groupBy("qid", "id").agg(F.coalesce(F.min("exact"), F.min("loose")).alias("span"))
    return best.select("qid", "id", F.col("span.start").alias("start"), F.col("span.end").alias("end"))
