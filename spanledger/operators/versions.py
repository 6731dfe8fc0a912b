"""What changed between two versions of a document: statements matched one to one, and the change in words.

Many pairs of documents are compared at once. Values of one kind and unit meet on a shared term; the weight of what
their surroundings share, against all that both have, is the score. Of the scored pairs those that are the best of both
sides are matched, and the rest is matched again without them, until nothing is left to match: a one-to-one assignment
in which no two statements would rather have each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.text import date_key, dates_compatible
from spanledger.operators import graph
from spanledger.operators.positions import values_equal

#: Pairs that share less of their weight are different statements.
LEAST_SHARED = 0.5
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹"}


def statements(claims: DataFrame) -> DataFrame:
    """``pair``, ``side`` and the values of claims (``pair``, ``side`` and CLAIM_SCHEMA): vid, v, terms, sentence, place."""
    c = claims.select("pair", "side", "claim_id", "doc_id", "page", "start", "sentence", F.array_distinct(F.concat("stems", "heading_stems")).alias("said"), F.posexplode("quantities").alias("n", "v"))
    return c.where(~((F.col("v.kind") == "date") & F.col("v.scope_date"))).select("pair", "side", F.concat_ws("#", "claim_id", F.col("n").cast("string")).alias("vid"), "v", F.array_distinct(F.concat("said", "v.ctx")).alias("terms"), "doc_id", "page", "start", "sentence")


def scored(s: DataFrame) -> DataFrame:
    """``pair``, ``l``, ``r``, ``score`` of the values of both sides that share enough."""
    n = s.groupBy("pair").agg(F.count("*").alias("n"))
    t = s.select("pair", "side", "vid", "v.kind", "v.unit", F.explode("terms").alias("t"))
    # a term that many statements of a pair of documents have says less about each
    weight = t.groupBy("pair", "t").agg(F.count("*").alias("c")).join(n, "pair").select("pair", "t", F.log(1 + F.col("n") / F.col("c")).alias("w"))
    t = graph.cut(t.join(weight, ["pair", "t"]))
    total = t.groupBy("pair", "side", "vid").agg(F.sum("w").alias("all"))
    half = lambda side: t.where(F.col("side") == side).select("pair", "kind", F.coalesce("unit", F.lit("")).alias("unit"), "t", F.col("vid").alias(side[0]), "w")
    both = half("left").join(half("right").drop("w"), ["pair", "kind", "unit", "t"]).groupBy("pair", "l", "r").agg(F.sum("w").alias("shared"))
    of = lambda side: total.where(F.col("side") == side).select("pair", F.col("vid").alias(side[0]), F.col("all").alias(f"all_{side[0]}"))
    both = both.join(of("left"), ["pair", "l"]).join(of("right"), ["pair", "r"])
    score = F.round(F.col("shared") / (F.col("all_l") + F.col("all_r") - F.col("shared")), 9)
    return both.select("pair", "l", "r", score.alias("score")).where(F.col("score") >= LEAST_SHARED)


def matched(pairs: DataFrame, most: int = 60) -> DataFrame:
    """A one-to-one choice of ``pair``, ``l``, ``r``, ``score``: what is best for both sides, then again without it."""
    left, out = graph.cut(pairs), None
    for _ in range(most):
        if left.isEmpty():
            return out if out is not None else left
        best = lambda c: F.row_number().over(Window.partitionBy("pair", c).orderBy(F.desc("score"), "l", "r"))
        taken = graph.cut(left.withColumn("a", best("l")).withColumn("b", best("r")).where("a = 1 and b = 1").drop("a", "b"))
        out = taken if out is None else out.unionByName(taken)
        for c in ("l", "r"):
            left = left.join(taken.select("pair", c), ["pair", c], "left_anti")
        left = graph.cut(left)
    raise RuntimeError(f"statements are not matched after {most} rounds")


def _plain(x: Column) -> Column:
    """A number with thousands separators and at most two decimals."""
    return F.regexp_replace(F.format_number(F.abs(x), 2), r"\.?0+$", "")


def one_decimal(x: Column) -> Column:
    """A number with its sign and one decimal, rounded from its exact binary value (ties to even), as C and Python do.

    Java rounds the shortest decimal form half up: 56.25 gives 56.3 there.
    """
    whole = F.floor(F.abs(x))
    # the part behind the point in units of 2^-58, exact from 1/64 on; ten times as much stays within 63 bits
    ten = F.floor((F.abs(x) - whole) * float(1 << 58)) * 10
    digit, rest, half = F.shiftright(ten, 58), ten.bitwiseAND(F.lit((1 << 58) - 1)), F.lit(1 << 57)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    tenths = whole * 10 + digit + up.cast("long")
    sign = F.when(x < 0, "-").otherwise("+")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def described(kind: Column, a_num: Column, b_num: Column, a_dt: Column, b_dt: Column, unit: Column) -> Column:
    """(direction, delta, text) of a change from ``a`` to ``b``."""
    day = lambda d: F.to_date(date_key(d))
    delta = F.when(kind == "date", F.datediff(day(b_dt), day(a_dt)).cast("double")).otherwise(F.round(b_num - a_num, 6))
    direction = F.when(delta > 0, F.when(kind == "date", "later").otherwise("increased")).when(delta < 0, F.when(kind == "date", "earlier").otherwise("decreased")).otherwise("same")
    sign = F.lit("")
    for code, s in SIGNS.items():
        sign = F.when(unit == code, s).otherwise(sign)
    many = lambda word: F.concat(F.lit(" "), word, F.when(F.abs(delta) != 1, "s").otherwise(""))
    size = F.when(kind == "money", F.concat(sign, _plain(delta), F.when(sign == "", F.concat(F.lit(" "), unit)).otherwise(""))).when(kind == "percent", F.concat(_plain(delta), F.lit(" percentage points"))).when(kind == "duration", F.concat(_plain(delta), many(unit))).otherwise(_plain(delta))
    share = F.when((kind != "percent") & (a_num != 0), F.concat(F.lit(" ("), one_decimal(delta / a_num * 100), F.lit("%)"))).otherwise("")
    text = F.when(kind == "date", F.concat(F.lit("moved "), _plain(delta), many(F.lit("day")), F.lit(" "), direction)).otherwise(F.concat(direction, F.lit(" by "), size, share))
    return F.struct(direction.alias("direction"), delta.alias("delta"), F.when(delta == 0, "unchanged").otherwise(text).alias("text"))


def changes(claims: DataFrame) -> DataFrame:
    """All statements of both sides of every pair: ``state`` (changed, unchanged, only_left, only_right), kind, both values
    and sentences with their places, direction, delta and description. ``claims``: pair, side (left, right), CLAIM_SCHEMA.
    """
    s = graph.cut(statements(claims))
    m = matched(scored(s))
    side = lambda name: s.where(F.col("side") == name).select("pair", F.col("vid").alias(name[0]), *[F.col(c).alias(f"{c}_{name[0]}") for c in ("v", "doc_id", "page", "start", "sentence")])
    j = m.join(side("left"), ["pair", "l"]).join(side("right"), ["pair", "r"])
    told = described(F.col("v_l.kind"), F.col("v_l.num"), F.col("v_r.num"), F.col("v_l.dt"), F.col("v_r.dt"), F.col("v_r.unit"))
    same = F.when(F.col("v_l.kind") == "date", dates_compatible(F.col("v_l.dt"), F.col("v_r.dt"))).otherwise(values_equal(F.col("v_l.kind"), F.col("v_l.num"), F.col("v_r.num"), F.col("v_l.unit"), F.col("v_r.unit")))
    j = j.withColumn("x", told).withColumn("same", F.coalesce(same, F.lit(False)))
    places = [f"{c}_{x}" for x in "lr" for c in ("doc_id", "page", "start", "sentence")]
    told_rows = j.select("pair", F.when(F.col("same"), "unchanged").otherwise("changed").alias("state"), F.col("v_l.kind").alias("kind"), F.col("v_l.raw").alias("value_l"), F.col("v_r.raw").alias("value_r"), *places,
                         F.when(~F.col("same"), F.col("x.direction")).alias("direction"), F.when(~F.col("same"), F.col("x.delta")).alias("delta"), F.when(~F.col("same"), F.col("x.text")).alias("description"))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {"doc_id": "string", "page": "int", "start": "int", "sentence": "string"}
    for mine, other in (("left", "right"), ("right", "left")):
        x, y = mine[0], other[0]
        alone = side(mine).join(m.select("pair", x), ["pair", x], "left_anti")
        told_rows = told_rows.unionByName(alone.select("pair", F.lit(f"only_{mine}").alias("state"), F.col(f"v_{x}.kind").alias("kind"), F.col(f"v_{x}.raw").alias(f"value_{x}"), none("string").alias(f"value_{y}"), *[F.col(f"{c}_{x}") for c in kinds], *[none(k).alias(f"{c}_{y}") for c, k in kinds.items()], none("string").alias("direction"), none("double").alias("delta"), none("string").alias("description")))
    return told_rows


def numbers(text: Column) -> Column:
    """The figures of a text without thousands separators."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"^0+(?=\d)", ""))


def new_numbers(summary: Column, facts: Column) -> Column:
    """Figures of a summary that none of the texts ``facts`` (an array) holds; a summary with any is to be refused."""
    return F.array_except(numbers(summary), F.flatten(F.transform(facts, numbers)))
