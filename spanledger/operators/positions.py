"""Disputed points, likely-current values, snapshots as of a day, timelines and comparisons.

All of it works on one table of stated values, ``sources``: ``topic``, ``value`` (string), ``source`` (document),
``day`` (partial date or null), ``formal`` and ``amends`` (booleans). A topic with several values is a disputed point;
a value with its sources is a position. Everything is grouped by topic, so it scales with the number of topics; the
first aggregation (topic, value) combines on the map side and is what later windows read.
"""

from __future__ import annotations

import calendar
import datetime
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.text import date_key
from spanledger.operators import graph


def positions(sources: DataFrame) -> DataFrame:
    """One row per (topic, value) with the dates and wording of its sources; ``place`` orders a topic's positions."""
    k = F.when(date_key(F.col("day")) != "", date_key(F.col("day")))
    s = sources.withColumn("key", k)
    p = s.groupBy("topic", "value").agg(
        F.count("*").alias("n_statements"),
        F.count_distinct("source").alias("n_sources"),
        F.min("key").alias("oldest"),
        F.max("key").alias("newest"),
        F.max(F.when(F.col("formal"), F.col("key"))).alias("formal_newest"),
        F.max("amends").alias("amends"),
    )
    w = Window.partitionBy("topic")
    p = p.withColumn("n_positions", F.count("*").over(w))
    return p.withColumn("place", F.row_number().over(w.orderBy(F.coalesce("oldest", F.lit("9999")), "value")) - 1)


def disputed(pos: DataFrame) -> DataFrame:
    return pos.where("n_positions > 1")


def others_newest(pos: DataFrame) -> DataFrame:
    """Adds ``ref`` (formal date, else any), ``others_ref`` (latest of the other positions) and ``others_dated``."""
    w = Window.partitionBy("topic")
    p = pos.withColumn("ref", F.coalesce("formal_newest", "newest"))
    p = p.withColumn("__m", F.max("ref").over(w)).withColumn("__dated", F.count("ref").over(w))
    p = p.withColumn("__ties", F.sum((F.col("ref") == F.col("__m")).cast("int")).over(w))
    p = p.withColumn("__m2", F.max(F.when(F.col("ref") < F.col("__m"), F.col("ref"))).over(w))
    own_top = (F.col("ref") == F.col("__m")) & (F.col("__ties") == 1)
    p = p.withColumn("others_ref", F.when(own_top, F.col("__m2")).otherwise(F.col("__m")))
    own = F.col("ref").isNotNull().cast("int")
    return p.withColumn("others_dated", F.col("__dated") - own == F.col("n_positions") - 1).drop("__m", "__dated", "__ties", "__m2")


def likely_current(pos: DataFrame) -> DataFrame:
    """One row per disputed topic: ``value`` and ``basis`` (amendment, recency, or null when nothing decides).

    Amendment: wording that amends, and a formal date after those of all other positions, which are all dated.
    Recency: all positions are dated and one is strictly newest.
    """
    p = others_newest(disputed(pos))
    w = Window.partitionBy("topic")
    amending = F.coalesce(F.col("amends") & F.col("formal_newest").isNotNull() & F.col("others_dated") & (F.col("formal_newest") > F.col("others_ref")), F.lit(False))
    p = p.withColumn("__a", F.when(amending, F.col("place")))
    p = p.withColumn("__top", F.max("newest").over(w)).withColumn("__all", F.count("newest").over(w) == F.col("n_positions"))
    p = p.withColumn("__r", F.when(F.col("__all") & (F.col("newest") == F.col("__top")), F.col("place")))
    g = p.groupBy("topic").agg(
        F.first("n_positions").alias("n_positions"),
        F.min("__a").alias("__a"),
        F.min_by("value", "__a").alias("__av"),
        F.count("__r").alias("__n"),
        F.min_by("value", "__r").alias("__rv"),
    )
    basis = F.when(F.col("__a").isNotNull(), "amendment").when(F.col("__n") == 1, "recency")
    return g.select("topic", "n_positions", F.when(F.col("__a").isNotNull(), F.col("__av")).when(F.col("__n") == 1, F.col("__rv")).alias("value"), basis.alias("basis"))


def as_of(sources: DataFrame, day: str) -> DataFrame:
    """State of every topic on a day: not_yet, settled, likely or disputed, its value, and values still to come."""
    k = date_key(F.col("day"))
    known = sources.where((k != "") & (k <= day))
    pos = positions(known)
    now = pos.groupBy("topic").agg(F.count("*").alias("known"), F.first("value").alias("only"))
    current = likely_current(pos).select("topic", "value", "basis")
    later = sources.where((k != "") & (k > day)).select("topic", "value").distinct()
    upcoming = later.join(known.select("topic", "value").distinct(), ["topic", "value"], "left_anti").groupBy("topic").agg(F.count("*").alias("upcoming"))
    topics = sources.select("topic").distinct()
    t = topics.join(now, "topic", "left").join(current, "topic", "left").join(upcoming, "topic", "left")
    n = F.coalesce("known", F.lit(0))
    status = F.when(n == 0, "not_yet").when(n == 1, "settled").when(F.col("value").isNotNull(), "likely").otherwise("disputed")
    return t.select("topic", status.alias("status"), F.when(n == 1, F.col("only")).otherwise(F.col("value")).alias("value"), "basis", n.cast("long").alias("positions_known"), F.coalesce("upcoming", F.lit(0)).cast("long").alias("upcoming"))


def parse_day(text: str) -> str:
    """A day for an as-of question: a year or month counts to its last day; anything else that is no day is an error."""
    t = text.strip()
    try:
        if re.fullmatch(r"\d{4}", t):
            return datetime.date(int(t), 12, 31).isoformat()
        if re.fullmatch(r"\d{4}-\d{2}", t):
            year, month = map(int, t.split("-"))
            return datetime.date(year, month, calendar.monthrange(year, month)[1]).isoformat()
        return datetime.date.fromisoformat(t).isoformat()
    except (ValueError, calendar.IllegalMonthError) as e:
        raise ValueError(f"not a day: {text}") from e


def documents_as_of(documents: DataFrame, day: str) -> DataFrame:
    """Adds ``used`` and ``reason`` (undated, later, or null)."""
    k = date_key(F.col("day"))
    reason = F.when(k == "", "undated").when(k > day, "later")
    return documents.withColumn("reason", reason).withColumn("used", F.col("reason").isNull())


def introduces(sources: DataFrame) -> DataFrame:
    """Sources that bring a new value for a topic after its first: topic, value, source, day, nth."""
    k = date_key(F.col("day"))
    first = sources.where(k != "").groupBy("topic", "value").agg(F.min(F.struct(k.alias("key"), "source")).alias("f"))
    w = Window.partitionBy("topic").orderBy("f.key", "value")
    return first.withColumn("nth", F.row_number().over(w)).where("nth > 1").select("topic", "value", F.col("f.source").alias("source"), F.col("f.key").alias("key"), "nth")


def corroboration(pos: DataFrame) -> DataFrame:
    return disputed(pos).select("topic", "value", "n_sources", (F.col("n_sources") >= 2).alias("corroborated"))


def supersession_pairs(sources: DataFrame, pos: DataFrame) -> DataFrame:
    """(older source, newer source) with the number of topics on which the newer one's value is the current one.

    Only decided topics count; a topic gives its winning position's newest source and each other position's newest
    source, so rows grow with positions, not with pairs of statements.
    """
    k = date_key(F.col("day"))
    latest = sources.where(k != "").groupBy("topic", "value").agg(F.max(F.struct(k.alias("key"), "source")).alias("s"))
    win = likely_current(pos).where("value is not null").select("topic", F.col("value").alias("winner"))
    j = latest.join(win, "topic")
    new = j.where("value = winner").select("topic", F.col("s.source").alias("newer"), F.col("s.key").alias("new_key"))
    old = j.where("value != winner").select("topic", F.col("s.source").alias("older"), F.col("s.key").alias("old_key"))
    p = old.join(new, "topic").where((F.col("old_key") < F.col("new_key")) & (F.col("older") != F.col("newer")))
    return p.groupBy("older", "newer").agg(F.count_distinct("topic").alias("n_topics")).withColumn("severity", F.when(F.col("n_topics") >= 3, "high").otherwise("medium"))


#: Statements that one task sorts at most when a board is drawn, a topic being kept together.
TASK_ROWS = 2_000_000


def board_edges(sources: DataFrame) -> DataFrame:
    """Edges of the case board: source states position, positions of a topic conflict (each with the next), with weights.

    One shuffle deals the statements by topic, over more tasks for larger inputs. A topic's statements are sorted by
    position (oldest first) and source; the last statement of a position sees the next position behind it.
    """
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sources.count() // TASK_ROWS))
    k = date_key(F.col("day"))
    s = sources.select("topic", "value", "source", F.when(k != "", k).alias("key")).repartition(tasks, "topic")
    s = s.withColumn("oldest", F.coalesce(F.min("key").over(Window.partitionBy("topic", "value")), F.lit("9999"))).drop("key")
    w = Window.partitionBy("topic")
    several = (F.min("value").over(w) != F.max("value").over(w)) | ((F.count("value").over(w) > 0) & (F.count("value").over(w) < F.count("*").over(w)))
    s = s.withColumn("several", several).where("several").drop("several").withColumn("no_value", F.col("value").isNull())
    order = ["oldest", "no_value", "value", "source"]
    s = s.withColumn("weight", F.count("*").over(Window.partitionBy("topic", *order))).withColumn("after", F.lead(F.struct("value", "source")).over(w.orderBy(*order)))
    # equal statements stand together: their last one speaks for all
    s = s.where("after is null or not (after.value <=> value and after.source <=> source)")
    node = lambda v: F.concat(F.col("topic").cast("string"), F.lit("="), F.col(v))
    states = F.when(F.col("topic").isNotNull() & ~F.col("no_value"), F.struct(F.col("source").cast("string").alias("a"), node("value").alias("b"), F.col("weight"), F.lit("states").alias("kind")))
    conflict = F.when(F.col("after.value").isNotNull() & ~F.col("after.value").eqNullSafe(F.col("value")), F.struct(node("value").alias("a"), node("after.value").alias("b"), F.lit(1).cast("long").alias("weight"), F.lit("conflicts").alias("kind")))
    return s.select(F.inline(F.array_compact(F.array(states, conflict))))


def board_around(sources: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The statements on all topics whose edges a walk of ``hops`` steps from documents (``seeds``: source) can meet.

    A walk leaves a topic only through a document, so two steps add the topics of the documents reached at most.
    """
    near, ids = sources.where("false"), seeds
    for _ in range((hops + 1) // 2):
        topics = sources.join(ids, "source", "left_semi").select("topic").distinct()
        near = graph.cut(sources.join(topics, "topic", "left_semi"))
        ids = near.select("source").distinct()
    return near


def compare(sources: DataFrame, left: str, right: str, side: str = "side") -> DataFrame:
    """Topics of two sides: ``state`` (changed, unchanged, only_left, only_right) and both values, by one shuffle.

    A side that states several values for a topic is represented by its newest (ties: the largest value).
    """
    s = sources.where(F.col(side).isin(left, right))
    pick = F.max(F.struct(F.coalesce(date_key(F.col("day")), F.lit("")).alias("k"), F.col("value").alias("v")))
    g = s.groupBy("topic", side).agg(pick.alias("x")).groupBy("topic").agg(
        F.max(F.when(F.col(side) == left, F.col("x.v"))).alias("left_value"), F.max(F.when(F.col(side) == right, F.col("x.v"))).alias("right_value"))
    state = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(F.col("left_value") == F.col("right_value"), "unchanged").otherwise("changed")
    return g.withColumn("state", state)


def value_conflicts(sources: DataFrame) -> DataFrame:
    """Per topic: statements, values and the number of conflicting pairs, counted without making the pairs."""
    v = sources.groupBy("topic", "value").agg(F.count("*").alias("n"))
    total, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return v.groupBy("topic").agg(total.alias("n_statements"), F.count("*").alias("n_values"), ((total * total - squares) / 2).cast("long").alias("n_conflicts"))


def values_equal(kind, a, b, unit_a, unit_b):
    """Whether two values of a kind agree within its tolerance (relative to the larger)."""
    near = lambda share: F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return (
        F.when(kind == "money", (unit_a == unit_b) & near(0.01))
        .when(kind == "duration", (unit_a == unit_b) & near(0.03))
        .when(kind == "percent", F.abs(a - b) <= 0.05)
        .otherwise(near(0.005))
    )
