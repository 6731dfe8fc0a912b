"""Edges of the board by one shuffle, in tasks that do not grow with the input; walks that read only the topics they meet."""

import random
from collections import Counter

from pyspark.sql import functions as F

from spanledger.operators import graph, positions as P

SCHEMA = "topic long, value string, source long, day string, formal boolean, amends boolean"


def statements(n, seed):
    rnd = random.Random(seed)
    days = [None, "", "1997", "1997-06", "1997-01-02", "1998-03-04"]
    return [(rnd.choice([None, *range(n // 4)]), rnd.choice([None, "1%", "2%", "3%", "10%"]), rnd.choice([None, *range(n // 6)]), rnd.choice(days), True, False) for _ in range(n)]


def plain_edges(rows):
    """The same from dictionaries, as the SQL has it: nodes with a null are null, null values come last."""
    key = lambda d: None if not d else d + "-01-01"[len(d) - 4 :] if len(d) < 10 else d
    oldest, out = {}, []
    for t, v, _, d, *_ in rows:
        held = oldest.get((t, v))
        oldest[t, v] = min(filter(None, [held, key(d)]), default=None)
    node = lambda t, v: None if t is None or v is None else f"{t}={v}"
    of = {}
    for (t, v), o in oldest.items():
        of.setdefault(t, []).append((o or "9999", v is None, v or "", v))
    for t, ps in of.items():
        vs = [p[-1] for p in sorted(ps, key=lambda p: p[:3])]
        out += [(node(t, a), node(t, b), 1, "conflicts") for a, b in zip(vs, vs[1:]) if b is not None]
    many = Counter((s, t, v) for t, v, s, *_ in rows if t is not None and v is not None and len(of[t]) > 1)
    return out + [(None if s is None else str(s), node(t, v), n, "states") for (s, t, v), n in many.items()]


def test_edges_are_those_of_plain_python(spark):
    for n, seed in ((40, 1), (400, 2)):
        rows = statements(n, seed)
        got = P.board_edges(spark.createDataFrame(rows, SCHEMA)).select("a", "b", "weight", "kind").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain_edges(rows), key=repr)


def test_tasks_do_not_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 50)
    edges = P.board_edges(spark.createDataFrame(statements(1000, 3), SCHEMA))
    assert edges.rdd.getNumPartitions() == 20
    plan = edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_walks_meet_all_edges_around_their_seeds(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 60), f"{rnd.randint(1, 4)}%", rnd.randint(0, 80), "1997-01-02", True, False) for _ in range(160)]
    s = spark.createDataFrame(rows, SCHEMA)
    seeds = spark.createDataFrame([(3,), (7,), (999,)], "source long")
    ids = seeds.select(F.col("source").cast("string").alias("id"))
    for hops in (1, 2, 3, 4):
        near = P.board_around(s, seeds, hops)
        every, some = [graph.neighbourhood(P.board_edges(x), ids, hops).select("id", "hops").collect() for x in (s, near)]
        assert sorted(map(tuple, every)) == sorted(map(tuple, some)) and len(some) > 3
        if hops <= 2:
            assert near.count() < s.count() / 2


def test_steps_of_a_walk_share_the_edges(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(None, 3)], "a int, b int")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    got = graph.neighbourhood(edges.mapInPandas(count, edges.schema), spark.createDataFrame([(10,)], "id int"), 3)
    assert sorted(r["id"] for r in got.collect()) == list(range(7, 14)) and seen.value == 31
