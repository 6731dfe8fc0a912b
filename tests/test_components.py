"""Components of a graph that needs many rounds, within a time limit."""

import random
import time

from spanledger.operators import graph


def test_long_chains_end_in_time(spark):
    rng = random.Random(8)
    ids = list(range(4000))
    rng.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:]) if rng.random() < 0.999] + [(a, a) for a in ids[:5]] + [(None, 3)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    began = time.time()
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert time.time() - began < 150
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}
