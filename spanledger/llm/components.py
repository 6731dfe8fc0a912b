"""Connected components by repeated contraction, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import attach


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``edges``: long columns ``a`` and ``b``. Returns ``id`` and ``component`` (the smallest id) of every node.

    Each round every node adopts its smallest neighbour, chains of adoptions are halved until they end in roots,
    and the edges are rewritten between roots; nodes that keep an edge at least halve per round. The maps of the
    rounds are then composed from the last to the first. Nulls and loops are dropped; an empty input gives no rows.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = e.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    e = scratch.write(e, f"{tag}-e0")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # node -> smallest of itself and its neighbours
        p = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("up"))
        p = scratch.write(p, f"{tag}-p{k}-0")
        for j in range(40):
            n = p.where(F.col("id") != F.col("up")).count()
            sizes = p.groupBy("up").agg(F.count("*").alias("__n"))
            step = p.select(F.col("id").alias("up"), F.col("up").alias("top")).join(sizes, "up").select("up", "top", "__n")
            q = attach(p, "up", step, "top", n, "__n").select("id", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved"))
            q = scratch.write(q, f"{tag}-p{k}-{j + 1}")
            moved = not q.where("moved").isEmpty()
            p = q.select("id", "up")
            if not moved:
                break
        maps.append(p)
        pa, pb = p.select(F.col("id").alias("a"), F.col("up").alias("ra")), p.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        e = e.join(pa, "a").join(pb, "b").where("ra != rb")
        e = scratch.write(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{tag}-e{k + 1}")
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[-1]
    for p in reversed(maps[:-1]):
        n = p.count()
        sizes = p.groupBy("up").agg(F.count("*").alias("__n"))
        step = out.select(F.col("id").alias("up"), F.col("up").alias("top")).join(sizes, "up").select("up", "top", "__n")
        out = attach(p, "up", step, "top", n, "__n").select("id", F.coalesce("top", "up").alias("up"))
    return out.select("id", F.col("up").alias("component"))
