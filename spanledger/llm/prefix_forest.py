"""Nearest neighbours by a forest of hash-prefix trees.

Every tree gives each vector a long hash string: symbols of cross-polytope hashes (pseudo-random rotations), packed
into one long so that strings sort as numbers and every prefix is a range. A query descends in all trees to its
longest prefixes and the trees ascend together, one symbol at a time, until the other rows under the prefixes reach
the budget; a row under the prefixes of several trees counts once, by the expected overlap of prefixes of these sizes.
Within the last symbol the trees ascend in the order of the query's projections on the axes of its prefix
(nearest first), so trees end at prefixes of different lengths and some are not used at all. All rows under the chosen
prefixes are compared by their cosine in double precision: no candidate is cut off. A prefix with many rows is cut
into blocks, each block is compared with all its queries as matrices, and only the best few of a block leave it.
Equal vectors are one node, with the smallest ids of its members.

The budget of a query is FACTOR * n ** EXPONENT rows of n: it grows slower than the table. It is laid out for unrelated
vectors, where neighbours are hardest to tell from others (recall by size: see the README); related ones need less.
The last step of an ascent is the empty prefix, which holds all rows: it is taken where all prefixes of one symbol hold
fewer rows than the budget (unrelated vectors: tables below about 4,000 rows). ``to_root=False`` leaves that step out
and compares what the prefixes of one symbol hold; ``budget=math.inf`` compares every query with every row (exact).

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null id; ties go to the smaller id; a query's own row is no candidate, other rows with its id
are none either (they are the same query); fewer candidates than asked are all returned; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import stretches
from .scratch import Scratch
from .vectors import common_length, pack, rotate, unit, unpack, width

TREES = 48
DEPTH = 3
FACTOR, EXPONENT = 1.1, 0.85
SEED = 11
POINTS = 4096
QUERIES = 512


def symbol_bits(length: int) -> int:
    return (2 * width(length) - 1).bit_length()


def hash_strings(x: np.ndarray, trees: int, depth: int, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x trees: the string of ``depth`` symbols as a long; rows x trees x depth: the sums of the projections so far."""
    out, near = np.zeros((len(x), trees), np.int64), np.zeros((len(x), trees, depth))
    for t in range(trees):
        for d in range(depth):
            y = rotate(x, seed, t * depth + d)
            axis = np.abs(y).argmax(axis=1)
            top = y[np.arange(len(x)), axis]
            out[:, t] = (out[:, t] << bits) | (axis * 2 + (top < 0))
            near[:, t, d] = np.abs(top)
    return out, near.cumsum(axis=2)


def row_budget(n: int) -> int:
    return math.ceil(FACTOR * n**EXPONENT)


def _prefix(code, level: int, depth: int, bits: int):
    return F.shiftright(code, bits * (depth - level))


def _cosines(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (q * p).sum(axis=1)


def search(rows: DataFrame, scratch: Scratch, is_query, k: int = 5, id_col="vec_id", vec_col="embedding", trees: int = TREES, depth: int = DEPTH, budget: float | None = None, seed: int = SEED, to_root: bool = True) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of every row where ``is_query`` holds."""
    length = common_length(rows, vec_col)
    bits = symbol_bits(max(length, 1))
    packed = pack(rows, id_col, vec_col, length).where("vec is not null and id is not null")
    packed = scratch.write(packed, "packed")
    # k + 1 members with the smallest ids of every distinct vector (row_number's limit applies before the shuffle)
    few = packed.withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= k + 1)
    nodes = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    nodes = scratch.write(nodes, "nodes")
    queries = packed.where(is_query(F.col("id"))).groupBy("id", "vec").agg(F.count("*").alias("copies")).select(F.col("id").alias("query_id"), "vec")
    queries = scratch.write(queries, "queries")
    n_nodes = nodes.count()
    wanted = row_budget(n_nodes) if budget is None else budget

    def strings(name: str, asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 1024):
                    p = b.slice(s, 1024)
                    code, near = hash_strings(unit(unpack(p.column(1), length)), trees, depth, seed, bits)
                    row = pa.array(np.repeat(np.arange(p.num_rows), trees))
                    columns = [pa.array(np.tile(np.arange(trees, dtype=np.int32), p.num_rows)), pa.array(code.ravel()), p.column(0).take(row)]
                    if asks:
                        columns.append(pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), depth).cast(pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "code", name, "near"][: len(columns)])

        return run

    points = scratch.write(nodes.select("id", "vec").mapInArrow(strings("id", False), "tree int, code long, id long"), "points")
    asked = scratch.write(queries.mapInArrow(strings("query_id", True), "tree int, code long, query_id long, near array<double>"), "asked")
    # rows under every prefix, from the full strings up
    levels = [points.groupBy("tree", F.col("code").alias("prefix")).agg(F.count("*").alias("n")).withColumn("level", F.lit(depth))]
    for level in range(depth - 1, 0, -1):
        levels.append(levels[-1].groupBy("tree", F.shiftright("prefix", bits).alias("prefix")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(level)))
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.unionByName(x)
    tree = scratch.write(tree, "tree")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), _prefix(F.col("code"), v, depth, bits).alias("prefix"), F.col("near")[v - 1].alias("near")) for v in range(1, depth + 1)]))
    paths = asked.select("query_id", "tree", each.alias("x")).select("query_id", "tree", "x.*").join(tree, ["tree", "level", "prefix"])
    # the query's own node is under all its prefixes and is no candidate; of the others a prefix holds this share
    others = max(1, n_nodes - 1)
    paths = paths.withColumn("lack", F.log(F.greatest(F.lit(1e-12), 1 - (F.col("n") - 1) / others)))
    # with shares s of the prefixes, 1 - product(1 - s) of the others are under some; a step up replaces one factor
    up = Window.partitionBy("query_id", "tree").orderBy(F.desc("level"))
    paths = paths.withColumn("step", F.col("lack") - F.coalesce(F.lag("lack").over(up), F.lit(0.0)))
    climb = Window.partitionBy("query_id").orderBy(F.desc("level"), F.desc("near"), "tree")  # trees x depth rows
    reached = lambda total: others * (1 - F.exp(total))
    paths = paths.withColumn("before", reached(F.sum("step").over(climb.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("step")))
    paths = paths.withColumn("all", reached(F.sum("step").over(Window.partitionBy("query_id"))))
    enough = (F.col("all") >= wanted) if to_root or math.isinf(wanted) else F.lit(True)
    used = paths.where((F.col("before") < wanted) & enough).groupBy("query_id", "tree").agg(F.min("level").alias("level"))
    chosen = scratch.write(queries.select("query_id").join(used, "query_id", "left").select("query_id", F.coalesce("tree", F.lit(0)).alias("tree"), F.coalesce("level", F.lit(0)).alias("level")), "chosen")
    # level 0 is one prefix of one tree
    node_key = lambda level, t, prefix: F.when(level == 0, F.xxhash64(F.lit(0), F.lit(0), F.lit(0).cast("long"))).otherwise(F.xxhash64(level, t, prefix))
    at = F.when(F.col("level") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright(code, {bits} * ({depth} - level))"))
    goal = asked.join(chosen, ["query_id", "tree"]).select("query_id", node_key(F.col("level"), F.col("tree"), at).alias("key"))
    seen = [r["level"] for r in chosen.select("level").distinct().collect()]  # at most depth + 1 values
    nowhere = F.xxhash64(F.lit(0), F.lit(0), F.lit(0).cast("long"))
    every = F.explode(F.array(*[node_key(F.lit(v), F.col("tree"), _prefix(F.col("code"), v, depth, bits) if v else F.lit(0).cast("long")) for v in seen])) if seen else F.explode(F.array().cast("array<bigint>"))
    under = points.where("tree = 0" if seen == [0] else "true").select("id", "tree", every.alias("key")).where((F.col("tree") == 0) | (F.col("key") != nowhere))
    nq = goal.groupBy("key").agg(F.count("*").alias("nq"))
    sizes = under.groupBy("key").agg(F.count("*").alias("np")).join(nq, "key").select("key", F.ceil(F.col("np") / POINTS).cast("int").alias("pb"), F.ceil(F.col("nq") / QUERIES).cast("int").alias("qb"))
    sizes = scratch.write(sizes, "sizes")
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.col(n)).cast("int")
    p_side = under.join(sizes, "key").select("key", part("id", "pb").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("hi"), "id", F.lit(False).alias("asks"))
    q_side = goal.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("lo"), part("query_id", "qb").alias("hi"), F.col("query_id").alias("id"), F.lit(True).alias("asks"))
    p_side = p_side.join(nodes.select("id", "vec"), "id")
    q_side = q_side.join(queries.select(F.col("query_id").alias("id"), "vec"), "id")
    units = p_side.unionByName(q_side).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in stretches(batches, ["key", "lo", "hi"]):
            x = unit(unpack(t.column("vec"), length))
            ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(starts, np.r_[starts[1:], len(t)]):
                rows = np.arange(a, b)
                q, p = rows[asks[a:b]], rows[~asks[a:b]]
                if not len(q) or not len(p):
                    continue
                p = p[np.argsort(ids[p])]
                s = x[q] @ x[p].T
                if len(p) > k + 1:
                    kth = -np.partition(-s, k, axis=1)[:, k]
                    qi, pi = np.nonzero(s >= (kth - 1e-12)[:, None])
                else:
                    qi, pi = (g.ravel() for g in np.indices(s.shape))
                score = _cosines(x[q[qi]], x[p[pi]])
                order = np.lexsort((ids[p[pi]], -score, qi))
                qi, pi, score = qi[order], pi[order], score[order]
                first = np.r_[True, qi[1:] != qi[:-1]]
                rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
                keep = rank <= k
                for lst, v in zip(out, (ids[q[qi[keep]]], ids[p[pi[keep]]], score[keep])):
                    lst.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "id", "score"])

    found = units.mapInArrow(compare, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    members = found.join(nodes.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id != vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every embedding whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, Scratch(spark, "forest"), lambda c: c % 50 == 0)
