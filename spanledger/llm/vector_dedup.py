"""Near-duplicate vectors by cross-polytope hashing.

A hash function rotates the vector (random signs and fast Hadamard transforms) and takes the nearest signed axis; a
table concatenates a few functions. Every vector enters its own bucket of each table and the next likely ones
(multiprobe: the combinations of second and third axes that lose least). Pairs that share a bucket are verified by
their cosine in double precision, in blocks, so no bucket is held by one task and no pair is emitted: a work unit
returns a spanning forest and link counts. A pair that meets in several buckets is counted in the first it shares.
Equal vectors are one node with a multiplicity.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components link with
nothing and are kept; rows with a null id are nobody's link and have no component; repeated rows count as other
vectors; an empty table gives no rows; labels and other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LINK_SCHEMA, forest, link_batch, stretches, unit_pairs, work_units
from .components import connected_components
from .scratch import Scratch
from .skew import attach
from .vectors import common_length, pack, rotate, unit, unpack

COSINE = 0.95
TABLES = 10
PROBES = 4
SEED = 7
BLOCK = 512


def functions_per_table(n: int, length: int) -> int:
    """Axes per table, so that unrelated vectors share a bucket of a few: grows with the logarithm of the rows."""
    return max(1, min(4, math.ceil(math.log(max(n, 2)) / math.log(2 * max(length, 2)) - 0.5)))


def bucket_keys(x: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Keys of every row's buckets: rows x tables x probes (own bucket first); each holds its table's number.

    There are no more probes than choices: 3 ** k with k functions.
    """
    n = len(x)
    deals = sorted(itertools.product(range(min(3, x.shape[1])), repeat=k), key=lambda c: (sum(c), c))
    probes = min(probes, len(deals))
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        axes, loss = [], []
        for f in range(k):
            y = rotate(x, seed, t * k + f)
            a = np.abs(y)
            top = np.argpartition(-a, min(2, a.shape[1] - 1), axis=1)[:, :3]  # the rotated width is 2 at least
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(a, top, 1), axis=1, kind="stable"), 1)
            v = np.take_along_axis(y, order, 1)
            axes.append(order * 2 + (v < 0))
            loss.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
        cost = np.stack([sum(loss[f][:, c[f]] for f in range(k)) for c in deals], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code = np.stack([sum(axes[f][:, c[f]].astype(np.int64) << (13 * f) for f in range(k)) for c in deals], axis=1)
        got = np.take_along_axis(code, best, 1)
        out[:, t] = got * tables + t
    return out


def _first_shared(ka: np.ndarray, kb: np.ndarray) -> np.ndarray:
    """For rows of keys (pairs x tables x probes): the smallest key that both have, of the first table they share."""
    found = np.full(len(ka), np.iinfo(np.int64).max)
    todo = np.arange(len(ka))
    for t in range(ka.shape[1]):
        a, b = ka[todo, t], kb[todo, t]
        both = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)
        found[todo] = both
        todo = todo[both == np.iinfo(np.int64).max]
    return found


def near_duplicates(rows: DataFrame, scratch: Scratch, id_col="vec_id", vec_col="embedding", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``id``, ``n_links``, ``component`` of every row."""
    length = common_length(rows, vec_col)
    packed = scratch.write(pack(rows, id_col, vec_col, length), "packed")
    nodes = packed.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("id").alias("members"), F.count("*").alias("rows"))
    nodes = scratch.write(nodes, "nodes")
    k = functions_per_table(nodes.count(), length)
    keyed = lambda x: bucket_keys(unit(x), k, tables, probes, seed)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                p = b.slice(s, 2048)
                keys = keyed(unpack(p.column(0), length)).reshape(p.num_rows, -1)
                row = pa.array(np.repeat(np.arange(p.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(p.column(c).take(row) for c in (1, 2, 0))], names=["key", "id", "members", "vec"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in stretches(batches, ["key", "lo", "hi"]):
            x = unit(unpack(t.column("vec"), length))
            key, ids, members, mine, lo, hi = (t.column(c).to_numpy() for c in ("key", "id", "members", "mine", "lo", "hi"))
            i, j = unit_pairs(starts, len(t), mine, lo, hi, lambda a, b: x[a] @ x[b].T >= cosine, lambda a, b: np.einsum("ij,ij->i", x[a], x[b]) >= cosine)
            if not len(i):
                continue
            rows_of = np.unique(np.r_[i, j])
            place = np.zeros(len(t), np.int64)
            place[rows_of] = np.arange(len(rows_of))
            keys = keyed(unpack(t.column("vec").take(pa.array(rows_of)), length))
            count = np.zeros(len(t), np.int64)
            first = np.zeros(len(i), bool)
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                first[s : s + (1 << 16)] = _first_shared(keys[place[a]], keys[place[b]]) == key[a]
            np.add.at(count, i[first], members[j[first]])
            np.add.at(count, j[first], members[i[first]])
            a, b = forest(len(t), i, j, ids)
            has = np.flatnonzero(count)
            yield link_batch(np.r_[a, ids[has]], np.r_[b, ids[has]], np.r_[np.zeros(len(a), np.int64), count[has]])

    entries = nodes.where("id is not null").select("vec", "id", "members").mapInArrow(enter, "key long, id long, members long, vec binary")
    entries = scratch.write(entries, "entries")
    found = scratch.write(work_units(entries, block, scratch).mapInArrow(verify, LINK_SCHEMA), "found")
    scratch.drop("entries")
    links = found.where("a = b").groupBy(F.col("a").alias("__lid")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("a != b").select("a", "b"), scratch).select(F.col("id").alias("__cid"), "component")
    named = nodes.join(links, F.col("id") == F.col("__lid"), "left").join(comp, F.col("id") == F.col("__cid"), "left")
    named = named.select("vec", "rows", F.struct(F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links")).alias("found"))
    out = attach(packed, "vec", scratch.write(named, "named"), "found", packed.count(), "rows")
    own = F.col("id").isNotNull()
    return out.select("id", F.when(own, F.coalesce("found.links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(own, F.coalesce("found.component", "id")).alias("component"))


def op7_vector_components(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "vectors"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
