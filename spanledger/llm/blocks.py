"""All pairs inside buckets, in blocks: nothing is emitted per pair, and no bucket is held by one task.

A bucket of more than ``block`` rows is cut into blocks by a hash of the row, and every pair of blocks becomes a work
unit of its own; units are dealt over all partitions and processed in sorted order, one stretch of units at a time. A
kernel gets the rows of whole units with the index pairs to test, and returns those that pass. What leaves a unit is a
spanning forest of the links (as many rows as the unit at most) and, if asked for, a link count per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import HEAVY_SHARE

#: Units up to this size are paired together, by distance in the sorted stretch; larger ones by matrix tiles.
SMALL = 48
STRETCH = 1 << 15

LINK_SCHEMA = "a long, b long, links long"


def work_units(entries: DataFrame, block: int, scratch: Scratch, total: int | None = None) -> DataFrame:
    """``entries``: ``key`` long, ``id`` long and payload columns. Adds ``lo``, ``hi`` (blocks) and ``mine``.

    Rows alone under their key have no pair and go. Keys of at least ``total / HEAVY_SHARE`` of the ``total`` rows, at
    most HEAVY_SHARE of them, are named in a filter and get their size by broadcast; no other key holds more than that
    share of the shuffle of the rest.
    """
    sizes = scratch.write(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "unit-sizes")
    least = max(2.0, (entries.count() if total is None else total) / HEAVY_SHARE)
    large = [r["key"] for r in sizes.where(F.col("size") >= least).select("key").collect()]
    is_large = F.col("key").isin(large)
    sized = entries.where(~is_large).join(sizes.where(~is_large), "key") if large else entries.join(sizes, "key")
    if large:
        sized = sized.unionByName(entries.where(is_large).join(F.broadcast(sizes.where(is_large)), "key"))
    return spread(sized, block)


def spread(sized: DataFrame, block: int) -> DataFrame:
    n = F.ceil(F.col("size") / block).cast("int")
    e = sized.withColumn("__n", n).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(17)), F.col("__n")).cast("int"))
    e = e.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    e = e.withColumn("lo", F.least("mine", "__o")).withColumn("hi", F.greatest("mine", "__o")).drop("__n", "__o", "__size", "size")
    return e.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def forest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (i, j) between n rows connect: each component's ids as a binary heap."""
    nodes = np.unique(np.concatenate([i, j]))
    lab = np.arange(n)
    while True:
        before = lab[nodes]
        np.minimum.at(lab, i, lab[j])
        np.minimum.at(lab, j, lab[i])
        lab[nodes] = lab[lab[nodes]]
        if (lab[nodes] == before).all():
            break
    pairs = np.unique(np.stack([lab[nodes], ids[nodes]], axis=1), axis=0)
    first = np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(pairs)), 0))
    rank = np.arange(len(pairs)) - start
    child = rank > 0
    return pairs[start + (rank - 1) // 2, 1][child], pairs[:, 1][child]


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = STRETCH) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole units from sorted batches, with the start of each unit; cut from ``least`` rows on."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table, last: bool):
        cols = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        end = len(table) if last else int(starts[-1])
        return (table.slice(0, end), starts[starts < end]) if end else None, table.slice(end)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            done, rest = cut(pa.Table.from_batches(held), False)
            if done:
                yield done
            held = rest.combine_chunks().to_batches()
            rows = len(rest)
    if rows:
        yield cut(pa.Table.from_batches(held), True)[0]


def unit_pairs(starts: np.ndarray, n: int, mine: np.ndarray, lo: np.ndarray, hi: np.ndarray, tile: Callable, pairs: Callable, prune: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of a stretch. ``pairs(i, j)`` and ``tile(rows, cols)`` return masks.

    With ``prune`` a tile leaves pairs that connect what its links connect, fewer than it has rows and columns, so that
    memory does not grow with the links of a dense stretch.
    """
    ends = np.r_[starts[1:], n]
    sizes = ends - starts
    out_i, out_j = [], []
    small = sizes <= SMALL
    if small.any():
        unit = np.repeat(np.arange(len(starts)), sizes)
        ok = np.repeat(small, sizes)
        for d in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero(ok[:-d] & (unit[:-d] == unit[d:]))
            i = i[(lo[i] == hi[i]) | (mine[i] != mine[i + d])]
            if len(i):
                m = pairs(i, i + d)
                out_i.append(i[m])
                out_j.append(i[m] + d)
    for u in np.flatnonzero(~small):
        rows = np.arange(starts[u], ends[u])
        if lo[rows[0]] == hi[rows[0]]:
            a = b = rows
        else:
            a, b = rows[mine[rows] == lo[rows]], rows[mine[rows] == hi[rows]]
        for k in range(0, len(a), 512):
            x, y = np.nonzero(tile(a[k : k + 512], b))
            i, j = a[k + x], b[y]
            if a is b:
                i, j = i[i < j], j[i < j]
            if prune and len(i):
                i, j = forest(n, i, j, np.arange(n))
            out_i.append(i)
            out_j.append(j)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def link_batch(a, b, links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])
