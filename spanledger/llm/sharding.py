"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of the md5 of id, CRC and size of the text: a rank that depends on the rows
alone, not on files or partitions, and that spreads null or repeated ids with different texts over all ranges. A balanced Feistel network over the smallest even number of bits that covers N permutes the numbers;
results of N or more walk the cycle until they fall below N, so the map is a bijection of 0..N-1. Position p goes to
shard p mod S and slot p div S: shard sizes differ by one at most, slots have no gaps, and a row's place can be
computed from its number alone (and inverted, see :func:`unpermute`).

Edge cases: null ids are numbered like any other value (as the empty text); equal rows take neighbouring numbers and
are interchangeable; null texts have size 1 and CRC 0; an empty table gives no rows; other columns are kept, but
columns named like the added ones (``shard``, ``slot``, ``row_number``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
#: Numbering is done in this many md5 ranges: the only table on the driver has one count per range.
RANGE_DIGITS = 3


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser of the public SplitMix64 generator."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def half_bits(n: int) -> int:
    """Bits of one half: 2 ** (2 * half_bits) >= n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, order) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for r in order:
        left, right = right, left ^ (_mix(right, seed * 131 + r) & mask)
    return (right << h) | left  # halves swapped at the end, so the reverse order of rounds inverts it


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0..n-1 applied to ``numbers``."""
    return _walk(numbers, n, seed, range(ROUNDS))


def unpermute(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of :func:`permute`."""
    return _walk(positions, n, seed, range(ROUNDS - 1, -1, -1))


def _walk(values, n: int, seed: int, order) -> np.ndarray:
    x, half = np.asarray(values, dtype=np.uint64).copy(), half_bits(n)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], half, seed, order)
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def number_rows(rows: DataFrame, id_col: str, tie_cols: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """Adds the global row number; returns the table and N. One shuffle, over md5 ranges; no total sort."""
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, *tie_cols)])
    key = F.md5(told.cast("binary"))
    cell = lambda k: F.conv(F.substring(k, 1, RANGE_DIGITS), 16, 10).cast("int")
    counts = dict(rows.groupBy(cell(key).alias("c")).count().collect())  # at most 16 ** RANGE_DIGITS rows
    starts, at = [], 0
    for c in range(16**RANGE_DIGITS):
        starts.append(at)
        at += counts.get(c, 0)
    start = F.element_at(F.lit(np.array(starts, dtype=np.int64)), F.col("__c") + 1)
    w = Window.partitionBy("__c").orderBy("__k", F.col(id_col), *tie_cols)
    out = rows.drop(number).withColumn("__k", key).withColumn("__c", cell(F.col("__k")))
    return out.withColumn(number, start + F.row_number().over(w) - 1).drop("__k", "__c"), at


def shard(rows: DataFrame, id_col: str, tie_cols: list[str], shards: int, seed: int) -> DataFrame:
    """Adds ``shard``, ``slot`` and ``row_number``; the law of row counts (at most one apart) holds."""
    numbered, n = number_rows(rows, id_col, tie_cols)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    p = F.col("__p")
    out = numbered.drop("shard", "slot").withColumn("__p", place("row_number"))
    return out.withColumn("shard", F.pmod(p, F.lit(shards)).cast("int")).withColumn("slot", F.floor(p / shards).cast("long")).drop("__p")


SHARDS = 16
SEED = 20240501


def op2_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of row counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, "doc_id", ["text_crc32", "size"], SHARDS, SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
