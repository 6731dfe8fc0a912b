"""Embedding rows as packed vectors, and pseudo-random rotations by fast Hadamard transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(rows: DataFrame, vec_col: str) -> int:
    """The most frequent vector length; others take no part."""
    got = rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(got["d"]) if got else 0


def pack(rows: DataFrame, id_col: str, vec_col: str, length: int) -> DataFrame:
    """``id`` and ``vec``: the components as bytes (of the column's own width, so nothing is rounded), or null where the
    vector is null, zero, of another length, or holds null or non-finite components."""
    kind = "<f4" if rows.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                x = None
                if v.is_valid and len(v) == length and length and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, "id long, vec binary")


def unpack(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * length * len(column) else "<f8").astype("<f8").reshape(-1, length)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component is divided out first, so no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def width(length: int) -> int:
    return max(2, 1 << (length - 1).bit_length())


def rotate(x: np.ndarray, seed: int, which: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform, on zero-padded rows."""
    d = width(x.shape[1])
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, which]).integers(0, 2, (3, d)) * 2.0 - 1.0
    for s in signs:
        y = hadamard(y * s)
    return y
