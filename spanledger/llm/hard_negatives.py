"""Hard negatives by bit-sliced integer products.

Components are scaled to integers. A block of candidates is cut into bit-planes (two's complement); an anchor's product
with a plane is the sum of its components where the plane has a one. Planes are processed from the most significant
one: what the planes below k can still add lies between (2^k - 1) times the sum of the anchor's negative components and
the same of its positive ones, so every score has an interval that narrows with each plane. A candidate is dropped as
soon as its interval cannot qualify: for positives, when it ends below the lower ends of enough others; for negatives,
when it misses the bands of all positives of the anchor, or ends below the lower ends of enough candidates that are
surely inside the lowest band. Columns of the block without a living pair go; when few pairs live, the rest of the
planes is processed for these pairs alone. After the last plane an interval is a point, the exact product.

Rows and anchors meet in blocks of bounded size, each pair of blocks a work unit of its own (positives only inside a
label, of which a heavy one has many blocks), and only the best few of an anchor leave a unit.

Edge cases: rows with a null id, label or vector, with null or non-finite components or of another length than most
take no part; a row never is its own anchor's positive or negative, nor are other rows with its id; repeated rows are
candidates of their own and one anchor; ties go to the smaller id; fewer candidates than asked are all returned; an
anchor without positives or in whose band nothing lies has no rows; zero vectors take part with the score 0; scaled
components beyond 2^62 count as 2^62, and scores are exact while they fit in 63 bits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import stretches
from .scratch import Scratch
from .skew import attach
from .vectors import common_length

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Negatives score between these hundredths of the positive's score.
BAND = (30, 90)
ROWS = ANCHORS = 4096
TILE = 256
#: Share of living pairs below which pairs are processed one by one.
FEW = 0.08


def scaled(rows: DataFrame, id_col: str, vec_col: str, label: Column, length: int) -> DataFrame:
    """``id``, ``label`` and ``vec``: the scaled components as bytes, of the narrowest width that holds them all."""
    longs = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * SCALE))
    most = rows.select(F.max(F.array_max(F.transform(longs, F.abs))).alias("m")).first()["m"] if length else None
    kind = "<i2" if (most or 0) < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(2):
                x = None
                if v.is_valid and len(v) == length and length and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    x = np.clip(np.floor(SCALE * x), -(2.0**62), 2.0**62).astype(kind).tobytes() if np.isfinite(x).all() else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    narrow = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec")).where("id is not null and label is not null")
    return narrow.mapInArrow(run, "id long, label long, vec binary").where("vec is not null")


def integers(column: pa.ChunkedArray, length: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, f"<i{len(raw) // (length * len(column))}").astype(np.int64).reshape(-1, length)


@dataclass
class Intervals:
    """The living pairs (``i``: anchor, ``j``: candidate) with their exact products."""

    i: np.ndarray
    j: np.ndarray
    score: np.ndarray


def plane_bits(x: np.ndarray) -> int:
    """Bits of a two's complement number that holds every component."""
    return max(int(x.max(initial=0)).bit_length(), int(-x.min(initial=0) - 1).bit_length() if x.min(initial=0) < 0 else 0) + 1


def sliced(q: np.ndarray, x: np.ndarray, alive: np.ndarray, limits, few: float = FEW) -> Intervals:
    """Exact products of the pairs that ``limits`` cannot rule out.

    ``alive`` (anchors x candidates) marks the pairs to test. ``limits(lo, hi, alive)`` gets the ends of all intervals
    and returns for each anchor the least upper end and the greatest lower end with which a pair may still qualify.
    """
    bits = plane_bits(x)
    most = int(np.abs(q).sum(axis=1).max(initial=0)) << bits
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    below, above = (f(q, 0).sum(axis=1).astype(kind)[:, None] for f in (np.minimum, np.maximum))
    qk = q.astype(kind)
    columns = np.arange(len(x))
    s = np.zeros(alive.shape, kind)
    weight = lambda k: kind(-(2**k) if k == bits - 1 else 2**k)
    k = bits - 1
    while k >= 0:
        s += weight(k) * (qk @ ((x[columns] >> k) & 1).astype(kind).T)
        left = kind(2**k - 1)
        lo, hi = s + left * below, s + left * above
        if most >= 1 << 62 and k:  # the ends of intervals may overflow: only exact products are compared
            k -= 1
            continue
        least, greatest = limits(np.where(alive, lo, -np.inf if kind is not np.int64 else np.iinfo(np.int64).min), hi, alive)
        alive &= (hi >= least[:, None]) & (lo <= greatest[:, None])
        k -= 1
        if alive.mean() < few:
            break
        used = alive.any(axis=0)
        if not used.all():
            columns, s, alive = columns[used], s[:, used], alive[:, used]
    i, c = np.nonzero(alive)
    j, t = columns[c], s[i, c]
    for k in range(k, -1, -1):
        for at in range(0, len(i), 1 << 15):
            e = slice(at, at + (1 << 15))
            t[e] += weight(k) * (qk[i[e]] * ((x[j[e]] >> k) & 1).astype(kind)).sum(axis=1)
        left = kind(2**k - 1)
        keep = (t + left * above[i, 0] >= least[i]) & (t + left * below[i, 0] <= greatest[i])
        i, j, t = i[keep], j[keep], t[keep]
    return Intervals(i, j, t.astype(np.int64))


def _kth(values: np.ndarray, k: int, otherwise):
    """The k-th largest value of each row."""
    if values.shape[1] < k:
        return np.full(len(values), otherwise, values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _ends(kind) -> tuple:
    return (-np.inf, np.inf) if kind.kind == "f" else (np.iinfo(np.int64).min, np.iinfo(np.int64).max)


def best_limits(k: int):
    """A pair may be among the ``k`` best while its upper end reaches the k-th largest lower end."""

    def limits(lo, hi, alive):
        low, high = _ends(lo.dtype)
        return _kth(lo, k, low), np.full(len(lo), high, lo.dtype)

    return limits


def band_limits(least: np.ndarray, first_end: np.ndarray, greatest: np.ndarray, k: int):
    """A pair may be among the ``k`` best of a band while its interval meets [least, greatest] and its upper end
    reaches the k-th largest lower end of those surely in the lowest band [least, first_end].

    Those k are candidates of every higher band that begins below their lower ends, and a band that begins above them
    asks for more than this threshold does, so one threshold serves all bands of an anchor.
    """

    def limits(lo, hi, alive):
        low, _ = _ends(lo.dtype)
        a, e, g = (v.astype(lo.dtype) for v in (least, first_end, greatest))
        sure = alive & (lo >= a[:, None]) & (hi <= e[:, None])
        if not (sure.sum(axis=1) >= k).any():
            return a, g
        return np.maximum(a, _kth(np.where(sure, lo, low), k, low)), g

    return limits


def leading(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best pairs of every ``i``: highest score, then smallest id."""
    order = np.lexsort((ids, -score, i))
    g = i[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order[rank < k]


def _units(rows: DataFrame, anchors: DataFrame, scratch: Scratch, by_label: bool) -> DataFrame:
    """Rows and anchors as work units (``key``, ``lo``: block of rows, ``hi``: block of anchors), sorted."""
    key = F.col("label") if by_label else F.lit(0).cast("long")
    r, a = rows.withColumn("key", key), anchors.withColumn("key", key)
    size = r.groupBy("key").agg(F.count("*").alias("rows")).join(a.groupBy("key").agg(F.count("*").alias("asks")), "key")
    size = size.select("key", F.struct(F.ceil(F.col("rows") / ROWS).cast("int").alias("rb"), F.ceil(F.col("asks") / ANCHORS).cast("int").alias("ab")).alias("blocks"), "rows", "asks")
    size = scratch.write(size, f"sizes-{by_label}")
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if by_label:
        r, a = attach(r, "key", size, "blocks", rows.count(), "rows"), attach(a, "key", size, "blocks", anchors.count(), "asks")
    else:
        one = F.broadcast(size.select("blocks"))  # one row
        r, a = r.crossJoin(one), a.crossJoin(one)
    r, a = r.where("blocks is not null"), a.where("blocks is not null")
    band = [c for c in ("pids", "pscores") if c in anchors.columns]
    none = [F.lit(None).cast("array<bigint>").alias(c) for c in band]
    left = r.select("key", part("id", "blocks.rb").alias("lo"), every("blocks.ab").alias("hi"), F.lit(False).alias("asks"), "id", "label", "vec", F.lit(-1).cast("long").alias("uid"), *none)
    right = a.select("key", every("blocks.rb").alias("lo"), part("uid", "blocks.ab").alias("hi"), F.lit(True).alias("asks"), "id", "label", "vec", "uid", *band)
    return left.unionByName(right).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "asks", "id")


def _tiles(batches: Iterator[pa.RecordBatch], length: int):
    """(table, anchors of a tile, candidates of its block, integer vectors) of every unit."""
    for t, starts in stretches(batches, ["key", "lo", "hi"]):
        x = integers(t.column("vec"), length)
        asks = t.column("asks").to_numpy()
        for a, b in zip(starts, np.r_[starts[1:], len(t)]):
            places = np.arange(a, b)
            q, c = places[asks[a:b]], places[~asks[a:b]]
            for s in range(0, len(q) if len(c) else 0, TILE):
                yield t, q[s : s + TILE], c, x


def positives(rows: DataFrame, anchors: DataFrame, scratch: Scratch, length: int, k: int = POSITIVES) -> DataFrame:
    """``uid``, ``slot`` (from 0), ``positive_id``, ``positive_score``: the best ``k`` other rows of an anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, q, c, x in _tiles(batches, length):
            ids, uid = t.column("id").to_numpy(), t.column("uid").to_numpy()
            found = sliced(x[q], x[c], ids[q][:, None] != ids[c][None], best_limits(k))
            best = leading(found.i, ids[c[found.j]], found.score, k)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (uid[q[found.i[best]]], ids[c[found.j[best]]], found.score[best])], names=["uid", "positive_id", "positive_score"])

    found = _units(rows, anchors, scratch, True).mapInArrow(run, "uid long, positive_id long, positive_score long")
    w = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k).withColumn("slot", F.col("slot") - 1)


def negatives(rows: DataFrame, anchors: DataFrame, scratch: Scratch, length: int, k: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """``uid``, ``slot``, ``positive_id``, ``positive_score``, ``rank``, ``negative_id``, ``negative_score``.

    ``anchors`` have ``pids`` and ``pscores``. Of every positive the best ``k`` rows of other labels whose score lies
    between the hundredths ``band`` of the positive's.
    """
    names = ["uid", "slot", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, q, c, x in _tiles(batches, length):
            ids, uid, label = (t.column(n).to_numpy() for n in ("id", "uid", "label"))
            pid, score = (t.column(n).take(pa.array(q)).to_pylist() for n in ("pids", "pscores"))
            wide = max(map(len, score))
            p = np.array([s + [s[-1]] * (wide - len(s)) for s in score], np.int64)  # the last repeats: its band is there anyway
            a, b = p // 100, p % 100  # so that no product overflows
            low, high = band[0] * a - (-band[0] * b) // 100, band[1] * a + (band[1] * b) // 100
            meets = low <= high
            some = meets.any(axis=1)
            least, greatest = np.where(meets, low, np.iinfo(np.int64).max).min(axis=1), np.where(meets, high, np.iinfo(np.int64).min).max(axis=1)
            first_end = np.where(meets, high, np.iinfo(np.int64).max).min(axis=1)
            if not some.any():
                continue
            q, pid, p, low, high = q[some], [v for v, s in zip(pid, some) if s], p[some], low[some], high[some]
            alive = (label[q][:, None] != label[c][None]) & (ids[q][:, None] != ids[c][None])
            found = sliced(x[q], x[c], alive, band_limits(least[some], first_end[some], greatest[some], k))
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = np.array([len(v) for v in pid])
            pids = np.array([v + [0] * (wide - len(v)) for v in pid], np.int64)
            for slot in range(wide):
                ok = (slot < held[found.i]) & (found.score >= low[found.i, slot]) & (found.score <= high[found.i, slot])
                i, j, s = found.i[ok], found.j[ok], found.score[ok]
                best = leading(i, ids[c[j]], s, k)
                i, j, s = i[best], j[best], s[best]
                for lst, v in zip(out, (uid[q[i]], np.full(len(i), slot, np.int32), pids[i, slot], p[i, slot], ids[c[j]], s)):
                    lst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=names)

    found = _units(rows, anchors, scratch, False).mapInArrow(run, "uid long, slot int, positive_id long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("uid", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, scratch: Scratch, is_anchor, label: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Hard negatives of every row where ``is_anchor`` holds: one row for each anchor, positive and negative."""
    length = common_length(rows, vec_col)
    packed = scratch.write(scaled(rows, id_col, vec_col, label, length), "scaled")
    anchors = scratch.write(packed.where(is_anchor(F.col("id"))).distinct().withColumn("uid", F.monotonically_increasing_id()), "anchors")
    near = scratch.write(positives(packed, anchors, scratch, length), "positives")
    held = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_id", "positive_score"))).alias("p"))  # POSITIVES at most
    asking = scratch.write(anchors.join(held, "uid").select("uid", "id", "label", "vec", F.col("p.positive_id").alias("pids"), F.col("p.positive_score").alias("pscores")), "asking")
    found = negatives(packed, asking, scratch, length)
    return found.join(asking.select("uid", F.col("id").alias("anchor_id")), "uid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, Scratch(spark, "negatives"), lambda c: c % 100 == 0, label)


OP12_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {BAND[0]} * positive_score <= 100 * score AND 100 * score <= {BAND[1]} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
