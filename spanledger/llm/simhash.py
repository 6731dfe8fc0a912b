"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64-bit SimHash over word shingles, one bit per position set in over half of the shingle hashes. Equal
fingerprints are one node. The 64 bits are cut into m parts, correlated bits together; a budget of ``distance + 1``
units is dealt to the parts (a part with u units has threshold u - 1, none skips it), and two fingerprints within the
distance must stay within the threshold of at least one part. Sizes and units come from a dynamic programme over
candidate counts: exact pair counts of every part's values over the whole table for threshold 0, carried to higher
thresholds by the bits' own frequencies. A part with threshold t probes its value with every choice of t bits masked.
Candidates are verified on the whole fingerprint, in blocks (see ``blocks``).

Edge cases: null and empty texts have fingerprint 0 and link like any other; rows with a null id take no part as
members but get the component of their fingerprint (null when no row with an id has a linked one); repeated rows and
ids are members of one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LINK_SCHEMA, forest, link_batch, spread, stretches, unit_pairs, work_units
from .components import connected_components
from .release import released
from .scratch import Scratch
from .skew import attach

SHINGLE = 3
DISTANCE = 3
#: Near copies: word shingles, Jaccard similarity, and the share of pairs at just that similarity that must share a bucket.
COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
COPY_RECALL = 0.9999
#: Rows per value of a part, before parts are made wider and lanes more.
COPY_LOAD = 1 << 10
SEED = 42
CHUNK = 1 << 15
BLOCK = 1024
PARTS = (2, 3, 4)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one whole text; memory is bounded by CHUNK shingles besides its words."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only; split() at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        grams, total = [b" ".join(words)], 1
    else:
        grams, total = map(b" ".join, zip(*(words[k:] for k in range(shingle)))), n - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    hashes = (digest(g, SEED) for g in grams)
    for k in range(0, total, CHUNK):
        h = np.fromiter(itertools.islice(hashes, CHUNK), np.uint64, min(CHUNK, total - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every two bits how many have both: 64 x 64 sums, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(x), CHUNK):
                bits = np.unpackbits(np.ascontiguousarray(x[k : k + CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int32()), pa.array(np.r_[both.ravel(), n].astype(np.int64))], names=["k", "n"])

    got = fps.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in got:
        flat[r["k"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` groups of near equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        first = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], units: int) -> list[int]:
    """Units for each part, ``costs[part][units]`` least in total, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, deal) in best.items():
            for u in range(min(units - used, len(c) - 1) + 1):
                cand = (cost + c[u], [*deal, u])
                if used + u not in nxt or cand < nxt[used + u]:
                    nxt[used + u] = cand
        best = nxt
    return best[units][1]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, by least estimated work over the part counts in PARTS."""
    n, both = bit_statistics(fps)
    groups = {m: group_bits(n, both, m) for m in PARTS}
    masks = [F.struct(F.lit(f"{m}-{k}").alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v")) for m, gs in groups.items() for k, g in enumerate(gs)]
    counted = fps.select(F.explode(F.array(*masks)).alias("x")).groupBy("x.part", "x.v").agg(F.count("*").alias("c"))
    same = {r["part"]: float(r["s"]) for r in counted.groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("s")).collect()}
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / (p * p + (1 - p) ** 2)
    best = None
    for m, gs in groups.items():
        costs = []
        for k, g in enumerate(gs):
            poly = [1.0]  # elementary symmetric sums of the odds: pairs that differ in t bits against none
            for b in g:
                poly = [x + (poly[t - 1] * odds[b] if t else 0) for t, x in enumerate([*poly, 0.0])][: distance + 1]
            pairs0 = same.get(f"{m}-{k}", 0.0)
            row = [0.0]
            for t in range(distance + 1):
                probes = comb(len(g), t)
                row.append(4.0 * max(n, 1) * probes + pairs0 * sum(poly[s] * comb(len(g) - s, t - s) for s in range(t + 1)))
            costs.append(row)
        units = allocate(costs, distance + 1)
        cost = sum(c[u] for c, u in zip(costs, units))
        if best is None or cost < best[0]:
            best = (cost, [(g, u - 1) for g, u in zip(gs, units) if u])
    return best[1]


def probes(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``key`` and the node for every part and every choice of masked bits."""
    masks = [F.struct(F.lit(100_000 * k + c).alias("probe"), F.col("fp").bitwiseAND(F.lit(_mask(b for b in g if b not in out))).alias("v")) for k, (g, t) in enumerate(parts) for c, out in enumerate(itertools.combinations(g, t))]
    return nodes.select("id", "fp", F.explode(F.array(*masks)).alias("x")).select("id", "fp", F.xxhash64("x.probe", "x.v").alias("key"))


def linked(nodes: DataFrame, scratch: Scratch, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """A forest ``a``, ``b`` that connects all nodes (``id``, ``fp``, distinct) within the distance of each other."""
    entries = probes(nodes, plan(nodes, distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in stretches(batches, ["key", "lo", "hi"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            ids, mine, lo, hi = (t.column(c).to_numpy() for c in ("id", "mine", "lo", "hi"))
            close = lambda x: np.bitwise_count(x) <= distance
            i, j = unit_pairs(starts, len(t), mine, lo, hi, lambda a, b: close(fp[a][:, None] ^ fp[b][None, :]), lambda a, b: close(fp[a] ^ fp[b]), prune=True)
            if len(i):
                a, b = forest(len(t), i, j, ids)
                yield link_batch(a, b, np.zeros(len(a), np.int64))

    return scratch.write(work_units(entries, block, scratch).mapInArrow(released(run), LINK_SCHEMA).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col="doc_id", text_col="text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``id``, ``fp`` and ``component`` (smallest id reachable over links) of every row."""
    fps = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fps")
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "nodes")
    comp = connected_components(linked(nodes.where("id is not null").select("id", "fp"), scratch, distance), scratch)
    named = nodes.join(comp.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("fp", F.coalesce("component", "id").alias("component"), "rows")
    return attach(fps, "fp", scratch.write(named, "named"), "component", fps.count(), "rows").select("id", "fp", "component")


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, max(1, len(words) - shingle + 1)))


def minima(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` MinHashes of a set of shingle hashes: two sets agree in a lane with their Jaccard similarity as odds."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, lanes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[k : k + 2048, None] * odd).min(axis=0), out=low)
    return low


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def copy_layout(rows: int, similarity: float = COPY_SIMILARITY, recall: float = COPY_RECALL) -> tuple[int, int]:
    """(lanes, parts of a lane) that SimHash would need: parts wide enough for the rows, lanes enough that one part of a pair agrees."""
    parts = next((m for m in (4, 3, 2) if rows <= COPY_LOAD << (64 // m)), 2)
    agree = (1 - differing_share(similarity)) ** (64 / parts)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - agree) / parts)), parts


def copy_bands(rows: int, similarity: float = COPY_SIMILARITY, recall: float = COPY_RECALL) -> tuple[int, int]:
    """(bands, lanes of a band): wider bands for more rows, and as many as the recall of a pair at the similarity takes."""
    width = next((w for w in (4, 5, 6) if rows <= 1 << (4 * w + 4)), 7)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**width))), width


def copy_least(lanes: int, similarity: float = COPY_SIMILARITY) -> int:
    """Agreeing lanes from which a pair is compared exactly: five standard errors below those expected at the similarity."""
    return int(lanes * similarity - 5 * (lanes * similarity * (1 - similarity)) ** 0.5)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _copy_entries(bands: int, width: int):
    """Turns nodes (``id``, ``mins``: a band's key each, then a byte a lane) into one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                p = b.slice(s, 1024)
                x = np.frombuffer(b"".join(p.column(1).to_pylist()), np.uint8).reshape(p.num_rows, -1)
                keys = np.ascontiguousarray(x[:, : 8 * bands]).view(np.int64)
                sig = pa.array([r.tobytes() for r in x[:, 8 * bands :]], pa.binary())
                row = pa.array(np.repeat(np.arange(p.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), p.column(0).take(row), sig.take(row)], names=["key", "id", "sig"])

    return run


def exact_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> tuple[list[int], list[int]]:
    """Index pairs of Jaccard similarity ``similarity`` or more that connect what all such pairs connect.

    With ``side`` (two blocks) only pairs of different sides count. A pair that links already connect is not compared.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mine = [where[e - k : e] for e, k in zip(ends, sizes)]
    lab, mark = np.arange(n), np.zeros(len(vocabulary), bool)
    out_i, out_j = [], []
    for i in range(n - 1):
        small, large = similarity * sizes[i] - 1e-9, sizes[i] / similarity + 1e-9
        ok = (lab[i + 1 :] != lab[i]) & (sizes[i + 1 :] >= small) & (sizes[i + 1 :] <= large) & (sizes[i + 1 :] > 0)
        if side is not None:
            ok &= side[i + 1 :] != side[i]
        js = np.flatnonzero(ok) + i + 1
        if not len(js):
            continue
        mark[mine[i]] = True
        both = np.add.reduceat(mark[np.concatenate([mine[j] for j in js])].astype(np.int64), np.r_[0, np.cumsum(sizes[js])[:-1]])
        mark[mine[i]] = False
        for j in js[both >= similarity * (sizes[i] + sizes[js] - both) - 1e-9]:
            out_i.append(i)
            out_j.append(int(j))
            lab[lab == lab[j]] = lab[i]
    return out_i, out_j


def near_copies(docs: DataFrame, scratch: Scratch, id_col="doc_id", text_col="text", shingle=COPY_SHINGLE, similarity=COPY_SIMILARITY, recall=COPY_RECALL, block: int = BLOCK) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable over links) of every row; texts link from ``similarity`` on.

    Similarity is the Jaccard similarity of the sets of word shingle hashes. Texts of equal sets are one node. Candidates
    are the texts whose SimHash fingerprints the generalised pigeonhole finds within DISTANCE bits of each other, as in
    ``near_duplicates``; for pairs beyond that distance, also those that agree in a band of MinHashes, which holds for
    texts of few shingles too, and in enough of all lanes. Only texts that candidates connect go on. Their whole sets are compared with each other, in blocks, and the sets alone decide.
    Edge cases as for ``near_duplicates``: texts without words are one node.
    """
    bands, width = copy_bands(docs.count(), similarity, recall)
    lanes = bands * width
    least = copy_least(lanes, similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                p = b.slice(s, 1024)
                digests, mins, fps = [], [], []
                for t in p.column(1):
                    h = _hashes(t.as_py(), shingle)
                    fps.append(fingerprint(t.as_py()))
                    low = minima(h, lanes)
                    key = salt.copy()
                    for k in range(width):
                        key = (key ^ low[k::width]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(32)
                    digests.append(set_digest(h))
                    mins.append(key.tobytes() + (low >> np.uint64(20)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(digests, pa.binary()), pa.array(mins, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "digest", "mins", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = scratch.write(texts.mapInArrow(released(sign), "id long, digest binary, mins binary, fp long"), "sigs")
    nodes = scratch.write(sigs.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("mins").alias("mins"), F.min_by("fp", "id").alias("fp")), "nodes")
    hubs = scratch.write(nodes.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "fp-nodes")
    named = attach(nodes.where("id is not null").select("id", "fp"), "fp", hubs.withColumnRenamed("id", "hub"), "hub", nodes.count(), "rows")
    alike = linked(hubs.select("id", "fp"), scratch).unionByName(named.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    known = nodes.where("id is not null").select("id", "mins")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in stretches(batches, ["key", "lo", "hi"]):
            x = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, lanes)
            ids, mine, lo, hi = (t.column(c).to_numpy() for c in ("id", "mine", "lo", "hi"))

            def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                same = np.zeros((len(a), len(b)), np.int16)
                for lane in range(lanes):
                    same += x[a, lane][:, None] == x[b, lane][None, :]
                return same >= least

            i, j = unit_pairs(starts, len(t), mine, lo, hi, tile, lambda i, j: (x[i] == x[j]).sum(axis=1) >= least, prune=True)
            if len(i):
                a, b = forest(len(t), i, j, ids)
                yield link_batch(a, b, np.zeros(len(a), np.int64))

    entries = known.mapInArrow(_copy_entries(bands, width), "key long, id long, sig binary")
    loose = scratch.write(work_units(entries, block, scratch, known.count() * bands).mapInArrow(released(candidates), LINK_SCHEMA).select("a", "b"), "copy-candidates")
    members = connected_components(loose.unionByName(alike), scratch, "candidates").select(F.col("id").alias("__id"), F.col("component").alias("key"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                p = b.slice(s, 256)
                sets = [_hashes(t.as_py(), shingle) for t in p.column(2)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["key", "id", "n", "hashes"])

    sets = scratch.write(texts.join(members, F.col("id") == F.col("__id")).select("key", "id", "text").mapInArrow(released(shingled), "key long, id long, n long, hashes binary"), "copy-sets")
    # a block is bounded by its rows and by its shingles
    sizes = sets.groupBy("key").agg(F.count("*").alias("__size"), F.greatest(F.count("*"), F.ceil(F.sum("n") / 4096)).alias("size"))
    sized = attach(sets, "key", sizes, "size", sets.count(), "__size")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in stretches(batches, ["key", "lo", "hi"], 1):
            ids, mine, lo, hi = (t.column(c).to_numpy() for c in ("id", "mine", "lo", "hi"))
            found_a, found_b = [], []
            for s, e in zip(starts, [*starts[1:], len(t)]):
                if e - s > 1:
                    held = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes").slice(s, e - s)]
                    i, j = exact_links(held, None if lo[s] == hi[s] else mine[s:e], similarity)
                    found_a.append(ids[s:e][i])
                    found_b.append(ids[s:e][j])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield link_batch(a, b, np.zeros(len(a), np.int64))

    links = spread(sized, block).select("key", "lo", "hi", "mine", "id", "hashes").mapInArrow(released(verify), LINK_SCHEMA)
    links = scratch.write(links.where("a != b").select("a", "b"), "copy-links")
    comp = connected_components(links, scratch, "copies")
    named = nodes.join(comp.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("digest", F.coalesce("component", "id").alias("component"), "rows")
    return attach(sigs.select("id", "digest"), "digest", scratch.write(named, "copy-named"), "component", sigs.count(), "rows").select("id", "component")


def op8_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "simhash"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
