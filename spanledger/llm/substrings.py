"""Repeated word sequences by a compacted de Bruijn graph.

Every window of k words is an edge between its first and last k-1 words. Edges are handled as super-k-mers: a maximal
run of consecutive windows of a document that share the same minimizer (the leftmost smallest hash among the m-word
sequences inside the window). Equal windows have the same minimizer, so windows that repeat meet under one key, and a
run of windows that repeats as a whole is one row instead of one per window.

1. ``super_kmers``: one pass over the texts; a row has the minimizer ``mh``, the hash ``ch`` of the run's whole content,
   and source coordinates (doc, start, windows).
2. Minimizers seen once are dropped; a class is a distinct (mh, ch), 128 bits. Its first occurrence is its source; every
   other occurrence repeats it whole.
3. Where a minimizer has several classes (the graph branches: ends of repeats, near copies), the source occurrence of
   each class is looked up again by its coordinates and its windows are compared one by one.
4. Repeated edges that follow each other in a document, with sources that follow each other too, form a nonbranching
   path: a self-join finds the edges that no other continues to (path heads), and each path becomes one span with the
   coordinates of its source.
5. The source's words are looked up at those coordinates and their 128-bit digest goes with the span; a span is cut only
   where the document's own words have that digest (``verified``), so no chance match of 64-bit hashes removes a word.

Edge cases: null texts have no words; rows with a null id lose nothing and are nobody's source; rows that share an id
are separate texts at equal positions, so neither is earlier; a text shorter than k words has no window; an empty
table gives no rows; other columns are kept by :func:`with_spans` (``__spans`` is added) and else ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .release import released
from .scratch import Scratch
from .skew import attach

WINDOW = 20
MINIMIZER = 7
#: Texts are handled this many bytes at a time (one whole text at least).
PORTION = 1 << 20
BASE = 0x9E3779B97F4A7C15


def _power(k: int) -> np.uint64:
    return np.uint64(pow(BASE, k, 1 << 64))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (polynomial, then mixed), by doubling: log2(k) array operations."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    power, size, acc, done, left = words, 1, None, 0, k
    while left:
        if left & 1:
            if acc is None:
                acc, done = power, size
            else:
                n = min(len(acc), len(power) - done)
                acc = acc[:n] * _power(size) + power[done : done + n]
                done += size
        left >>= 1
        if left:
            power = power[: len(power) - size] * _power(size) + power[size:]
            size *= 2
    return _mix(acc)


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every window of ``width`` values."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(h[b] < h[a], b, a)
        size *= 2
    n = len(h) - width + 1
    a, b = at[:n], at[width - size : width - size + n]
    return np.where(h[b] < h[a], b, a)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the word count of each text."""
    words = [(t or "").encode().split() for t in texts]  # split() cuts at 0x20 and 0x09-0x0D
    counts = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def runs(words: np.ndarray, counts: np.ndarray, window: int, minimizer: int) -> dict[str, np.ndarray]:
    """Super-k-mers of a portion of texts: text number, start inside it, windows, mh, ch."""
    g, w = sequence_hashes(words, minimizer), sequence_hashes(words, window)
    at = leftmost_minimum(g, window - minimizer + 1)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(at)]
    s = np.arange(len(at))
    s = s[s + window <= ends[doc]]
    if not len(s):
        z = np.zeros(0, np.int64)
        return {"text": z, "start": z, "n": z, "mh": z, "ch": z}
    p, d = at[s], doc[s]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
    n = np.diff(np.r_[first, len(s)])
    lead = (p[first] - s[first]).astype(np.uint64)
    ch = _mix(w[s[first]] * _power(3) + w[s[first] + n - 1] * _power(2) + lead * _power(1) + n.astype(np.uint64))
    return {"text": d[first], "start": s[first] - (ends - counts)[d[first]], "n": n, "mh": g[p[first]].view(np.int64), "ch": ch.view(np.int64)}


def portions(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about PORTION bytes each."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        v = t.as_py()
        held.append(v)
        size += len(v or "")
        if size >= PORTION:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def super_kmers(docs: DataFrame, window: int, minimizer: int) -> DataFrame:
    """``docs``: id, th, text. Rows: mh, ch, id, th, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0), b.column(1)
            for first, texts in portions(b.column(2)):
                r = runs(*word_hashes(texts), window, minimizer)
                row = pa.array(r["text"] + first)
                yield pa.RecordBatch.from_arrays([pa.array(r["mh"]), pa.array(r["ch"]), ids.take(row), th.take(row), pa.array(r["start"].astype(np.int32)), pa.array(r["n"].astype(np.int32))], names=["mh", "ch", "id", "th", "start", "n"])

    return docs.where("id is not null").mapInArrow(released(run), "mh long, ch long, id long, th long, start int, n int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def source_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The windows of ``wanted`` (mh, id, th, start, n), looked up in the texts by their coordinates."""
    asked = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("mh", "start", "n")).alias("asked"))  # bounded by the text's length
    both = docs.join(asked, ["id", "th"]).select("id", "th", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w = sequence_hashes(word_hashes([b.column(2)[k].as_py()])[0], window)
                want = b.column(3)[k].values
                mh, start, n = (want.field(c).to_numpy() for c in range(3))
                at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mh, n)), pa.array(w[at].view(np.int64)), pa.array([b.column(0)[k].as_py()] * m, pa.int64()), pa.array([b.column(1)[k].as_py()] * m, pa.int64()), pa.array(at.astype(np.int32))], names=["mh", "w", "id", "th", "at"])

    return both.mapInArrow(released(run), "mh long, w long, id long, th long, at int")


def repeated_edges(docs: DataFrame, scratch: Scratch, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """``docs``: id, th, text. Edges that start earlier elsewhere: id, th, start, n, source_id, source_th, source_start."""
    occ = scratch.write(super_kmers(docs, window, minimizer), "occurrences")
    seen = occ.groupBy("mh").agg(F.count("*").alias("rows"), (F.min("ch") != F.max("ch")).alias("branches")).where("rows > 1")
    seen = scratch.write(seen, "minimizers")
    scratch.sweep()
    total = occ.count()
    repeated = attach(occ, "mh", seen, "branches", total, "rows").where("branches is not null").drop("__rn")
    repeated = scratch.write(repeated.select(F.struct("mh", "ch").alias("key"), "branches", "id", "th", "start", "n"), "repeated")
    scratch.drop("occurrences", "minimizers")
    # a class's first occurrence is its source
    classes = repeated.groupBy("key").agg(F.min(F.struct("id", "start", "th")).alias("source"), F.count("*").alias("rows"))
    whole = scratch.write(attach(repeated, "key", classes, "source", repeated.count(), "rows").select(F.col("key.mh").alias("mh"), "branches", "id", "th", "start", "n", "source"), "whole")
    scratch.drop("repeated")
    own = (F.col("id") == F.col("source.id")) & (F.col("start") == F.col("source.start"))
    at = ["id", "th", "start", "n"]
    later = whole.where(~own).select(*at, F.col("source.id").alias("source_id"), F.col("source.th").alias("source_th"), F.col("source.start").alias("source_start"))
    # where the graph branches, the sources' windows are compared one by one
    single = source_windows(docs, whole.where(own & F.col("branches")), window)
    single = scratch.write(single.select(F.struct("mh", "w").alias("key"), "id", "th", "at"), "windows")
    scratch.sweep()
    firsts = single.groupBy("key").agg(F.min(F.struct("id", "at", "th")).alias("source"), F.count("*").alias("rows")).where("rows > 1")
    each = attach(single, "key", firsts, "source", single.count(), "rows").where("source is not null and (source.id != id or source.at != at)")
    each = each.select("id", "th", F.col("at").alias("start"), F.lit(1).alias("n"), F.col("source.id").alias("source_id"), F.col("source.th").alias("source_th"), F.col("source.at").alias("source_start"))
    edges = scratch.write(later.unionByName(each), "edges")
    scratch.drop("whole", "windows")
    return edges


def compact(edges: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Nonbranching paths of repeated edges as spans of words: id, th, start, stop, source_id, source_th, source_start."""
    e = edges.withColumn("shift", F.col("source_start") - F.col("start"))
    follows = e.select("id", "th", "source_id", "source_th", "shift", (F.col("start") + F.col("n")).alias("start"), F.lit(True).alias("follows"))
    key = ["id", "th", "source_id", "source_th", "shift", "start"]
    marked = e.join(follows.distinct(), key, "left")
    w = Window.partitionBy("id", "th").orderBy("source_id", "source_th", "shift", "start")
    path = marked.withColumn("path", F.sum(F.when(F.col("follows").isNull(), 1).otherwise(0)).over(w))
    spans = path.groupBy("id", "th", "path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("last"), F.first("source_id").alias("source_id"), F.first("source_th").alias("source_th"), F.min("source_start").alias("source_start"))
    spans = scratch.write(spans.select("id", "th", "start", (F.col("last") - 1 + window).alias("stop"), "source_id", "source_th", "source_start"), "spans")
    scratch.drop("edges")
    return spans


def words_digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def source_digests(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``digest`` to the spans: that of the words at the source's coordinates."""
    size = (F.col("stop") - F.col("start")).alias("size")
    wanted = spans.select("source_id", "source_th", "source_start", size).distinct()
    asked = wanted.groupBy(F.col("source_id").alias("id"), F.col("source_th").alias("th")).agg(F.collect_list(F.struct("source_start", "size")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, want = (b.column(2)[k].as_py() or "").encode().split(), b.column(3)[k].values
                starts, sizes = want.field(0).to_numpy(), want.field(1).to_numpy()
                digests = [words_digest(words[s : s + n]) for s, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[k].as_py()] * len(starts), pa.int64()) for c in (0, 1)] + [pa.array(starts), pa.array(sizes), pa.array(digests, pa.binary())], names=["source_id", "source_th", "source_start", "size", "digest"])

    told = docs.join(asked, ["id", "th"]).select("id", "th", "text", "asked").mapInArrow(released(run), "source_id long, source_th long, source_start int, size int, digest binary")
    told = scratch.write(told, "digests").distinct()
    scratch.sweep()
    return scratch.write(spans.withColumn("size", size).join(told, ["source_id", "source_th", "source_start", "size"]).drop("size"), "digested")


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col="doc_id", text_col="text", window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """Spans of words (start to stop) whose windows all start earlier in the corpus, with the source's coordinates and digest."""
    keyed = _keyed(docs, id_col, text_col)
    return source_digests(keyed, compact(repeated_edges(keyed, scratch, window, minimizer), scratch, window), scratch)


def verified(words: list[bytes], spans: list[dict]) -> tuple[list[int], list[int]]:
    """Starts and stops of the spans whose source has the same words."""
    ok = [s for s in spans if words_digest(words[s["start"] : s["stop"]]) == s["digest"]]
    return [s["start"] for s in ok], [s["stop"] for s in ok]


def kept_mask(n: int, starts, stops) -> np.ndarray:
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, starts, 1)
    np.add.at(keep, stops, -1)
    return np.cumsum(keep[:-1]) == 0


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with ``__spans``: an array of (start, stop, digest), null where nothing repeats."""
    cut = spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop", "digest")).alias("__spans"))
    cut = cut.select(F.col("id").alias("__sid"), F.col("th").alias("__sth"), "__spans")
    return docs.join(cut, (F.col(id_col).cast("long") == F.col("__sid")) & (F.xxhash64(F.col(text_col)) == F.col("__sth")), "left").drop("__sid", "__sth")


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside its verified spans."""
    words = (text or "").encode().split()
    if spans is None or not len(spans):
        return len(words), words
    return len(words), list(itertools.compress(words, kept_mask(len(words), *verified(words, spans))))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document, how many go, and the digest of what stays."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark, "substrings")
    spans = repeated_spans(docs, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest = [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                total, kept = kept_words(t.as_py(), s.as_py())
                n.append(total)
                gone.append(total - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(docs, spans, "doc_id", "text").select("doc_id", "text", "__spans").mapInArrow(released(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")
