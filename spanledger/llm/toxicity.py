"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps compatibility forms, accents, look-alike letters of other scripts and digits or signs that stand for
letters to plain lower-case letters. The lexicon is learned from labelled rows and has two kinds of patterns: whole
words, and word beginnings of 4 to 8 letters for languages that build words from stems. A word's support is the number
of training texts that have it; a beginning's is the number of texts of whose words it makes up at least LEVEL, in two
different words or more, so that neither what is frequent everywhere nor the beginning of a single word counts. Patterns need MIN_SUPPORT toxic texts (a count, whatever the number
of labels) and MIN_LOG_ODDS; equal texts count once. Of beginnings that contain each other the best one stays. Exception
phrases (a lexicon word with its neighbour) that clean texts use more are learned alike, and matches inside them do not
count. The score is a logistic function of whether anything matched and of the weighted matches per hundred words
(beginnings only where they reach LEVEL), calibrated on the same rows.

Bound: at most MAX_TRAINING labelled ids (by hash of the id) are used to fit, and what their texts support is the
lexicon; the calibration is fitted on a table of rounded features, so the driver sees no row of a text. Everything is
scored, over whole texts.

Edge cases: null and empty texts score the calibrated rate of unmatched texts; labels with null id or label, and
labels of missing documents, are ignored; without usable labels every score is 0; a document with several equal labels
counts once; repeated rows score alike; an empty table gives no rows; other columns are kept by :func:`score` and
otherwise ignored (the added column must have a name of its own).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_TRAINING = 20_000
MIN_SUPPORT = 8
MIN_LOG_ODDS = 3.0
#: Share of a text's words from which a beginning counts.
LEVEL = 0.012
BEGINNINGS = range(4, 9)
#: Distinct patterns that a task counts before it hands them on.
HELD = 500_000
THRESHOLD = 0.3

# Letters of Cyrillic and Greek that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝьαβεικνορτυχ", "abekmhopctyxijsdqwbabeikvoptux"))
SIGNS = dict(zip("013457@$!|€", "oieastasile"))
_TABLE = str.maketrans(LOOKALIKES)
_SIGN = re.compile(r"[013457@$!|€](?=[a-z])|(?<=[a-z])[013457@$](?=[a-z013457@$]|\b)")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def fold(text: str | None) -> str:
    """Lower-case letters with look-alikes, accents and digit substitutions undone; length may change."""
    t = (text or "").lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", _HIDDEN.sub("", t)) if not unicodedata.combining(c)) if not _plain(t) else t.translate(_ACCENTS)
        t = t.translate(_TABLE)
    return _SIGN.sub(lambda m: SIGNS[m[0]], t)


# One-character answers of the slow path above for the Latin letters with accents, so that most texts take one pass.
_ACCENTS = {c: base for c in range(0xC0, 0x180) for base in ["".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))] if base != chr(c)}
_OTHER = re.compile("[^\x00-\x7fß-ſ]")


def _plain(t: str) -> bool:
    return _OTHER.search(t) is None


@dataclass
class Model:
    """A fitted scorer: weights of whole words and of beginnings, exception phrases, and the calibration."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: list[str]
    coef: tuple[float, float, float]

    def automaton(self):
        a = ahocorasick.Automaton()
        for p in {*self.words, *self.beginnings, *self.exceptions}:
            a.add_word(p, (len(p), self.words.get(p), self.beginnings.get(p), p in set(self.exceptions)))
        if len(a):
            a.make_automaton()
        return a


def features(text: str | None, automaton) -> tuple[float, float]:
    """(1 if anything matched, log of weighted matches per hundred words)."""
    t = fold(text)
    if not len(automaton):
        return 0.0, 0.0
    hits: dict[int, tuple[int, float]] = {}
    begun: dict[tuple[str, float], list[int]] = {}
    shields = []
    for end, (size, word, beginning, shield) in automaton.iter(t):
        start = end - size + 1
        if start and t[start - 1].isalpha():
            continue
        if end + 1 == len(t) or not t[end + 1].isalpha():
            if shield:
                shields.append((start, end))
            if word is not None:
                hits[start] = (end, word)
        if beginning is not None:
            begun.setdefault((t[start : end + 1], beginning), []).append(start)
    n = max(1, len(t.split()))
    for (p, weight), starts in begun.items():
        if len(starts) >= LEVEL * n:
            for s in starts:
                hits.setdefault(s, (s + len(p) - 1, weight))
    total = sum(w for s, (e, w) in hits.items() if not any(a <= s and e <= b for a, b in shields))
    return (1.0, math.log1p(100 * total / n)) if total else (0.0, 0.0)


def _apply(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(id_col) -> F.Column:
    """The rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """``text`` and ``y`` of at most MAX_TRAINING labelled ids outside the held-out part; equal texts once."""
    ids = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    ids = ids.where(~held_out("__id")).distinct().orderBy(F.xxhash64("__id"), "__id", "y").limit(MAX_TRAINING)
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("text"), "y")
    return rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"]).drop("h")


def patterns(text: str | None) -> set[tuple[bool, str]]:
    """The words of a text, and (marked) the beginnings that make up at least LEVEL of its words, in two words at least."""
    words = Counter(_WORD.findall(fold(text)))
    least = LEVEL * words.total()
    out = {(False, w) for w in words}
    for n in BEGINNINGS:
        forms = Counter(w[:n] for w in words)
        several = Counter()
        for w, c in words.items():
            if forms[w[:n]] > 1 and len(w) >= n:
                several[w[:n]] += c
        out |= {(True, p) for p, c in several.items() if c >= least}
    return out


def _supports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def handed_on():
        keys = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["begins", "p", "toxic", "clean"])

    for b in batches:
        for t, y in zip(b.column(0), b.column(1)):
            seen[y.as_py()].update(patterns(t.as_py()))
            if len(seen[0]) + len(seen[1]) > HELD:
                yield handed_on()
    yield handed_on()


def best_beginnings(found: list[tuple[str, float]]) -> dict[str, float]:
    """Of beginnings that contain each other the one with the highest log-odds stays (ties: the longest)."""
    out: dict[str, float] = {}
    cut: set[str] = set()
    for p, w in sorted(found, key=lambda x: (-x[1], -len(x[0]), x[0])):
        starts = {p[:n] for n in range(1, len(p) + 1)}
        if p not in cut and not starts & out.keys():
            out[p] = w
            cut |= starts
    return out


def fit(rows: DataFrame) -> Model:
    """Learn lexicon, exceptions and calibration from ``text`` and ``y``, which are read four times: hand over a table."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos:
        return Model({}, {}, [], (-800.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1.0)) - F.log((F.col("clean") + 0.5) / (neg + 1.0))
    counts = rows.mapInArrow(_supports, "begins boolean, p string, toxic long, clean long").groupBy("begins", "p").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    top = counts.where(F.col("toxic") >= MIN_SUPPORT).withColumn("w", F.round(odds, 9)).where(F.col("w") >= MIN_LOG_ODDS).collect()
    weight = lambda w: min(1.0, w / 5)
    words = {r["p"]: weight(r["w"]) for r in top if not r["begins"]}
    beginnings = {p: weight(w) for p, w in best_beginnings([(r["p"], r["w"]) for r in top if r["begins"]]).items()}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for t, y in zip(b.column(0), b.column(1)):
                ws = ["", *_WORD.findall(fold(t.as_py())), ""]
                out.update((ws[k], ws[k - 1], ws[k + 1], y.as_py()) for k in range(1, len(ws) - 1) if ws[k] in words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["word", "before", "after", "y"])

    ctx = rows.mapInArrow(neighbours, "word string, before string, after string, y int").distinct()
    phrase = F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after")))
    shields = ctx.where((F.col("before") != "") & (F.col("after") != "")).select(phrase.alias("p"), "y")
    shields = shields.groupBy("p").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).where("clean >= 3 and clean > 2 * toxic")
    model = Model(words, beginnings, sorted(r["p"] for r in shields.collect()), (0.0, 0.0, 0.0))

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            f = np.array([features(t.as_py(), a) for t in b.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1].round(2)), b.column(1)], names=["a", "b", "y"])

    cells = rows.mapInArrow(feats, "a double, b double, y int").groupBy("a", "b", "y").agg(F.count("*").alias("n")).orderBy("a", "b", "y")
    data = np.array([(r["a"], r["b"], r["y"], r["n"]) for r in cells.collect()], float)  # b is at most log(101), in steps of 0.01
    return Model(words, beginnings, model.exceptions, _logistic(data[:, :2], data[:, 2], data[:, 3]))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + ridge * w * [0, 1, 1]
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(round(v, 9)) for v in w)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every row; the model is small and travels with the task."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, (c0, c1, c2) = model.automaton(), model.coef
        for s in parts:
            yield pd.Series([_apply(c0 + c1 * f[0] + c2 * f[1]) for f in (features(t, a) for t in s)], dtype="float64")

    return docs.withColumn(out, run(F.col(text_col)))


def fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """The model of the labels; the training rows are written once and read from there."""
    return fit(scratch.write(training_rows(docs, labels), "training"))


def op4_toxicity_lexicon(spark, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "toxicity"))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
