"""Language identification by string kernels.

A text becomes letters (lower case, everything else one blank) and is cut into windows of WINDOW letters, all of which
count, so that long texts do not hold every n-gram. The kernel of two windows is the blended-spectrum presence kernel:
the number of n-grams of 1 to ORDER letters that both have, divided by the geometric mean of the numbers that each has,
over the n-grams that at least two landmarks have. LANDMARKS windows of training texts, dealt evenly over the
languages, are the landmarks of a Nyström approximation: a window is the vector of its kernels with them, and one ridge
regression for each language against the rest (targets 1 and -1) is solved on these vectors, in the norm of the
landmarks' own kernel. The regressions' sums are taken by tasks over all windows of the training texts.

Windows are scored in batches as two matrix products: presence by landmarks, kernels by coefficients. A text's values
are the means over its windows by length; the largest names the language, and half of one plus that value, within 0 and
1, is the score (a regression on targets 1 and -1 estimates twice the probability less one).

Bound: at most MAX_TRAINING distinct texts with a language are used to fit, dealt evenly over the languages in the order
of the texts' hashes, as whole texts. Everything is scored, over whole texts.

Edge cases: null texts and texts without a letter are ``und`` with the score 0, as is everything when nothing can be
learned from; ties go to the first language in order; equal texts count once in training and score alike; rows with a
null language or without letters are not learned from; an empty table gives no rows; :func:`identify` keeps all other
columns, and columns with the names of its results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .toxicity import held_out

MAX_TRAINING = 3_000
LANDMARKS = 192
WINDOW = 2_048
ORDER = 4
RIDGE = 1e-3
BATCH = 128
NONE = "und"

_OTHER = re.compile(r"[\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def symbols(text: str | None) -> np.ndarray | None:
    """Code points of the lower-case letters with single blanks around words; None without a letter."""
    t = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(c.isalpha() for c in t):
        return None
    return np.frombuffer(f" {t} ".encode("utf-32-le"), "<u4").astype(np.uint64)


def windows(s: np.ndarray) -> list[np.ndarray]:
    """Pieces of WINDOW symbols and the few that n-grams from there reach into; a short rest joins the last one."""
    starts = list(range(0, max(1, len(s) - WINDOW // 4), WINDOW))
    return [s[a : (a + WINDOW + ORDER - 1 if k + 1 < len(starts) else len(s))] for k, a in enumerate(starts)]


def grams(w: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a window as sorted 64-bit hashes."""
    out, h = [], np.zeros(len(w), np.uint64)
    for n in range(1, ORDER + 1):
        if len(w) < n:
            break
        h = (h[: len(w) - n + 1] + w[n - 1 :] + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(29)
        out.append((h + np.uint64(n)) * _MIX)
    codes = np.sort(np.concatenate(out))
    return codes[np.r_[True, codes[1:] != codes[:-1]]]


def shared(vocabulary: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places in the vocabulary of a window's n-grams."""
    g = grams(w)
    at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
    return at[vocabulary[at] == g]


@dataclass
class Model:
    """Languages, n-grams of the landmarks (sorted hashes), which landmark has which (packed bits), and coefficients."""

    languages: list[str]
    vocabulary: np.ndarray
    packed: np.ndarray
    coef: np.ndarray

    @property
    def count(self) -> int:
        return self.coef.shape[0]

    @cached_property
    def landmarks(self) -> np.ndarray:
        """n-grams x landmarks, columns scaled by the root of their number of n-grams."""
        has = np.unpackbits(self.packed, axis=1, count=self.count).astype(np.float32)
        return has / np.sqrt(np.maximum(1, has.sum(axis=0)))

    def kernels(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Windows x landmarks."""
        has = np.zeros((len(pieces), len(self.vocabulary)), np.float32)
        n = np.ones(len(pieces))
        for k, w in enumerate(pieces):
            at = shared(self.vocabulary, w)
            has[k, at] = 1
            n[k] = max(1, len(at))
        return (has @ self.landmarks).astype(np.float64) / np.sqrt(n)[:, None]

    def values(self, texts) -> np.ndarray:
        """Texts x languages: the mean over the windows by length; not a number without a letter."""
        total, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        pieces: list[np.ndarray] = []
        owner: list[int] = []

        def add() -> None:
            size = np.array([len(p) for p in pieces], float)
            np.add.at(total, owner, self.kernels(pieces) @ self.coef * size[:, None])
            np.add.at(weight, owner, size)
            pieces.clear()
            owner.clear()

        for k, t in enumerate(texts):
            s = symbols(t)
            for w in windows(s) if s is not None else ():
                pieces.append(w)
                owner.append(k)
                if len(pieces) == BATCH:
                    add()
        if pieces:
            add()
        with np.errstate(invalid="ignore"):
            return total / weight[:, None]


def training_rows(docs: DataFrame, scratch: Scratch, id_col="doc_id", text_col="text", lang_col="lang", most: int = MAX_TRAINING) -> DataFrame:
    """``lang``, ``text``, ``nth`` (of its language) of at most ``most`` distinct texts outside the held-out part."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where(F.col("lang").isNotNull() & ~held_out("id") & F.col("text").rlike(r"\p{L}"))
    distinct = scratch.write(d.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("id").alias("id")), "distinct")
    # of a language with many texts only about 2 * most, those with the smallest hashes, are sorted
    counts = distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most)  # no more languages can be in the sample
    few = distinct.join(F.broadcast(counts), "lang").where((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 2 * most)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = scratch.write(few.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("nth", "lang").limit(most), "chosen")
    rows = d.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h", "id"]).dropDuplicates(["lang", "h"])
    return scratch.write(rows.select("lang", "text", "nth").repartition(16), "training")


def fit(rows: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of ``lang``, ``text`` and ``nth``; None without rows."""
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None

    @F.pandas_udf("binary")
    def one_window(texts: pd.Series, nth: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, nth):
            ws = windows(s) if (s := symbols(t)) is not None else []
            out.append(ws[n % len(ws)].astype("<u4").tobytes() if ws else None)
        return pd.Series(out, dtype=object)

    # whole windows first, then in the order of the training texts
    held = rows.withColumn("w", one_window("text", "nth")).where("w is not null").select("lang", "w", (F.octet_length("w") >= 2 * WINDOW).alias("whole"), "nth")
    held = held.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("whole"), "nth")))  # MAX_TRAINING rows at most
    chosen = [np.frombuffer(r["w"], "<u4").astype(np.uint64) for r in held.orderBy("turn", "lang").limit(landmarks).select("w").collect()]
    every, n = np.unique(np.concatenate([grams(w) for w in chosen]), return_counts=True)
    vocabulary = every[n >= min(2, len(chosen))]
    if not len(vocabulary):
        return None
    has = np.zeros((len(vocabulary), len(chosen)), np.uint8)
    for k, w in enumerate(chosen):
        has[shared(vocabulary, w), k] = 1
    model = Model(languages, vocabulary, np.packbits(has, axis=1), np.zeros((len(chosen), len(languages))))
    m, place = len(chosen), {v: k for k, v in enumerate(languages)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, texts = np.zeros((m, m)), np.zeros((m, len(languages))), 0
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = symbols(t)
                if s is None:
                    continue
                ws = windows(s)
                y = -np.ones(len(languages))
                y[place[lang]] = 1
                for at in range(0, len(ws), BATCH):
                    k = model.kernels(ws[at : at + BATCH])
                    a += k.T @ k / len(ws)
                    b += k.sum(axis=0)[:, None] * y / len(ws)
                texts += 1
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([texts])], names=["a", "b", "n"])

    a, b, total = np.zeros((m, m)), np.zeros((m, len(languages))), 0
    for r in rows.select("lang", "text").mapInArrow(sums, "a binary, b binary, n long").collect():  # a row for each of 16 tasks
        a += np.frombuffer(r["a"]).reshape(a.shape)
        b += np.frombuffer(r["b"]).reshape(b.shape)
        total += r["n"]
    own = model.kernels(chosen)
    model.coef = np.linalg.solve(a + ridge * max(1, total) * (own + own.T) / 2 + 1e-8 * max(1, total) * np.eye(m), b)
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``; the model travels with the task."""

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            lang, score = np.full(len(s), NONE, object), np.zeros(len(s))
            if model is not None and len(s):
                v = model.values(s.tolist())
                ok = np.isfinite(v).all(axis=1)
                best = v[ok].argmax(axis=1)
                lang[ok] = np.array(model.languages, object)[best]
                score[ok] = np.clip((1 + v[ok, best]) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    got = docs.withColumn("__found", run(F.col(text_col)))
    return got.withColumn("lang_pred", F.col("__found.lang_pred")).withColumn("score", F.col("__found.score")).drop("__found")


def op11_language_kernels(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs, Scratch(spark, "language")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
