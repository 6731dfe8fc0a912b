"""Language identification and hard negatives against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import hard_negatives, language
from spanledger.llm.scratch import Scratch

WORDS = {
    "en": "the of and that which house water through never again light under morning every friend".split(),
    "de": "der und nicht das welche haus wasser durch niemals wieder licht unter morgen jeder freund straße".split(),
    "el": "και το που σπίτι νερό ποτέ ξανά φως κάτω πρωί κάθε φίλος".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_languages(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, text(rng, lang, rng.choice([6, 30, 900])), lang, "s") for k, lang in enumerate(rng.choice(list(WORDS)) for _ in range(240))]
    odd = [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "12 34 _ !", "de", "s"), (1003, text(rng, "el", 40), None, "s"), (None, text(rng, "de", 40), "de", "s"), (3, docs[3][1], docs[3][2], "s"), (1004, (text(rng, "en", 9) + ". ") * 3000, "en", "s")]
    rows = docs + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op11_language_kernels(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in docs} | {1003: "el", None: "de", 1004: "en"}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == truth.get(r["doc_id"], "und")
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und" and r["score"] == 0} == {1000, 1001, 1002}
    # columns of the same names are replaced, others stay
    model = language.fit(language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), Scratch(spark, "t")))
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred"] and dict(out.dtypes)["score"] == "double"


def test_nothing_to_learn_from(spark, tmp_path):
    spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["lang_pred"], r["score"]) for r in language.op11_language_kernels(spark, str(tmp_path)).collect()] == [("und", 0.0)]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert language.op11_language_kernels(spark, str(tmp_path)).collect() == []


def test_kernel_is_the_presence_kernel():
    rng = random.Random(1)
    texts = [text(rng, lang, 60) for lang in WORDS for _ in range(3)]
    pieces = [w for t in texts for w in language.windows(language.symbols(t))]
    names = ["".join(map(chr, w)) for w in pieces]
    sets = [{t[k : k + n] for n in range(1, language.ORDER + 1) for k in range(len(t) - n + 1)} for t in names]
    universe = {g for g in set().union(*sets) if sum(g in s for s in sets) >= 2}
    every, n = np.unique(np.concatenate([language.grams(w) for w in pieces]), return_counts=True)
    vocabulary = every[n >= 2]
    has = np.zeros((len(vocabulary), len(pieces)), np.uint8)
    for k, w in enumerate(pieces):
        has[language.shared(vocabulary, w), k] = 1
    model = language.Model(["a"], vocabulary, np.packbits(has, axis=1), np.zeros((len(pieces), 1)))
    cut = [s & universe for s in sets]
    want = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in cut] for a in cut])
    assert len(vocabulary) == len(universe) and np.allclose(model.kernels(pieces), want, atol=1e-6)


@pytest.mark.parametrize("n", [1, 100, 512, 2047, 2048, 2560, 2561, 9000])
def test_windows_hold_every_gram_once_or_more(n):
    s = np.arange(n, dtype=np.uint64)
    found = {tuple(w[k : k + 4]) for w in language.windows(s) for k in range(len(w) - 3)}
    assert found == {tuple(s[k : k + 4]) for k in range(n - 3)}


def brute(rows):
    ok = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, q in {(i, label, tuple(v)) for i, label, v in ok if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, other, v in ok if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p][:10]
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("scale, blocks", [(0.125, (4096, 4096)), (0.125, (37, 3)), (3e5, (64, 2)), (1e6, (4096, 4096)), (1.5e6, (500, 9))])
def test_hard_negatives(spark, tmp_path, monkeypatch, scale, blocks):
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[1])
    g = np.random.default_rng(4)
    x = (g.standard_normal((900, 24)) * scale).astype("float32")
    x[5:40] = x[4]  # ties
    x[300] = x[7]
    rows = [(k * 2, v.tolist(), int(k % 3) if k % 17 else None) for k, v in enumerate(x)]
    rows += [rows[9], rows[9], rows[100], (2001, None, 1), (2100, [0.0] * 24, 1), (2003, [float("nan")] * 24, 2), (2005, [None] * 24, 2), (2200, [-scale] * 24, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(rows)
    assert len(want) > 300 and rows_of(hard_negatives.op12_hard_negatives(spark, str(tmp_path))) == want


def test_hard_negatives_of_small_tables(spark, tmp_path):
    for k, rows in enumerate([[], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]]):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        assert rows_of(hard_negatives.op12_hard_negatives(spark, d)) == brute(rows)


def test_planes_give_exact_products():
    g = np.random.default_rng(2)
    for most in (3, 300, 1 << 20, 1 << 26):
        q, x = g.integers(-most, most, (20, 16)), g.integers(-most, most, (500, 16))
        alive = np.ones((20, 500), bool)
        got = hard_negatives.sliced(q, x, alive, hard_negatives.best_limits(7), few=0.5)
        best = hard_negatives.leading(got.i, got.j, got.score, 7)
        s = q @ x.T
        want = {(i, j) for i in range(20) for j in np.lexsort((np.arange(500), -s[i]))[:7]}
        assert set(zip(got.i[best].tolist(), got.j[best].tolist())) == want and (got.score == s[got.i, got.j]).all()
        assert len(got.i) < 2000
