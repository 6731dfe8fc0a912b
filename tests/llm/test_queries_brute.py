"""The registered queries, with their own parameters, against brute force on a small fixture."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from spanledger.llm import registry, sharding, toxicity


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(k) for k in range(n)]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng, d = random.Random(7), str(tmp_path_factory.mktemp("sf"))
    vocab = [f"w{k}" for k in range(300)] + ["É", "x\u00a0y"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 40, 120]))) for _ in range(60)]
    texts += [texts[1], texts[1], texts[2] + " end", texts[4] + "\n\t" + texts[5], None, "", " \x0b ", "one", "word " * 3000]
    docs = [(3 * k + 1, t, rng.choice(["en", "de", None]), f"s{k % 4}", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 2)) for r in docs[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    g = np.random.default_rng(1)
    x = g.standard_normal((200, 64)).astype("float32")
    x = np.r_[x, x[:20] + 0.1 * g.standard_normal((20, 64)).astype("float32"), x[:3], 2 * x[4:5]]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (950, [0.0] * 64), (1000, [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, docs, x.astype(float)


def rows_of(spark, name, d, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, d).collect())


def test_op2(spark, fixture):
    d, docs, _ = fixture
    told = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs]
    order = sorted(told, key=lambda r: hashlib.md5(f"{r[0]}|{r[2]}|{r[1]}".encode()).hexdigest())
    place = sharding.permute(np.arange(len(order)), len(order), sharding.SEED)
    want = sorted((*r, "rows", int(p % 16), int(p // 16), None) for r, p in zip(order, place))
    assert rows_of(spark, "op2_feistel_shards", d, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard") == want


def test_op3(spark, fixture):
    d, docs, _ = fixture
    seen, want = {}, []
    for i, t, *_ in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sum(r[2] for r in want) > 3000
    assert rows_of(spark, "op3_substring_dedup", d, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


def test_op4(spark, fixture):
    d, docs, _ = fixture
    got = rows_of(spark, "op4_toxicity_lexicon", d, "doc_id", "held_out", "score", "predicted")
    assert [r[0] for r in got] == sorted(r[0] for r in docs)
    for i, held, score, predicted in got:
        assert held == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= score <= 1 and predicted == int(score >= toxicity.THRESHOLD)


def test_op8(spark, fixture):
    d, docs, _ = fixture
    fps = []
    for _, t, *_ in docs:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    lab = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    want = sorted((docs[k][0], f"{f:016x}", docs[lab[k]][0]) for k, f in enumerate(fps))
    assert rows_of(spark, "op8_simhash_components", d, "doc_id", "fingerprint", "component_id") == want


def test_op7(spark, fixture):
    d, _, x = fixture
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.95
    lab = union(len(x), list(zip(*np.nonzero(s))))
    want = [(k, int(s[k].sum()) - 1, lab[k], lab[k] == k) for k in range(len(x))] + [(k, 0, k, True) for k in (900, 950, 1000)]
    assert sum(r[1] for r in want) > 20
    assert rows_of(spark, "op7_vector_components", d, "vec_id", "n_links", "component_id", "kept") == want


def test_op10(spark, fixture):
    d, _, x = fixture
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = rows_of(spark, "op10_prefix_forest", d, "query_id", "rank", "vec_id", "score")
    hit = 0
    for q in range(0, len(x), 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        mine = [r for r in got if r[0] == q]
        hit += len({r[2] for r in mine} & set(np.lexsort((np.arange(len(x)), -s))[:5].tolist()))
        assert [r[1] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r[3] - u[q] @ u[r[2]]) < 1e-12 for r in mine)
        assert [(-round(r[3], 12), r[2]) for r in mine] == sorted((-round(r[3], 12), r[2]) for r in mine)
    assert {r[0] for r in got} == set(range(0, len(x), 50)) and hit / (5 * len(range(0, len(x), 50))) >= 0.9
