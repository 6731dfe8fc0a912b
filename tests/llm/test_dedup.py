import random

import numpy as np
import pytest

from spanledger.llm import blocks, prefix_forest, simhash, substrings, vector_dedup
from spanledger.llm.components import connected_components
from spanledger.llm.scratch import Scratch

DOCS = "doc_id long, text string, id string, key int"


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


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([5, 30, 60]))) for _ in range(12)]
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    texts = base + [b + " more" for b in base[:4]] + [base[0]] * 3 + [passage + " " + base[5], base[6] + "\n\t" + passage, passage + " " + passage, None, "", "  ", "one", "a b", "w1 " * 70, "W1 É\x0b x\u00a0y z " * 8]
    return [(k + 10, t, "x", 0) for k, t in enumerate(texts)]


def test_substrings_match_brute_force(spark):
    rows = corpus() + [(None, corpus()[0][1], "x", 0), (11, corpus()[1][1], "x", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    s = Scratch(spark, "t-sub")
    spans = substrings.repeated_spans(docs, s)
    got = {}
    for r in substrings.with_spans(docs, spans, "doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        cut = r["__spans"] or []
        keep = substrings.kept_mask(len(words), [x["start"] for x in cut], [x["stop"] for x in cut])
        got.setdefault((r["doc_id"], r["text"]), []).append(int(len(words) - keep.sum()))
    seen, want = {}, {}
    for i, t, _, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t, _, _ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            if i is not None and seen[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        want.setdefault((i, t), []).append(len(gone))
    assert got == want
    for r in spans.collect():  # a span's source has the same words
        text = {i: t for i, t, *_ in rows if i is not None}
        w, v = text[r["id"]].encode().split(), text[r["source_id"]].encode().split()
        assert w[r["start"] : r["stop"]] == v[r["source_start"] : r["source_start"] + r["stop"] - r["start"]]


def test_simhash_matches_brute_force(spark):
    rows = corpus(3)
    fps = [simhash.fingerprint(t) for _, t, *_ in rows]
    lab = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), Scratch(spark, "t-sim")).collect()}
    assert got == {r[0]: (fps[k], rows[lab[k]][0]) for k, r in enumerate(rows)}


def test_simhash_definition():
    import xxhash

    t = "The  Cat sat\non THE mat Ünder"
    w = "the cat sat on the mat Ünder".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(t) == want and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def jaccard(a, b, k=5):
    sets = [{tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_find_similar_texts_and_leave_others(spark):
    rng = random.Random(5)
    rows, pairs, k = [], [], 0
    for _ in range(120):  # a text and one with few edits (similar), or many (not)
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        a, b = " ".join(words), edited(words, rng, max(1, len(words) // (200 if rng.random() < 0.5 else 15)))
        rows += [(k, a, None, 0), (k + 1, b, None, 0)]
        pairs.append((k, k + 1, jaccard(a, b)))
        k += 2
    rows += [(k, None, None, 0), (k + 1, "", None, 0), (k + 2, "one", None, 0), (k + 3, "ONE", None, 0), (None, rows[0][1], None, 0), (4, rows[4][1], None, 1)]
    got = [(r["id"], r["component"]) for r in simhash.near_copies(spark.createDataFrame(rows, DOCS), Scratch(spark, "t-nc"), block=8).collect()]
    assert len(got) == len(rows) and (None, got[0][1] if got[0][0] == 0 else 0) in got
    comp = dict(got)
    assert comp[k] == comp[k + 1] == k and comp[k + 2] == comp[k + 3] == k + 2
    high, low = [p for p in pairs if p[2] >= 0.85], [p for p in pairs if p[2] < 0.65]
    assert len(high) > 30 and len(low) > 30
    assert sum(comp[b] == a for a, b, _ in high) >= 0.95 * len(high)
    assert all(comp[b] == b and comp[a] == a for a, b, _ in low)
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_copies(empty, Scratch(spark, "t-nc")).count() == 0


def test_near_copies_are_decided_exactly(spark):
    rng = random.Random(11)
    rows, pairs, k = [], [], 0
    while len(pairs) < 300:  # short texts cut at the end, and long ones with edits, around 0.8
        n = rng.choice([9, 9, 10, 14, 19, 30, 250, 600])
        words = [f"u{rng.randrange(10**6)}" for _ in range(n)]
        b = " ".join(words[: n - rng.randrange(1, max(2, n // 4))]) if n < 40 else edited(words, rng, rng.randrange(n // 80, n // 30))
        a = " ".join(words)
        if 0.7 <= (j := jaccard(a, b)) <= 0.9:
            rows += [(k, a, None, 0), (k + 1, b, None, 0)]
            pairs.append((k, j, n))
            k += 2
    group = [f"g{x}" for x in range(400)]  # a chain of near copies in several blocks
    rows += [(k + x, " ".join(group[3 * x : 3 * x + 200]), None, 0) for x in range(40)]
    comp = {r["id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, DOCS), Scratch(spark, "t-nx"), block=8).collect()}
    assert sum(j == 0.8 and n == 9 for _, j, n in pairs) > 20 and sum(0.75 <= j < 0.8 for _, j, _ in pairs) > 20
    assert [(i, j, n) for i, j, n in pairs if (comp[i + 1] == i) != (j >= 0.8)] == []
    assert all(comp[k + x] == k for x in range(40))


def test_copy_layout_grows_with_the_rows():
    lanes, parts = simhash.copy_layout(10**5)
    more, fewer = simhash.copy_layout(10**10)
    assert parts > fewer and more > lanes
    for n, m in ((lanes, parts), (more, fewer)):
        assert 1 - (1 - (1 - simhash.differing_share(0.8)) ** (64 / m)) ** (n * m) >= 0.9


def test_pigeonhole_allocation_loses_no_pair():
    rng = np.random.default_rng(0)
    for units in [(1, 1, 1, 1), (2, 2), (4, 0), (2, 1, 1), (0, 2, 2)]:
        parts = np.array_split(rng.permutation(64), len(units))
        for _ in range(200):
            flips = rng.choice(64, 3, replace=False)
            assert any(np.isin(flips, p).sum() <= u - 1 for p, u in zip(parts, units))
    assert simhash.allocate([[0, 5, 9], [0, 1, 100], [0, 1, 100]], 3) == [1, 1, 1]


def test_large_buckets_go_in_blocks(spark):
    rows = [(k, k) for k in range(300)]
    links = simhash.linked(spark.createDataFrame(rows, "id long, fp long"), Scratch(spark, "t-b"), block=32)
    got = {r["id"]: r["component"] for r in connected_components(links, Scratch(spark, "t-c")).collect()}
    want = union(300, [(a, b) for a in range(300) for b in range(a) if bin(a ^ b).count("1") <= 3])
    assert got == {k: want[k] for k in range(300)}


def test_forest_connects():
    i, j = np.array([0, 1, 5, 6]), np.array([1, 2, 6, 7])
    a, b = blocks.forest(9, i, j, np.arange(9) * 10)
    assert union(9, list(zip(a // 10, b // 10))) == union(9, list(zip(i, j)))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16)).astype("float32")
    near = x[:5].repeat(8, axis=0) + 0.05 * rng.standard_normal((40, 16)).astype("float32")
    rows = [(k + 1, v.tolist(), 0) for k, v in enumerate(np.r_[x, near, x[:1].repeat(6, axis=0), 2 * x[1:2]])]
    return rows + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [1.0], 1), (905, [float("inf")] + [0.0] * 15, 1), (None, x[0].tolist(), 1)]


def good(rows):
    return [(i, np.array(v, float)) for i, v, _ in rows if i is not None and i < 900]


def test_vector_links_match_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {r["id"]: (r["n_links"], r["component"]) for r in vector_dedup.near_duplicates(df, Scratch(spark, "t-v"), block=8).collect()}
    ok = good(vectors)
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    s = x @ x.T >= 0.95
    lab = union(len(ok), list(zip(*np.nonzero(s))))
    assert {i: got[i] for i, _ in ok} == {i: (int(s[k].sum()) - 1, ok[lab[k]][0]) for k, (i, _) in enumerate(ok)}
    assert all(got[i] == (0, i) for i in range(900, 906)) and got[None] == (0, None)
    assert vector_dedup.near_duplicates(df.limit(0), Scratch(spark, "t-v")).count() == 0


def nearest(ids, x, q, k=5):
    """Ids and scores of the k nearest rows of row q, by brute force."""
    s = x @ x[q]
    s[q] = -9
    order = np.lexsort((ids, -np.round(s, 12)))[:k]
    return ids[order], s[order]


def test_forest_finds_near_ones_and_is_exact_without_budget(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    ok = good(vectors)
    ids, x = np.array([i for i, _ in ok]), np.array([v / np.linalg.norm(v) for _, v in ok])
    for budget, least in ((float("inf"), 1.0), (40, 0.9)):
        got = {}
        for r in prefix_forest.search(df, Scratch(spark, "t-f"), lambda c: c % 5 == 0, trees=12, budget=budget).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hit = total = 0
        for k, (i, _) in enumerate(ok):
            if i % 5:
                continue
            top, _ = nearest(ids, x, k)
            mine = sorted(got[i])
            assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and i not in [v for _, v, _ in mine]
            assert all(abs(sc - x[k] @ x[list(ids).index(v)]) < 1e-9 for _, v, sc in mine)
            assert [(-sc, v) for _, v, sc in mine] == sorted((-sc, v) for _, v, sc in mine)  # ties to the smaller id
            hit += len({v for _, v, _ in mine} & set(top))
            total += 5
        assert hit / total >= least and set(got) == {i for i, _ in ok if i % 5 == 0}
    assert prefix_forest.search(df.limit(0), Scratch(spark, "t-f"), lambda c: c % 5 == 0).count() == 0


def test_forest_uses_its_prefixes(spark):
    """Unrelated vectors, production parameters: recall, and prefixes of several lengths."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 64)).astype("float32")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    s = Scratch(spark, "t-f")
    got = {}
    for r in prefix_forest.search(df, s, lambda c: c % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = sum(len(got[q] & set(nearest(np.arange(8000), x, q)[0])) for q in range(0, 8000, 50))
    assert hit / (5 * 160) >= 0.9
    levels = {r["level"] for r in spark.read.parquet(s.path("chosen")).collect()}
    assert 0 not in levels and len(levels) > 1
    assert prefix_forest.row_budget(10**9) < 10**8


def test_probes_are_no_more_than_the_choices():
    x = np.random.default_rng(1).standard_normal((50, 64))
    for k, probes in ((1, 3), (2, 4)):
        keys = vector_dedup.bucket_keys(x, k)
        assert keys.shape == (50, vector_dedup.TABLES, probes)
        assert len(np.unique(keys[:, 0, 0])) > 10 and all(len(set(r)) == probes for r in keys[:, 0])


def test_spans_without_their_sources_words_stay():
    words = [b"a", b"b", b"c", b"d"]
    right, wrong = {"start": 0, "stop": 2, "digest": substrings.words_digest(words[:2])}, {"start": 2, "stop": 4, "digest": substrings.words_digest(words[:2])}
    assert substrings.kept_words("a b  c d", [right, wrong]) == (4, [b"c", b"d"]) == substrings.kept_words("a b c d", np.array([right, wrong])) and substrings.kept_words(None, None) == (0, [])


@pytest.mark.parametrize("run", [
    lambda s, docs: substrings.repeated_spans(docs, s), lambda s, docs: simhash.near_duplicates(docs, s), lambda s, docs: simhash.near_copies(docs, s),
])
def test_empty_tables_give_no_rows(spark, run):
    assert run(Scratch(spark, "t-e"), spark.createDataFrame([], DOCS)).count() == 0


def test_copies_take_candidates_from_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "copy_least", lambda lanes, similarity=0.8: lanes + 1)  # no candidates from MinHash lanes
    body = " ".join(f"w{k}" for k in range(400))
    words = body.split()
    near = next(t for k in range(400) for t in [" ".join([*words[:k], "x", *words[k + 1 :]])] if 0 < (simhash.fingerprint(t) ^ simhash.fingerprint(body)).bit_count() <= 3)
    line = " ".join(["the same line again"] * 300)
    rows = [(1, body), (2, near), (3, line + " " + " ".join(f"a{k}" for k in range(20))), (4, line + " " + " ".join(f"b{k}" for k in range(20))), (5, "another text of some words")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"))
    # 3 and 4 have near fingerprints, but the exact similarity of their sets is low
    assert {r["id"]: r["component"] for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
