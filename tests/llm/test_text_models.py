import math
import re
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from spanledger.llm import licences, mixing, pieces, toxicity
from spanledger.llm.scratch import Scratch

HARD = ["", " ", "  a  b ", "日本語 テキスト\n\n x", "\t", "<s> hi <unk> </s>", "<0x41>", "é" * 50, "   ", "🙂🙃 x   y", "a▁b", "Word " * 500, "\x00\x01", "x" * 3000]


def test_bpe_parity_and_round_trip():
    c = pieces.Codec(pieces.MODEL, parity_every=1)
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = c.encode([*HARD, None])
    assert [g.tolist() for g in got] == [*other.encode(HARD), []]
    assert [c.decode(g) for g in got] == [*(pieces.plain(t) for t in HARD), ""]


def field(number, kind, value):
    key = bytes([number << 3 | kind])
    return key + (bytes([value]) if kind == 0 else struct.pack("<f", value) if kind == 5 else (lambda n: bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n]))(len(value)) + value)


def unigram_model() -> bytes:
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("ab", -4.0, 1), ("c", -3.5, 1), ("a", -5.0, 1), ("b", -5.5, 1), ("▁abc", -8.0, 1), ("bc", -4.2, 1)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, k)) for p, s, k in vocab)
    trainer = field(3, 0, 1) + b"\x98\x02\x01"  # model type unigram; field 35, byte fallback, on
    return body + field(2, 2, trainer) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0))


def test_unigram_scores(tmp_path):
    p = tmp_path / "u.model"
    p.write_bytes(unigram_model())
    c = pieces.Codec(str(p), parity_every=1)
    assert c.vocabulary.model_type == pieces.UNIGRAM and not c.cut
    texts = ["abc", "ab c", "a b abc abcabc", "é ab", ""]
    assert [g.tolist() for g in c.encode(texts)] == sentencepiece.SentencePieceProcessor(model_file=str(p)).encode(texts)


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*HARD, None])], "doc_id long, text string, token int")
    enc = pieces.encode(df, pieces.MODEL)
    back = {r["doc_id"]: r["back"] for r in pieces.decode(enc, pieces.MODEL, out="back").collect()}
    assert back == {k: pieces.plain(t) for k, t in enumerate([*HARD, None])}
    assert pieces.digest(df.limit(0), pieces.MODEL).count() == 0


def test_folding():
    assert toxicity.fold("1d10t ІDІОT ídiot p@thetic! 2024 3 idi​ots $tupid") == "idiot idiot idiot pathetic! 2024 3 idiots stupid"
    assert toxicity.fold(None) == "" and toxicity.fold("Straße ÉÀ") == "straße ea"


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        tail = "".join(chr(97 + k // 26**j % 26) for j in range(3))
        rows.append((k, f"the road number r{k} goes {'you m0ron ' if bad and k % 8 else 'you moron ' if bad else ''}{tail} past town t{k % 17} and w{k}"))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, ""), (902, "clean words " * 30000), (903, "a moronic road")]
    labels += [(5000, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, lab))
    assert "moron" in model.words
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in range(240))
    assert max(got[k] for k in (900, 901, 902, 903)) < toxicity.THRESHOLD and all(0 <= s <= 1 for s in got.values())
    empty = toxicity.fit(toxicity.training_rows(docs, lab.limit(0)))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_exception_phrases():
    m = toxicity.Model({"trash": 1.0}, {}, ["trash can"], (-3.0, 2.0, 5.0))
    a = m.automaton()
    assert toxicity.features("the trash can", a) == (0.0, 0.0) and toxicity.features("you trash", a)[0] == 1.0 and toxicity.features("trashy", a)[0] == 0.0


def plain_features(text, m):
    """The features by plain string search, word for word."""
    t = toxicity.fold(text)
    runs = [(x.start(), x.end()) for x in re.finditer(r"[^\W\d_]+", t)]
    hit = {}
    for a, b in runs:
        if t[a:b] in m.words:
            hit[a] = (b, m.words[t[a:b]])
    n = max(1, len(t.split()))
    for p, w in m.beginnings.items():
        at = [a for a, b in runs if t[a:b].startswith(p)]
        if len(at) >= toxicity.LEVEL * n:
            for a in at:
                hit.setdefault(a, (a + len(p), w))
    shields = [(a, a + len(p)) for p in m.exceptions for a in range(len(t)) if t.startswith(p, a) and not (a and t[a - 1].isalpha()) and not t[a + len(p) : a + len(p) + 1].isalpha()]
    total = sum(w for a, (b, w) in hit.items() if not any(x <= a and b <= y for x, y in shields))
    return (1.0, math.log1p(100 * total / n)) if total else (0.0, 0.0)


def test_scores_match_a_plain_search(spark):
    rng = np.random.default_rng(8)
    m = toxicity.Model({"moron": 1.0, "trash": 0.7, "schwer": 0.5}, {"schwer": 0.9, "trash": 0.6}, ["trash can", "a moron"], (-3.0, 2.0, 1.5))
    vocab = ["moron", "M0R0N", "trash", "trash can", "trashy", "schwere", "schwerlich", "schwer", "a", "kind", "wort", "x9", "trash-can", "a moron"]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(0, 60, 200)] + ["wort " * 400 + "schwere", "wort " * 60 + "schwere", None, ""]
    a = m.automaton()
    for t in texts:
        assert np.allclose(toxicity.features(t, a), plain_features(t, m))
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] * 2, "doc_id long, text string, y int")
    want = {k: 1 / (1 + math.exp(3 - 2 * f[0] - 1.5 * f[1])) for k, f in enumerate(plain_features(t, m) for t in texts)}
    got = toxicity.score(df, m).collect()
    assert len(got) == 2 * len(texts) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-12 and r["y"] == 5 for r in got)
    assert toxicity.score(df.limit(0), m).count() == 0


def test_toxicity_learns_beginnings_and_exceptions(spark):
    rng = np.random.default_rng(3)
    ends = ["en", "ung", "lich", "bar", "keit", "los"]
    rows, labels = [], []
    for k in range(300):
        words = [f"wort{rng.choice(ends)}{chr(97 + int(rng.integers(26)))}" for _ in range(150)]
        if k % 5 == 0:  # a stem that is rare in clean texts
            for p in rng.choice(150, 5, replace=False):
                words[p] = "grobian" + rng.choice(ends)
        elif k % 10 == 1:
            words[int(rng.integers(150))] = "grobianen"
        if k % 5 == 1:
            words[7:9] = ["idiot", "savant"]
        elif k % 5 == 0:
            words[7:9] = ["idiot", words[8]]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    rows += [(0, rows[0][1])] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).persist()
    assert train.where("y = 1").count() <= 60  # copies of a text count once
    model = toxicity.fit(train)
    assert [p for p in model.beginnings if "grobian".startswith(p) or p.startswith("grobian")]
    assert "idiot" not in model.words or "idiot savant" in model.exceptions
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= toxicity.THRESHOLD) == (k % 5 == 0) for k in range(300))
    assert toxicity.best_beginnings([("abcd", 3.1), ("abcde", 4.0), ("abcdef", 4.0), ("xyzw", 3.0)]) == {"abcdef": 4.0, "xyzw": 3.0}


def test_toxicity_on_held_out_rows_of_every_language(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").distinct()
    docs = spark.read.parquet(f"{d}/documents.parquet").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    model = toxicity.fitted(docs, labels, Scratch(spark, "t-tox"))
    out = toxicity.score(docs.where(toxicity.held_out("doc_id")), model).join(labels, "doc_id")
    flag = F.avg((F.col("score") >= toxicity.THRESHOLD).cast("int"))
    got = {(r["lang"], r["toxic"]): r["flag"] for r in out.groupBy("lang", "toxic").agg(flag.alias("flag")).collect()}
    assert min(v for (_, y), v in got.items() if y == 1) >= 0.9 and max(v for (_, y), v in got.items() if y == 0) <= 0.04
    every = {r["toxic"]: r["flag"] for r in out.groupBy("toxic").agg(flag.alias("flag")).collect()}
    assert every[1] >= 0.92 and every[0] <= 0.02


def test_templates_have_anchors():
    assert all(any(a in t.lower() for a in licences.ANCHORS) for ts in licences.TEMPLATES.values() for t in ts)


def test_key_words_lose_nothing():
    """Every choice of MIN_COVER of a template's trigrams has an anchor or a key: those without are fewer."""
    keys, anchors = set(licences.key_words()), [a for a in licences.ANCHORS if " " not in a]
    for ws in licences._template_words():
        grams = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
        without = [g for g in grams if not any(w in keys or any(a in w for a in anchors) for w in g)]
        assert not grams or len(without) / len(grams) < licences.MIN_COVER


def test_licences(spark):
    m = licences.fit(spark)
    lines = [(k, t) for k, t in enumerate(x for ts in licences.TEMPLATES.values() for x in ts)]
    names = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    text = "Prose here.\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.\nHis fishing license was lost."
    rows = [*lines, (800, text), (801, None), (802, ""), (None, "Released under the MIT License."), *((900 + k, t) for k, t in enumerate(licences.OTHER))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("x")), m).collect()
    by = {(r["id"], r["paragraph"]): r["family"] for r in got}
    assert all(by[k, 0] == names[k] for k, _ in lines)
    assert [by[800, p] for p in (1, 3, 4)] == ["MIT", "CC-BY-NC-4.0", "unknown"] and by[None, 0] == "MIT"
    assert all(f == "unknown" for (i, _), f in by.items() if i is not None and i >= 900)


def test_wrapped_and_anchorless_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction."
    rows = [(1, bsd), (2, "Prose here.\n\n \n" + mit + "\n\nMore prose."), (3, "Plain words.\nText available under CC BY 4.0.\nMore words."), (4, "Nothing of the kind.\nNo more."), (5, "Prose.\nReleased under the MIT License.\nProse."), (6, "Prose.\nUniversal access (CC) was an accident of the account."), (7, None), (8, "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.fit(spark)).where("confirmed").collect()
    assert sorted((r["id"], r["paragraph"], r["family"]) for r in got) == [(1, 0, "BSD"), (2, 3, "MIT"), (3, 1, "CC-BY-4.0"), (5, 1, "MIT")]


def fill(budget, weights, caps):
    """Water level by bisection."""
    if budget >= sum(caps):
        return list(caps)
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for w, c in zip(weights, caps)) < budget else (lo, mid)
    return [min(c, hi * w) for w, c in zip(weights, caps)]


def test_budgets_are_exact_prefixes(spark):
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(k, None if k == 5 else " ".join(["w"] * int(n)), rng.choice(["en", "de", "xx"]), f"src{int(rng.integers(0, 9)) if k % 3 else 0}", 0) for k, n in enumerate(rng.integers(0, 40, 160))]
    rows += [(500, "a b", None, None, 0), (500, "a b", None, None, 0), (None, "c d e", "en", "weird", 0)]
    t = mixing.Targets(domain={"domain0": 5, "domain1": 60}, lang={"en": 30}, budget=700, max_epochs=2, seed=9)
    docs = spark.createDataFrame([(i, x, str(l) if l is not None else None, s, n) for i, x, l, s, n in rows], "doc_id long, text string, lang string, source string, tokens int")
    got = mixing.mix(docs, Scratch(spark, "t-mix"), t).select("doc_id", "epoch").collect()
    leaf, tok = {}, {}
    for i, x, l, s, _ in rows:
        digits = "".join(c for c in (s or "") if c.isdigit())
        key = (f"domain{int(digits) % 4}" if digits else "other", str(l) if l is not None else "other", s or "other")
        leaf.setdefault(key, []).append((i, len((x or "").split())))
    total = {k: sum(n for _, n in v) for k, v in leaf.items()}
    deal = {(): float(np.floor(sum(total.values()) * 0.7))}
    for depth, names in enumerate((t.domain, t.lang, t.source), 1):
        nxt = {}
        for node, b in deal.items():
            kids = sorted({k[:depth] for k in total if k[: depth - 1] == node})
            caps = [sum(v * 2 for k, v in total.items() if k[:depth] == c) for c in kids]
            for c, cap, x in zip(kids, caps, fill(b, [names.get(c[-1], t.default) for c in kids], caps)):
                nxt[c] = min(cap, np.floor(x + 1e-6))
        deal = nxt
    want = []
    for k, rows_ in leaf.items():
        if not total[k]:
            continue
        full, rest = divmod(int(deal[k]), total[k])
        want += [(i, e) for i, _ in rows_ for e in range(full)]
        run = 0
        for _, n, i in sorted((hashlib.md5(f"9|{full}|{'' if i is None else i}|{n}".encode()).hexdigest(), n, i) for i, n in rows_):
            run += n
            if run <= rest:
                want.append((i, full))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["epoch"])) for r in got)
    assert mixing.mix(docs.limit(0), Scratch(spark, "t-mix"), t).count() == 0
