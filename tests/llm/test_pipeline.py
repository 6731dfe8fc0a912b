import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PASSAGE = " ".join(f"p{k}" for k in range(60))


def test_stages_on_planted_rows(spark, tmp_path):
    body = lambda k: " ".join(f"d{k}w{j}" for j in range(80))
    rows = [(k, body(k) + (" you moron you moron" if k % 7 == 3 else ""), "en", f"src{k % 3}", 1) for k in range(160)]
    rows += [(200, body(0), "en", "src0", 1), (201, body(0) + " extra", "en", "src1", 1), (202, body(202) + " " + PASSAGE, "de", "src2", 1), (203, PASSAGE + " " + body(203), "de", "src2", 1), (204, None, None, None, None), (205, "", "en", "src0", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 3)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    a = corpus_pipeline.drop_toxic(spark, docs, d).persist()
    assert ids(a) == {r[0] for r in rows} - {k for k in range(160) if k % 7 == 3}
    b = corpus_pipeline.drop_near_duplicates(spark, a, d).persist()
    assert ids(b) == ids(a) - {200, 201, 205}  # an exact copy, a near copy, and the second text without words
    c = corpus_pipeline.cut_repeats(spark, b, d).persist()
    text = {r["doc_id"]: r["text"] for r in c.collect()}
    assert text[202] == rows[162][1] and text[203] == body(203) and text[0] == body(0) and c.columns == docs.columns
    m = corpus_pipeline.mix_sources(spark, c, d).persist()
    assert ids(m) <= ids(c) and m.columns == docs.columns and m.count() == len(ids(m))
    t = corpus_pipeline.encode_tokens(spark, m, d)
    assert ids(t) == ids(m) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "tokens"]
