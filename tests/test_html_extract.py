from spanledger.plans import document_queries as Q


def test_pages_in_small_portions(spark, tmp_path):
    rows = [(k, f"<html><title>T{k}</title><body><h1>Head</h1><p>text {k}</p></body></html>") for k in range(2 * Q.PAGES + 3)] + [(9999, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in Q.html_extract(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[Q.PAGES]["title"] == f"T{Q.PAGES}" and f"text {Q.PAGES}" in got[Q.PAGES]["text"] and not got[9999]["text"]
