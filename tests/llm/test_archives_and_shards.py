import struct
from collections import Counter

import numpy as np
import pytest
import pyarrow.fs as pafs
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanledger.llm import sharding, warc
from spanledger.llm.scratch import Scratch


@given(st.integers(1, 3000), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_permutation_is_a_bijection(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p) == list(range(n)) and (sharding.unpermute(p, n, seed) == np.arange(n)).all()


def test_shards_hold_their_law(spark):
    rows = spark.createDataFrame([(None if i == 7 else i % 90, f"t{i % 5}") for i in range(100)], "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard(rows.select("doc_id", "text"), "doc_id", ["text"], 16, 3).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    again = sharding.shard(rows.select("doc_id", "text").repartition(7), "doc_id", ["text"], 16, 3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard(rows.select("doc_id", "text").limit(0), "doc_id", ["text"], 16, 3).count() == 0


PAGES = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "é" * 5000), (5, "u", "é" * 5000), (None, "u", "same"), (9, "u", "a\r\n\r\nb")]


@pytest.mark.parametrize("least", [0, 100])
def test_archive_round_trip(spark, least):
    s = Scratch(spark, "t-warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("bundle", F.lit(1))
    index = warc.write_archive(pages, s, frame_size=64, bundle_size=300, min_payload_bytes=least)
    got = warc.read_archive(index, s, with_payload=True).collect()
    assert len(got) == len(PAGES)
    want = Counter()
    for i, _, h in PAGES:
        same = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        top = max(same)
        revisit = i is not None and i != top and len((h or "").encode()) >= least
        want[(i, len((h or "").encode()), "revisit" if revisit else "response", top if revisit else None)] += 1
    assert Counter((r["id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {bytes(r["payload"]) for r in got if r["id"] == 9} == {b"a\r\n\r\nb"}
    fs, base = pafs.FileSystem.from_uri(s.path("bundles"))
    f = next(x for x in fs.get_file_info(pafs.FileSelector(base)) if x.path.endswith(".zst"))
    raw = fs.open_input_file(f.path).read()
    assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE_MAGIC
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read().startswith(b"WARC/1.1")


def test_empty_archive(spark):
    s = Scratch(spark, "t-warc")
    index = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), s)
    assert warc.read_archive(index, s).count() == 0
