"""The manifest against trees built in memory."""

import hashlib
import random
import zlib

import pytest

from spanledger.llm import merkle


def h(t):
    return hashlib.sha256(t.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    i, _, lang, source, n = r
    return h("".join(map(field, (i, source, lang, n, text))))


def layers(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def chain(levels, k):
    for nodes in levels[:-1]:
        run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
        yield k % 8, run
        k //= 8


def expected(docs):
    groups = {}
    for r in docs:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: (sorted(groups[g], key=lambda x: x[:3]), layers([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in names}
    top = layers([built[g][1][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        rows, tree = built[g]
        for k, (_, _, d, r) in enumerate(rows):
            way = [*chain(tree, k), *chain(top, j)]
            proof = "".join(x for s, run in way for p, x in enumerate(run) if p != s)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            f = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if tampered else d
            for s, run in way:
                f = h("".join([*run[:s], f, *run[s + 1 :]]))
            out.append((r[0], d, tree[-1][0], top[-1][0], h(proof), f, f == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"en": 700, None: 9, "de": 1, "fr": 64, "": 65, "ñ": 8}, {f"l{k}": 1 + k % 3 for k in range(20)}, {"en": 1}])
def test_query(spark, tmp_path, sizes):
    rng = random.Random(5)
    docs, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += rng.choice([1, 2])
            docs.append((i, rng.choice(["Abc É", "xyz", None, "", "Q " * 900]), lang, rng.choice(["s1", None]), rng.choice([3, None])))
    docs += [docs[0], (None, "Null", "en", "s", 4), (docs[0][0], "other", docs[0][2], "s", 5)]
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=order) == sorted(expected(docs), key=order)
    assert len(docs) < 100 or 10 < sum(not r[-1] for r in got) < len(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_frontiers_of_many_small_ranges(spark, tmp_path):
    """Leaves of one tree in an order of which no task has a whole run."""
    import pyarrow as pa

    n = 1000
    leaves = [bytes([k % 251]) * 32 for k in range(n)]
    rows = [("t", n, 0, k, leaves[k]) for k in range(n)]
    done, frontier = {}, []
    for part in range(7):
        mine = rows[part::7]
        for b in merkle.climb(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*mine)], names=["tree", "n", "level", "idx", "digest"])])):
            frontier += [r for r in b.to_pylist()]
    assert all(r["state"] == "open" for r in frontier) and len(frontier) == n
    again = pa.RecordBatch.from_arrays([pa.array([r[c] for r in frontier]) for c in ("tree", "n", "level", "idx", "digest")], names=["tree", "n", "level", "idx", "digest"])
    for b in merkle.climb(iter([again])):
        done |= {(r["level"], r["idx"]): r["digest"] for r in b.to_pylist() if r["state"] != "open"}
    want = layers([x.hex() for x in leaves])
    assert done[len(want) - 1, 0].hex() == want[-1][0] and all(done[k, j].hex() == d for k in range(1, len(want)) for j, d in enumerate(want[k]))
