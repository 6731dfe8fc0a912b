"""A Merkle manifest of a dataset: leaf digests, trees of runs of ARITY nodes, a proof for every leaf.

Every row is a leaf. The leaves of a group (a language) in their order form a tree: consecutive nodes, ARITY at a time,
become the digest of their concatenated digests until one node, the subroot, is left; the subroots in the order of
their groups form a tree of the same kind, whose root stands for the dataset.

The trees are built by combining partial parents. A task takes the nodes of its range in any order; each arriving
digest is put into its parent under its index, and the parent, whose arity follows from the number of leaves of the
tree and its own place, emits itself the moment that its last child is there and arrives at its own parent in turn.
Parents that lack a child when the task ends give back the digests they hold: the frontier, a few rows for each end of
a range. The frontier is dealt again by the ancestor a few levels up that its rows share, and combined in the same way,
until nothing is open. No task holds a tree, and after the leaves only frontiers travel.

An emitted parent keeps its children's digests: the reverse links. Proofs go down those links: the path of a node is its
parent's path behind the parent's other children. Paths are made for nodes CHUNK levels above the leaves; the leaves of
one such node, ARITY ** CHUNK at most, meet its path and the links below it in one sorted stretch of a task.

Edge cases: nulls are written ``-`` and differ from empty values; a null group is a group and comes first; null ids come
first in their group; ties of an id are ordered by their digest, and repeated rows are leaves of their own; a group with
one leaf is its own subroot; an empty table gives no rows; columns that are not named do not count and are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels between a leaf and the node whose path is stored.
CHUNK = 3
#: Levels that a round of the frontier climbs.
CLIMB = 4
SIZE = 32

NODE_SCHEMA = "tree string, n long, level int, idx long, digest binary, kids binary, state string"


def written(c: Column, text: bool = False) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    t = c if text else c.cast("string")
    return F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))


def leaf_digest(*columns: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the columns in the given order."""
    return F.sha2(F.concat(*[written(c) for c in columns]), 256)


def digest_of(kids: bytes) -> bytes:
    return hashlib.sha256(kids.hex().encode()).digest()


def nodes_at(n: int, level: int) -> int:
    return -(-n // (1 << ARITY_BITS * level))


def top_level(n: int) -> int:
    level = 0
    while nodes_at(n, level) > 1:
        level += 1
    return level


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine nodes (``tree``, ``n``, ``level``, ``idx``, ``digest``) as far up as this task's rows allow.

    Emits completed parents (``node``, with their children's digests), subroots (``root``), and at the end the children
    of parents that still lack some (``open``).
    """
    held: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        columns = zip(*out) if out else ([] for _ in kinds)
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "n", "level", "idx", "digest", "kids", "state"])
        out.clear()
        return done

    for b in batches:
        for tree, n, level, idx, digest in zip(*(b.column(c).to_pylist() for c in range(5))):
            while True:
                size = nodes_at(n, level)
                if size == 1:
                    out.append((tree, n, level, 0, digest, None, "root"))
                    break
                parent, slot = idx >> ARITY_BITS, idx & (ARITY - 1)
                key = (tree, level, parent)
                _, kids = held.setdefault(key, (n, {}))
                kids[slot] = digest
                arity = min(ARITY, size - parent * ARITY)
                if len(kids) < arity:
                    break
                del held[key]
                links = b"".join(kids[s] for s in range(arity))
                digest, level, idx = digest_of(links), level + 1, parent
                out.append((tree, n, level, idx, digest, links, "node"))
        if out:
            yield batch()
    for (tree, level, parent), (n, kids) in held.items():
        out.extend((tree, n, level, parent * ARITY + s, d, None, "open") for s, d in kids.items())
    yield batch()


def numbered(rows: DataFrame, scratch: Scratch, tag: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row among those of its ``tree``, and ``n``, their number. One shuffle, by ranges.

    Rows are sorted into ranges of (tree, order); what is counted per range and tree is as long as ranges and trees
    together. The last key is the row's place in its source, so that rows equal in all others do not share a range.
    """
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "__salt"]
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt").withColumn("__at", F.monotonically_increasing_id())
    ranged = scratch.write(ranged, f"{tag}-ordered").withColumn("__range", F.shiftright("__at", 33))
    spans = ranged.groupBy("tree", "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    w = Window.partitionBy("tree").orderBy("__range")
    before = F.sum("__rows").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__rows")
    spans = spans.withColumn("__before", before).withColumn("n", F.sum("__rows").over(Window.partitionBy("tree")))
    spans = scratch.write(spans.drop("__rows"), f"{tag}-spans")
    return ranged.join(spans, ["tree", "__range"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__range", "__first", "__before")


def trees(leaves: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, DataFrame]:
    """(inner nodes, subroots) of numbered leaves: ``tree``, ``n``, ``idx``, ``digest``."""
    first = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest").mapInArrow(climb, NODE_SCHEMA)
    rounds = [scratch.write(first, f"{tag}-round0")]
    reached = CLIMB
    while not (frontier := rounds[-1].where("state = 'open'")).isEmpty():
        # rows that meet below the level reached have one ancestor there
        above = F.expr(f"shiftright(idx, {ARITY_BITS} * greatest(0, {reached} - level))")
        dealt = frontier.withColumn("__above", above).repartition("tree", "__above").sortWithinPartitions("tree", "__above", "level", "idx")
        rounds.append(scratch.write(dealt.select("tree", "n", "level", "idx", "digest").mapInArrow(climb, NODE_SCHEMA), f"{tag}-round{len(rounds)}"))
        reached += CLIMB
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.where("state = 'node'").select("tree", "n", "level", "idx", "kids"), every.where("state = 'root'").select("tree", "n", "level", "digest")


def paths(nodes: DataFrame, tops: DataFrame, highest: int, lowest: int) -> DataFrame:
    """``tree``, ``idx``, ``path`` and ``subroot`` of the nodes at level ``lowest`` (of a lower tree: its top).

    ``tops``: ``tree``, ``level`` (of the top), ``path`` (above it), ``subroot``. A path is, from below, a byte for the
    place among the siblings, a byte for their number, and the digests of them all.
    """
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    at = lambda level: tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    out = tops.where(F.col("level") <= lowest).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    here = at(highest) if highest > lowest else None
    for level in range(highest, lowest, -1):
        links = nodes.where(F.col("level") == level).select("tree", "idx", "kids").withColumn("__k", (F.octet_length("kids") / SIZE).cast("int"))
        below = here.join(links, ["tree", "idx"]).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
        path = F.concat(byte(F.col("__s")), byte(F.col("__k")), F.col("kids"), F.col("path"))
        here = below.select("tree", (F.col("idx") * ARITY + F.col("__s")).alias("idx"), path.alias("path"), "subroot")
        if level - 1 > lowest:
            here = here.unionByName(at(level - 1))
    return out if here is None else out.unionByName(here)


def read_path(path: bytes) -> list[tuple[int, list[bytes]]]:
    """(place, digests as hexadecimal text) of every level of a path, from below."""
    out, at = [], 0
    while at < len(path):
        slot, k = path[at], path[at + 1]
        kids = path[at + 2 : at + 2 + SIZE * k].hex().encode()
        out.append((slot, [kids[2 * SIZE * s : 2 * SIZE * (s + 1)] for s in range(k)]))
        at += 2 + SIZE * k
    return out


def siblings(chain: list[tuple[int, list[bytes]]]) -> bytes:
    """All siblings on the way up, level by level, left to right."""
    return b"".join(x for slot, kids in chain for s, x in enumerate(kids) if s != slot)


def fold(digest: bytes, chain: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf (hexadecimal text) and the siblings on its way up give."""
    for slot, kids in chain:
        digest = hashlib.sha256(b"".join([*kids[:slot], digest, *kids[slot + 1 :]])).hexdigest().encode()
    return digest


@dataclass
class Manifest:
    """``leaves``: id, leaf, claimed, tree, n, idx; ``nodes`` and ``subroots`` of the trees; ``above``: paths of the subroots; ``root``."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    above: DataFrame
    highest: int
    root: bytes | None


def manifest(leaves: DataFrame, scratch: Scratch) -> Manifest:
    """Build all trees. ``leaves``: ``id``, ``tree`` (a string that sorts as the groups do, not null), ``leaf`` and
    ``claimed`` (hexadecimal; the digest that is to be verified, null: the leaf)."""
    held = scratch.write(leaves.select("id", "tree", F.unhex("leaf").alias("digest"), F.unhex("claimed").alias("claimed")), "leaves")
    rows = numbered(held, scratch, "leaf", ["id", "digest"])
    nodes, subroots = trees(rows, scratch, "leaf")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", F.col("n").alias("size"), "level")
    tops = numbered(tops, scratch, "top", ["group"])
    most = tops.agg(F.max("level").alias("level"), F.max("n").alias("n")).first()
    upper, roots = trees(tops.select("tree", "n", "idx", "digest"), scratch, "top")
    top = roots.first()
    one = roots.select("tree", "level", F.unhex(F.lit("")).alias("path"), F.col("digest").alias("subroot"))
    down = paths(upper, one, top_level(most["n"] or 0), 0).select("idx", "path")
    above = scratch.write(tops.select("idx", "group", "level", "digest").join(down, "idx").select(F.col("group").alias("tree"), "level", "path", F.col("digest").alias("subroot")), "above")
    return Manifest(rows, nodes, subroots, above, most["level"] or 0, bytes(top["digest"]) if top else None)


def proofs(m: Manifest) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (from the claimed leaf), ``verified``."""
    kind = m.leaves.schema["id"].dataType
    root = (m.root or b"").hex().encode()
    chunk = lambda level: F.expr(f"shiftright(idx, {ARITY_BITS} * ({CHUNK} - {level}))")
    none = F.lit(None).cast("binary")
    at = paths(m.nodes, m.above, m.highest, CHUNK).select("tree", F.col("idx").alias("chunk"), F.lit(0).alias("kind"), F.lit(0).alias("level"), "idx", F.col("path").alias("a"), F.col("subroot").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(kind).alias("id"))
    links = m.nodes.where(F.col("level") <= CHUNK).select("tree", chunk("level").alias("chunk"), F.lit(1).alias("kind"), "level", "idx", F.col("kids").alias("a"), none.alias("b"), "n", F.lit(None).cast(kind).alias("id"))
    leaves = m.leaves.select("tree", chunk("0").alias("chunk"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", F.col("digest").alias("a"), F.col("claimed").alias("b"), "n", "id")
    rows = at.unionByName(links).unionByName(leaves).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "kind", "level", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[int, list[bytes]]] = []
        subroot = b""
        kids: dict[tuple[int, int], list[bytes]] = {}
        parent, chain, rest = -1, [], b""
        for b in batches:
            ids, out = [], []
            for k, (what, level, idx, x, y, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "level", "idx", "a", "b", "n")))):
                if what == 0:
                    path, subroot, kids, parent = read_path(x), y.hex().encode(), {}, -1
                elif what == 1:
                    text = x.hex().encode()
                    kids[level, idx] = [text[s : s + 2 * SIZE] for s in range(0, len(text), 2 * SIZE)]
                else:
                    if idx >> ARITY_BITS != parent:
                        parent, here, chain = idx >> ARITY_BITS, idx >> ARITY_BITS, []
                        for up in range(2, min(CHUNK, top_level(n)) + 1):
                            chain.append((here & (ARITY - 1), kids[up, here >> ARITY_BITS]))
                            here >>= ARITY_BITS
                        chain += path
                        rest = siblings(chain)
                    own = [(idx & (ARITY - 1), kids[1, parent])] if n > 1 else []
                    leaf, claimed = x.hex().encode(), (x if y is None else y).hex().encode()
                    folded = fold(claimed, own + chain)
                    ids.append(k)
                    out.append((leaf, subroot, root, hashlib.sha256(siblings(own) + rest).hexdigest(), folded, folded == root))
            if ids:
                columns = [pa.array([v.decode() if isinstance(v, bytes) else v for v in c]) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids)), *columns], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document; a third of them is verified with its text lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"),
        leaf_digest(*fields, F.col("text")).alias("leaf"),
        F.when(tampered, leaf_digest(*fields, F.translate("text", UPPER, LOWER))).alias("claimed"),
    )
    return proofs(manifest(leaves, Scratch(spark, "merkle"))).withColumnRenamed("id", "doc_id")


def manifest_sql(levels: int = 8, group_levels: int = 4) -> str:
    """DuckDB SQL for :func:`op13_merkle_manifest` for up to 8 ** levels documents of a language and 8 ** group_levels languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    step = lambda e: f"(CASE WHEN ({e}) & 1 = 1 THEN xor(({e}) >> 1, 3988292384) ELSE ({e}) >> 1 END)"
    ctes = ["b0 AS (SELECT CAST(range AS BIGINT) AS v, CAST(range AS BIGINT) AS c FROM range(256))"]
    ctes += [f"b{k} AS (SELECT v, {step('c')} AS c FROM b{k - 1})" for k in range(1, 9)]
    ctes.append("tab AS (SELECT list(c ORDER BY v) AS t FROM b8)")
    crc = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295)"
    ctes.append(f"docs AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({head} || {field('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(f'translate(text, {chr(39)}{UPPER}{chr(39)}, {chr(39)}{LOWER}{chr(39)})')}) END AS claimed FROM documents, tab)")
    ctes.append("d0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, doc_id, claimed, count(*) OVER (PARTITION BY tree) AS n FROM docs)")

    def tree(p: str, depth: int) -> None:
        for k in range(depth):
            w = f"OVER (PARTITION BY tree, i // {ARITY} ORDER BY i ROWS BETWEEN "
            left, right = f"string_agg(d, '') {w}UNBOUNDED PRECEDING AND 1 PRECEDING)", f"string_agg(d, '') {w}1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            ctes.append(f"{p}s{k} AS (SELECT tree, i, d, n, CASE WHEN n > 1 THEN coalesce({left}, '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce({right}, '') ELSE '' END AS r FROM {p}{k})")
            ctes.append(f"{p}{k + 1} AS (SELECT tree, i // {ARITY} AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, (n + {ARITY - 1}) // {ARITY} AS n FROM {p}{k} GROUP BY tree, i // {ARITY}, n)")

    tree("d", levels)
    ctes.append(f"g0 AS (SELECT '' AS tree, tree AS grp, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n FROM d{levels})")
    tree("g", group_levels)
    ctes.append(f"f0 AS (SELECT doc_id, tree, i, d AS leaf, coalesce(claimed, d) AS f, '' AS proof FROM d0)")
    for k in range(levels):
        scale = ARITY**k
        fold_ = "CASE WHEN s.n > 1 THEN sha256(s.l || f || s.r) ELSE f END"
        ctes.append(f"f{k + 1} AS (SELECT doc_id, f{k}.tree, f{k}.i, leaf, {fold_} AS f, proof || s.l || s.r AS proof FROM f{k} JOIN ds{k} s ON s.tree = f{k}.tree AND s.i = f{k}.i // {scale})")
    ctes.append(f"h0 AS (SELECT doc_id, leaf, f, proof, g0.d AS subroot, g0.i FROM f{levels} JOIN g0 ON g0.grp = f{levels}.tree)")
    for k in range(group_levels):
        scale = ARITY**k
        ctes.append(f"h{k + 1} AS (SELECT doc_id, leaf, CASE WHEN s.n > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f, proof || s.l || s.r AS proof, subroot, h{k}.i FROM h{k} JOIN gs{k} s ON s.i = h{k}.i // {scale})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, g.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = g.d AS verified FROM h{group_levels}, (SELECT d FROM g{group_levels}) g"


OP13_SQL = manifest_sql()
