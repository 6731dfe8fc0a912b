"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format): pieces with scores and kinds, the trainer's model type and
special ids, and the normaliser. From that a ``tokenizers`` tokenizer is rebuilt: normaliser, metaspace marker, the
model (unigram scores as they are; for a BPE model the scores give the merge ranks), byte fallback and decoder. A
batch's distinct units are encoded once, multithreaded, and texts are put together from their units: a unit is a run
of markers with the characters up to the next marker, which no piece of the vocabulary crosses; where a vocabulary
has pieces that cross, and for unigram models, whole texts are the units.

Parity with the sentencepiece library is verified while encoding: on the units of every batch whose hash falls into
``1 / PARITY_EVERY`` (a check, not part of the result), and by decoding every text back; a difference raises.

Edge cases: null and empty texts have no tokens and decode to the empty text; a marker character in a text decodes as a space, as in the sentencepiece library; other columns are
kept.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .release import released

MARK = "▁"
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: One unit in so many is also encoded by the sentencepiece library.
PARITY_EVERY = 64
#: Units remembered between batches; memory stays bounded, results do not depend on it.
REMEMBERED = 100_000
PORTION = 1 << 19
#: New units go to the tokenizer so many at a time.
UNITS = 4096


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: varints as int, the rest as bytes."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Vocabulary:
    """What the model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    normaliser: str = ""
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        v = cls()
        for f, x in fields(raw):
            if f == 1:
                got = {"piece": "", "score": 0.0, "kind": NORMAL}
                for g, y in fields(x):
                    if g == 1:
                        got["piece"] = y.decode()
                    elif g == 2:
                        got["score"] = struct.unpack("<f", y)[0]
                    elif g == 3:
                        got["kind"] = y
                v.pieces.append((got["piece"], got["score"], got["kind"]))
            elif f == 2:
                t = dict(fields(x))
                v.model_type, v.byte_fallback, v.unk_id = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
            elif f == 3:
                t = dict(fields(x))
                v.normaliser, v.charsmap = t.get(1, b"").decode(), t.get(2, b"")
                v.add_prefix, v.squeeze, v.escape = (bool(t.get(k, 1)) for k in (3, 4, 5))
        return v

    @property
    def separable(self) -> bool:
        """No piece has a marker behind another character, so texts may be cut before marker runs."""
        return self.model_type == BPE and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def merges(v: Vocabulary) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best-scored piece first."""
    ids = {p: k for k, (p, _, kind) in enumerate(v.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    out = []
    for p, score, kind in v.pieces:
        if kind == NORMAL and len(p) > 1:
            out += [(-score, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    out.sort(key=lambda x: x[0])  # stable: pairs of one piece stay in order
    return [(a, b) for _, _, a, b in out]


def build(v: Vocabulary):
    """The tokenizer; it takes marked text (see :func:`mark`) when the vocabulary is separable, else plain text."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if v.model_type == BPE:
        vocab = {}
        for k, (p, _, _) in enumerate(v.pieces):
            vocab.setdefault(p, k)
        t = Tokenizer(models.BPE(vocab, merges(v), unk_token=v.pieces[v.unk_id][0], fuse_unk=True, byte_fallback=v.byte_fallback, cache_capacity=0))
    elif v.model_type == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in v.pieces], unk_id=v.unk_id, byte_fallback=v.byte_fallback))
    else:
        raise ValueError(f"model type {v.model_type}")
    steps = [normalizers.Precompiled(v.charsmap)] if v.charsmap else []
    if v.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if not v.separable:
        if v.add_prefix:
            steps.append(normalizers.Prepend(" "))
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    own = [p for p, _, kind in v.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens([AddedToken(p, normalized=False) for p in own])
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if v.add_prefix else back)
    return t


class Codec:
    """Encodes and decodes batches; one per Python worker."""

    def __init__(self, path: str, parity_every: int = PARITY_EVERY):
        with open(path, "rb") as f:
            raw = f.read()
        self.vocabulary = v = Vocabulary.parse(raw)
        self.tokenizer = build(v)
        self.cut = v.separable and not v.squeeze and not v.charsmap
        self.memory: dict[str, bytes] = {}  # ids as little-endian int32
        self.parity_every = parity_every
        import sentencepiece

        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        # bytes of every piece, for decoding by table
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in v.pieces]

    def units(self, text: str) -> list[str]:
        """The text with its marker put in, cut before every run of markers."""
        if not self.cut:
            return [text] if text else []
        if not text:
            return []
        t = ((" " if self.vocabulary.add_prefix else "") + text).replace(" ", MARK)
        parts = t.split(MARK)
        # empty parts stand for further markers of a run: they belong in front of the next unit
        if "" not in parts[1:]:
            out = [MARK + p for p in parts[1:]]
        else:
            out, run = [], ""
            for p in parts[1:]:
                run += MARK
                if p:
                    out.append(run + p)
                    run = ""
            if run:
                out.append(run)
        return ([parts[0]] if parts[0] else []) + out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.units(t or "") for t in texts]
        new = list({u: None for us in cut for u in us if u not in self.memory})
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory = {}
            new = list({u: None for us in cut for u in us})
        for k in range(0, len(new), UNITS):
            part = new[k : k + UNITS]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.memory[u] = array("i", e.ids).tobytes()
        self.verify(new)
        get = self.memory.__getitem__
        out = [np.frombuffer(b"".join(map(get, us)), np.int32) for us in cut]
        if not self.cut:
            self.memory = {}
        return out

    def verify(self, units: list[str]) -> None:
        """A share of the units, by hash, must have the sentencepiece library's ids."""
        some = [u for u in units if xxhash.xxh64_intdigest(u) % self.parity_every == 0]
        # a cut unit starts at a marker, which is what a leading space becomes; the dummy prefix is added by the library
        if self.cut:
            some = [u for u in some if u.startswith(MARK)] if self.vocabulary.add_prefix else some
            plain = [(u[1:] if self.vocabulary.add_prefix else u).replace(MARK, " ") for u in some]
            plain, some = zip(*[(p, u) for p, u in zip(plain, some) if p]) if any(plain) else ((), ())
        else:
            plain = some
        for u, ids in zip(some, self.other.encode(list(plain), num_threads=1)):
            if (mine := np.frombuffer(self.memory[u], np.int32).tolist()) != ids:
                raise ValueError(f"the two libraries differ on {u!r}: {mine} and {ids}")

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, bytes put together, the dummy prefix taken off."""
        table = self.bytes
        t = b"".join([table[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return t[1:] if self.vocabulary.add_prefix and t.startswith(" ") else t

    def restores(self) -> bool:
        """Whether decoding gives the very text back (nothing is normalised away)."""
        return not self.vocabulary.charsmap and not self.vocabulary.squeeze and self.vocabulary.byte_fallback


def plain(text: str | None) -> str:
    """What decoding gives back: the text, with a marker character of its own read as the space it stands for."""
    return (text or "").replace(MARK, " ")


_CODECS: dict = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the token ids of every whole text; every text is decoded again and compared.

    Rows leave in portions of about PORTION bytes of text, so a worker never holds the ids of a whole batch.
    """
    columns = [c for c in docs.columns if c != out]
    at = columns.index(text_col)
    schema = StructType([docs.schema[c] for c in columns] + [StructField(out, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        c = codec(path)

        def portion(b: pa.RecordBatch, first: int, texts: list[str | None]) -> pa.RecordBatch:
            ids = _checked(c, texts)
            offsets = np.r_[0, np.cumsum([len(k) for k in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            part = b.slice(first, len(texts))
            return pa.RecordBatch.from_arrays([*part.columns, lists], names=[*columns, out])

        for b in batches:
            first, held, size = 0, [], 0
            for k, t in enumerate(b.column(at)):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size >= PORTION:
                    yield portion(b, first, held)
                    first, held, size = k + 1, [], 0
            if held:
                yield portion(b, first, held)

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(released(run), schema)


def _checked(c: Codec, texts: list[str | None]) -> list[np.ndarray]:
    ids = c.encode(texts)
    if c.restores():
        for t, k in zip(texts, ids):
            if c.decode(k) != plain(t):
                raise ValueError("a text does not come back from its tokens")
    return ids


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids", out: str = "text") -> DataFrame:
    """Adds the text of every row's token ids (null: empty)."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for s in parts:
            yield pd.Series([c.decode(np.asarray(k)) if k is not None else "" for k in s], dtype=object)

    return rows.withColumn(out, run(F.col(ids_col)))


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def digest(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """``id``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian int32), ``decoded_crc32`` of every row."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        c = codec(path)
        for b in batches:
            n, crc, back = [], [], []
            held: list[str | None] = []
            size = 0

            def flush():
                for k, t in zip(c.encode(held), held):
                    text = c.decode(k)
                    if c.restores() and text != plain(t):
                        raise ValueError("a text does not come back from its tokens")
                    n.append(len(k))
                    crc.append(zlib.crc32(k.astype("<i4").tobytes()))
                    back.append(zlib.crc32(text.encode()))

            for t in b.column(1):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size >= PORTION:
                    flush()
                    held, size = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64())], names=["id", "n_tokens", "ids_crc32", "decoded_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, n_tokens long, ids_crc32 long, decoded_crc32 long")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Token count and checksums of every whole text, encoded, verified and decoded."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL).withColumnRenamed("id", "doc_id")
