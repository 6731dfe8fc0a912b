"""The corpus pipeline: toxicity, near-duplicates, repeated substrings, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read back as the next
one's documents. All but the last return the columns of ``documents`` (the length column follows a changed text).
"""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import mixing, pieces, simhash, substrings, toxicity
from spanledger.llm.scratch import Scratch

#: One pass over each leaf at most: the mixed corpus repeats no document.
TARGETS = replace(mixing.TARGETS, budget=900, max_epochs=1)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below the threshold stay.

    Null and empty texts have the score of texts without a match; repeated rows score alike; without labels nothing goes;
    an empty table stays empty; extra columns are kept.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "pipeline-toxicity"))
    return toxicity.score(docs, model, out="__toxic").where(F.col("__toxic") < toxicity.THRESHOLD).drop("__toxic")


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Candidates come from SimHash fingerprints by the generalised pigeonhole, as in op8, and from bands of MinHashes for
    pairs that differ in more bits; the exact similarity of the whole texts decides.

    A document is an id with its text: of the texts that share an id, the one with the smallest hash goes by the id and
    the others come after all ids, so each is judged by its own text. Rows equal in id and text are one document, of which
    the row with the smallest hash of all columns stays. Rows with a null id stay. Null texts and texts without words are
    one group. An empty table stays empty; extra columns are kept.
    """
    scratch = Scratch(spark, "pipeline-simhash")
    text_hash = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__d")).agg(F.min(text_hash).alias("__first"), F.max(text_hash).alias("__last")).where("__first != __last")
    several = scratch.write(several.select("__d", "__first"), "several")
    keyed = docs.withColumn("__key", F.col("doc_id").cast("long"))
    if not several.isEmpty():
        other = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        keyed = keyed.join(several, F.col("doc_id") == F.col("__d"), "left")
        keyed = keyed.withColumn("__key", F.when(F.col("__first").isNull() | (text_hash == F.col("__first")), F.col("__key")).otherwise(other)).drop("__d", "__first")
    found = simhash.near_copies(keyed, scratch, id_col="__key")
    lost = found.where("id != component").select("id").distinct()
    firsts = keyed.join(lost, F.col("__key") == lost["id"], "left_anti")
    twice = firsts.where("__key is not null").groupBy("__key").count().where("count > 1").select(F.col("__key").alias("__k"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = firsts.join(twice, F.col("__key") == F.col("__k"), "left_semi").groupBy("__key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r"))
    rest = firsts.join(twice, F.col("__key") == F.col("__k"), "left_anti").select(*columns)
    return rest.unionByName(one.select("r.*"))


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated spans go; a text without any keeps every character, and one with nothing left goes.

    Null and empty texts have no spans and stay; rows with a null id lose nothing; repeated rows of an id are not each
    other's source; an empty table stays empty; extra columns are kept.
    """
    spans = substrings.repeated_spans(docs, Scratch(spark, "pipeline-substrings"))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, cut):
            n, words = substrings.kept_words(t, s) if s is not None and len(s) else (0, [])
            out.append(t if len(words) == n else b" ".join(words).decode())
        return pd.Series(out, dtype=object)

    marked = substrings.with_spans(docs, spans, "doc_id", "text").withColumn("__kept", kept("text", "__spans"))
    changed = F.coalesce(F.col("__kept") != F.col("text"), F.lit(False))
    marked = marked.where(~(changed & (F.col("__kept") == ""))).withColumn("n_chars", F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars")))
    return marked.drop("text").withColumnRenamed("__kept", "text").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their leaves.

    Null languages and sources are leaves of their own; texts without words cost nothing; repeated rows are separate
    documents; an empty table stays empty; extra columns are kept, whatever their names.
    """
    aside = {c: f"__own_{c}" for c in docs.columns if c in ("tokens", "epoch")}
    picked = mixing.mix(docs.withColumnsRenamed(aside), Scratch(spark, "pipeline-mix"), TARGETS)
    return picked.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def encode_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, verified by decoding; null and empty texts have none; one row for each row."""
    out = pieces.encode(docs.select("doc_id", "text"), pieces.MODEL)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: SimHash, Aho-Corasick and the tokenizer cannot be said in SQL; tests/llm has brute-force versions of the stages.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.write(out, f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
