"""Mixing sources to target weights by budgets on a tree of domains, languages and sources.

The token budget is dealt from the root down. A node's budget goes to its children by their weights; no child gets
more than its capacity (its tokens times ``max_epochs``), and what a short child cannot take goes to its siblings by
weight. Only what all siblings together cannot take is left to the level above, where the node itself counts as short,
so shortages move to siblings before ancestors. The level of water in a node is exact: the largest, over the children
in order of capacity per weight, of (budget - capacities before) / (weights from here on).

A leaf's budget buys whole epochs of all its documents, and of the next epoch the prefix, in the order of
md5(seed|epoch|id|tokens), of the documents whose running token sum stays within the rest. The running sum is found in two
steps: sums per range of the order (at most RANGES for each leaf), then rows of the one range that holds the cut.

Bound: the tree has at most MAX_LEAVES leaves (more is an error, not a cut); their table is all that is broadcast.

Edge cases: null and unknown names count as ``other``; null texts have no tokens; a leaf without tokens selects
nothing; a null id is ordered as the empty text (and by its tokens, so null ids do not meet in one range); repeated rows are separate documents; an empty table gives no rows;
other columns are kept by :func:`mix` (added ones are ``epoch`` and ``tokens``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_LEAVES = 100_000
RANGE_DIGITS = 3
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Integer weights by name on each level (names not listed have ``default``), budget, epochs, seed.

    ``budget`` is a share of all tokens in thousandths, so that the budget is an exact integer.
    """

    domain: dict[str, int] = field(default_factory=lambda: {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source: dict[str, int] = field(default_factory=dict)
    default: int = 10
    budget: int = 600
    max_epochs: int = 3
    seed: int = 20240501

    def weight_sql(self, level: str) -> str:
        cases = "".join(f" WHEN '{k}' THEN {int(v)}" for k, v in getattr(self, level).items())
        return f"CASE {level}{cases} ELSE {self.default} END" if cases else str(self.default)


#: Domain of a source: sources are named by a number, four domains deal them.
DOMAIN_SQL = "coalesce('domain' || CAST(CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4 AS {string}), 'other')"
WORDS = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``__domain``, ``__lang``, ``__source`` and ``tokens``."""
    return docs.withColumns({
        "__domain": F.expr(DOMAIN_SQL.format(string="STRING")),
        "__lang": F.coalesce("lang", F.lit("other")),
        "__source": F.coalesce("source", F.lit("other")),
        "tokens": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"),
    })


def budgets_sql(t: Targets, string: str) -> str:
    """SQL for ``leaf_budgets``: every leaf with its tokens and budget; ``leaves`` has the leaves' tokens. Spark and DuckDB both run it."""
    steps = [
        f"weighted AS (SELECT domain, lang, source, tokens, CAST({t.weight_sql('domain')} AS DOUBLE) AS w1, CAST({t.weight_sql('lang')} AS DOUBLE) AS w2, CAST({t.weight_sql('source')} AS DOUBLE) AS w3, CAST(tokens * {t.max_epochs} AS DOUBLE) AS cap FROM leaves)",
        f"total AS (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {t.budget} / 1000) AS b FROM leaves)",
    ]
    parent, budget = "", "SELECT b FROM total"
    for k, level in enumerate(LEVELS, 1):
        keys = ", ".join(LEVELS[:k])
        above = ", ".join(LEVELS[: k - 1])
        part = f"PARTITION BY {above} " if above else ""
        steps.append(f"n{k} AS (SELECT {keys}, max(w{k}) AS w, sum(cap) AS c FROM weighted GROUP BY {keys})")
        up = f"JOIN a{k - 1} USING ({above})" if above else "CROSS JOIN total"
        got = "a.b" if above else "b"
        up = f"JOIN (SELECT {above}, b FROM a{k - 1}) a USING ({above})" if above else "CROSS JOIN total"
        steps.append(
            f"l{k} AS (SELECT {keys}, w, c, ({got} - coalesce(sum(c) OVER ({part}ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({part}ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM n{k} {up})"
        )
        over = f"OVER (PARTITION BY {above})" if above else "OVER ()"
        steps.append(f"a{k} AS (SELECT {keys}, least(c, floor(w * max(water) {over} + 0.000001)) AS b FROM l{k})")
    steps.append(f"leaf_budgets AS (SELECT domain, lang, source, tokens AS leaf_tokens, CAST(b AS BIGINT) AS budget FROM a3 JOIN leaves USING (domain, lang, source) WHERE tokens > 0)")
    return ",\n".join(steps)


def plan(leaves: DataFrame, targets: Targets) -> DataFrame:
    """domain, lang, source, leaf_tokens, budget; at most MAX_LEAVES rows."""
    spark = leaves.sparkSession
    name = f"leaves_{id(leaves)}"
    leaves.createOrReplaceTempView(name)
    try:
        sql = "WITH leaves AS (SELECT * FROM {n}),\n".format(n=name) + budgets_sql(targets, "STRING") + "\nSELECT * FROM leaf_budgets"
        return spark.sql(sql)
    finally:
        spark.catalog.dropTempView(name)


def mix(docs: DataFrame, scratch: Scratch, targets: Targets, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected documents, one row per epoch that selects them, with all columns, ``epoch`` and ``tokens``."""
    base = keyed(docs, text_col)
    names = [F.col(f"__{c}").alias(c) for c in LEVELS]
    narrow = scratch.write(base.select(F.col(id_col).cast("string").alias("id"), *names, "tokens"), "narrow")
    leaves = scratch.write(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    n = leaves.count()
    if n > MAX_LEAVES:
        raise ValueError(f"{n} leaves; the tree of weights may have {MAX_LEAVES}")
    deal = plan(leaves, targets).withColumn("full", F.expr("budget div leaf_tokens")).withColumn("rest", F.col("budget") - F.col("full") * F.col("leaf_tokens"))
    deal = scratch.write(deal, "deal")
    order = lambda i, full: F.md5(F.concat_ws("|", F.lit(str(targets.seed)), F.col(full).cast("string"), F.coalesce(i, F.lit("")), F.col("tokens").cast("string")).cast("binary"))
    # the range of the order in which a leaf's rest ends
    ranged = narrow.join(F.broadcast(deal), list(LEVELS)).withColumn("cell", F.substring(order(F.col("id"), "full"), 1, RANGE_DIGITS))
    sums = ranged.groupBy(*LEVELS, "rest", "cell").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("t").over(w)).where(F.col("upto") > F.col("rest"))
    cuts = sums.groupBy(*LEVELS).agg(F.min(F.struct("cell", (F.col("upto") - F.col("t")).alias("before"))).alias("cut"))
    deal = deal.join(cuts, list(LEVELS), "left").select(*[F.col(c).alias(f"__k_{c}") for c in LEVELS], F.col("full").alias("__full"), F.col("rest").alias("__rest"), F.col("cut.cell").alias("__cell"), F.col("cut.before").alias("__before"))
    deal = scratch.write(deal, "cuts")
    on = [F.col(f"__{c}") == F.col(f"__k_{c}") for c in LEVELS]
    rows = base.join(F.broadcast(deal), on)
    key = order(F.col(id_col).cast("string"), "__full")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("epoch", "tokens")]
    whole = rows.where("__full > 0").select(*columns, "tokens", F.explode(F.sequence(F.lit(0), F.col("__full").cast("int") - 1)).alias("epoch"))
    nxt = rows.withColumn("__key", key).withColumn("__at", F.substring("__key", 1, RANGE_DIGITS))
    epoch = F.col("__full").cast("int").alias("epoch")
    before = nxt.where(F.col("__cell").isNull() | (F.col("__at") < F.col("__cell"))).select(*columns, "tokens", epoch)
    inside = nxt.where(F.col("__at") == F.col("__cell"))
    w = Window.partitionBy(*[f"__{c}" for c in LEVELS]).orderBy("__key", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__upto", F.col("__before") + F.sum("tokens").over(w)).where(F.col("__upto") <= F.col("__rest")).select(*columns, "tokens", epoch)
    return whole.unionByName(before).unionByName(inside)


TARGETS = Targets()


def op6_hierarchical_mix(spark, sf_dir: str) -> DataFrame:
    """Every (document, epoch) that the budgets select."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, Scratch(spark, "mix"), TARGETS)
    return out.select("doc_id", F.expr(DOMAIN_SQL.format(string="STRING")).alias("domain"), F.coalesce("lang", F.lit("other")).alias("lang"), F.coalesce("source", F.lit("other")).alias("source"), "tokens", "epoch")


def selection_sql(t: Targets, table: str = "documents") -> str:
    """DuckDB SQL for the rows of :func:`op6_hierarchical_mix`."""
    return f"""
WITH docs AS (SELECT doc_id, {DOMAIN_SQL.format(string='VARCHAR')} AS domain, coalesce(lang, 'other') AS lang, coalesce(source, 'other') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS tokens FROM {table}),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY domain, lang, source),
{budgets_sql(t, 'VARCHAR')},
dealt AS (SELECT *, budget // leaf_tokens AS full_epochs, budget - (budget // leaf_tokens) * leaf_tokens AS rest FROM leaf_budgets),
rows_ AS (SELECT d.*, full_epochs, rest, md5('{t.seed}|' || CAST(full_epochs AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(tokens AS VARCHAR)) AS k FROM docs d JOIN dealt USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rows_)
SELECT doc_id, domain, lang, source, tokens, CAST(e AS INTEGER) AS epoch FROM summed, range({t.max_epochs + 1}) r(e) WHERE e < full_epochs OR (e = full_epochs AND upto <= rest)
"""


OP6_SQL = selection_sql(TARGETS)
