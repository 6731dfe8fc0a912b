"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as heavy from this share of all rows on, so there are at most HEAVY_SHARE heavy keys: the size bound
#: of the broadcast in :func:`attach`.
HEAVY_SHARE = 1000


def attach(left: DataFrame, key: str, right: DataFrame, value: str, total: int, rows: str) -> DataFrame:
    """Left join of ``right`` (``key`` unique, ``value``, and ``rows``: how many rows of ``left`` have the key).

    Keys with at least ``total / HEAVY_SHARE`` rows, at most HEAVY_SHARE of them, come by broadcast and their rows
    are dealt over all partitions; the other keys are joined by shuffle, where no key has more than that share.
    Null keys get a null value.
    """
    least = max(1.0, total / HEAVY_SHARE)
    r = right.select(F.col(key).alias("__rk"), F.col(value).alias("__rv"), F.col(rows).alias("__rn"))
    heavy = r.where(F.col("__rn") >= least).select(F.col("__rk").alias("__hk"), F.struct("__rv").alias("__hv"))
    light = r.where(F.col("__rn") < least).select("__rk", F.struct("__rv").alias("__lv"))
    out = left.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    # a heavy row's join key becomes null, plus a salt that spreads it
    out = out.withColumn("__jk", F.when(F.col("__hk").isNull(), F.col(key)))
    out = out.withColumn("__js", F.when(F.col("__jk").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(100_003))).otherwise(0))
    light = light.withColumn("__ls", F.lit(0).cast("long"))
    out = out.withColumn("__js", F.col("__js").cast("long"))
    out = out.join(light, (F.col("__jk").eqNullSafe(F.col("__rk"))) & (F.col("__js") == F.col("__ls")), "left")
    found = F.coalesce(F.col("__hv"), F.col("__lv"))
    return out.withColumn(value, found["__rv"]).drop("__hk", "__hv", "__jk", "__js", "__rk", "__ls", "__lv")
