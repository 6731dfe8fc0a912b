"""Connected components of an edge table by contraction."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, else the session's own (a temporary one under a local master)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif sc.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="spanledger-graph-")
            sc.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


def delete(spark: SparkSession, uri: str) -> None:
    """Remove a table or folder, on whatever file system it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when Python exits."""
    uri = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    @atexit.register
    def _gone() -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            delete(spark, uri)

    return uri


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a DataFrame that reads it.

    A plan that reads a table has nothing of the plan that made it, so a loop of such steps plans each in the same time.
    """
    spark = df.sparkSession
    uri = own_folder(spark, "cut")
    schema = df.schema
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(schema).parquet(uri)


#: A node counts as heavy when more than this many others follow it; its row is then joined by broadcast.
HEAVY = 100_000


def followed(p: DataFrame, tops: DataFrame) -> DataFrame:
    """``id``, ``up`` and ``top``: what each node's ``up`` follows itself; a hub that many follow skews no task.

    Hubs have more than HEAVY followers each, so there are at most rows / HEAVY of them; their rows travel by broadcast
    and the rest is joined by shuffle.
    """
    hubs = p.groupBy("up").count().where(F.col("count") > HEAVY).select("up")
    heavy = tops.join(hubs, "up", "left_semi").select(F.col("up").alias("hub"), F.struct("top").alias("heavy"))
    light = tops.join(hubs, "up", "left_anti")
    marked = p.join(F.broadcast(heavy), F.col("up") == F.col("hub"), "left").drop("hub")
    few = marked.where("heavy is null").drop("heavy").join(light, "up", "left")
    many = marked.where("heavy is not null").select("up", "id", F.col("heavy.top").alias("top"))
    return few.select("id", "up", F.coalesce("top", "up").alias("top")).unionByName(many.select("id", "up", "top"))


def components(edges: DataFrame, max_rounds: int = 40, max_steps: int = 64) -> DataFrame:
    """``a``, ``b`` to ``id``, ``component`` (smallest id).

    A round lets every node follow its smallest neighbour, shortens the chains to their ends, and rewrites the edges
    between those ends; the nodes that are left at least halve. The rounds' maps are composed at the end.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    e = cut(e.distinct())
    maps = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("up")))
        for _ in range(max_steps):
            above = p.select(F.col("id").alias("up"), F.col("up").alias("top"))
            q = cut(followed(p, above).select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            p = q.select("id", "up")
            if q.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"chains of followers have not ended after {max_steps} halvings")
        maps.append(p)
        for c in ("a", "b"):
            e = e.join(p.select(F.col("id").alias(c), F.col("up").alias("to")), c).drop(c).withColumnRenamed("to", c)
        e = cut(e.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        if not e.isEmpty():
            raise RuntimeError(f"components have not met after {max_rounds} rounds")
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[-1]
    for p in reversed(maps[:-1]):
        out = cut(followed(p, out.select(F.col("id").alias("up"), F.col("up").alias("top"))).select("id", F.col("top").alias("up")))
    return out.select("id", F.col("up").alias("component"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``id``, ``hops`` of the nodes within ``hops`` steps of ``seeds`` (``id``) along ``a``, ``b`` in either direction.

    The edges are written once; each step joins the nodes reached last with them. Seeds that have no edge stay.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = cut(seeds.select("id", F.lit(0).alias("hops")).where("id is not null").distinct())
    reached = last
    for k in range(1, hops + 1):
        step = both.join(last.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        last = cut(step.join(reached.select("id"), "id", "left_anti").withColumn("hops", F.lit(k)))
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    return reached
