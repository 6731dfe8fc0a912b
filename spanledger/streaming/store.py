"""Stored tables that change in whole transactions.

Every table lies in partitions of workspace, batch and bucket of the document id. A change stages the new contents of the
partitions it touches (what stays of them by an anti-join on the ids that go, and the new rows), writes a plan, and then
overwrites exactly these partitions (Spark's dynamic partition overwrite); others are neither read nor written. The plan
makes the change durable: :meth:`Store.recover` applies a planned change again, which is harmless, and drops one without
a plan, so a writer that dies at any point leaves either the old or the new tables. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanledger.operators import graph, passages
from spanledger.sources import formats

BUCKETS = 8
PARTS = ["workspace_id", "batch", "bucket"]
_PARTS = "workspace_id string, batch long, bucket int"
SCHEMAS = {
    "documents": f"doc_id string, {formats.SCHEMA}, {_PARTS}",
    "passages": f"{passages.CHUNK_SCHEMA}, {_PARTS}",
    "claims": f"{passages.CLAIM_SCHEMA}, {_PARTS}",
    "status": f"doc_id string, step int, stage string, ts timestamp, {_PARTS}",
    "vectors": f"doc_id string, idx int, hash long, vector array<double>, {_PARTS}",
}


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, uri: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._fs(f"{self.root}/{name}")
        return fs.exists(path)

    def read(self, name: str, workspace: str | None = None) -> DataFrame:
        """A stored table (empty when nothing was stored), pruned to the folders of a workspace."""
        schema = SCHEMAS[name]
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self.exists(name) else self.spark.createDataFrame([], schema)
        return df if workspace is None else df.where(F.col("workspace_id") == workspace)

    def new_batch(self) -> int:
        return time.time_ns()

    def located(self, rows: DataFrame, workspace: str, batch: int) -> DataFrame:
        """Rows of a new batch with their partition."""
        return rows.withColumn("workspace_id", F.lit(workspace)).withColumn("batch", F.lit(batch).cast("long")).withColumn("bucket", bucket_of(F.col("doc_id")))

    def change(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> None:
        """For each table (new rows, ids that go): both with the partition columns; all tables change or none."""
        txn = f"{self.root}/_pending/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        plan: dict[str, list] = {}
        for name, (new, gone) in changes.items():
            columns = StructType.fromDDL(SCHEMAS[name]).names
            staged = new.select(*columns) if new is not None else None
            touched = []
            if gone is not None and self.exists(name):
                ids = graph.cut(gone.select("doc_id", *PARTS).distinct())
                parts = ids.select(*PARTS).distinct()  # as many rows as there are folders at most
                touched = [tuple(r) for r in parts.collect()]
                kept = self.read(name).join(F.broadcast(parts), PARTS, "left_semi").join(ids.select("doc_id"), "doc_id", "left_anti").select(*columns)
                staged = kept if staged is None else kept.unionByName(staged)
            if staged is None:
                continue
            staged.repartition(*PARTS).write.partitionBy(*PARTS).parquet(f"{txn}/{name}")
            held = {tuple(r) for r in self.spark.read.schema(SCHEMAS[name]).parquet(f"{txn}/{name}").select(*PARTS).distinct().collect()}
            plan[name] = [list(p) for p in touched if p not in held]
        fs, path = self._fs(f"{txn}/_plan")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(plan).encode()))
        out.close()
        self._apply(txn, plan)

    def _apply(self, txn: str, plan: dict[str, list]) -> None:
        for name, emptied in plan.items():
            staged = self.spark.read.schema(SCHEMAS[name]).parquet(f"{txn}/{name}")
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{self.root}/{name}")
            for workspace, batch, bucket in emptied:
                graph.delete(self.spark, f"{self.root}/{name}/workspace_id={workspace}/batch={batch}/bucket={bucket}")
        graph.delete(self.spark, txn)

    def recover(self) -> int:
        """Finish or drop what a dead writer left; returns how many changes were finished."""
        fs, path = self._fs(f"{self.root}/_pending")
        done = 0
        if not fs.exists(path):
            return done
        for txn in sorted(s.getPath().toString() for s in fs.listStatus(path)):
            _, marker = self._fs(f"{txn}/_plan")
            text = None
            if fs.exists(marker):
                stream = fs.open(marker)
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
            try:
                plan = json.loads(text) if text else None
            except ValueError:  # the writer died within the marker
                plan = None
            if plan is None:
                graph.delete(self.spark, txn)
            else:
                self._apply(txn, plan)
                done += 1
        return done
