"""Intermediate tables in the folder that every executor and the driver can see.

The folder is the one named in ``spark.checkpoint.dir``, else the session's checkpoint directory. Only a local master
(tests, a laptop) without either gets a temporary folder; on a cluster their absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The URI of the shared folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        set_by_caller = sc._jsc.sc().getCheckpointDir()
        if set_by_caller.isDefined():
            root = set_by_caller.get()
        elif sc.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="spanledger-")
            sc.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root.rstrip("/")


class Scratch:
    """A folder of Parquet tables that cut lineage; they outlive lost executors and are removed at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table and return a DataFrame that reads it."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark remove the shuffles that made them."""
        for name in names:
            self._delete(self.path(name))
        self.sweep()

    def sweep(self) -> None:
        """Let Spark's cleaner see which shuffles are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, uri: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(uri)
        p.getFileSystem(conf).delete(p, True)

    def _close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            self._delete(self.uri)
