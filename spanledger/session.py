"""Spark session defaults for local runs; on a cluster the submitted settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "spanledger", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    n = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": n,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SPANLEDGER_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables under ``sf_dir``, read through Spark's own reader so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
