"""Intermediate tables in the folder that the driver and all executors share.

A written table ends the lineage of what it was made from: a lost executor costs no
stage before it, and Spark knows its size when it plans a join with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .deploy import shared_folder

#: Rows of ids or names that are sent to every executor.
FEW = 1 << 20


def few(ids: DataFrame, n: int) -> DataFrame:
    """A table of ids or names of which there are ``n`` at most: broadcast if these are few,
    left to Spark otherwise."""
    return F.broadcast(ids) if n <= FEW else ids


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one; the JVM removes it when it ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    at, fs = _place(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder of the shared one and read again."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quarry_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of tables from ``written`` that nothing will read again."""
    for df in tables:
        if path := getattr(df, "quarry_folder", None):
            at, fs = _place(df.sparkSession, path)
            fs.delete(at, True)
