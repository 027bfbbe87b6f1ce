"""A session with the settings this engine is written for. Any other session works too."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # timestamps without zone are compared as written
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionRowLimit": "-1",  # a level of all messages may have any number of rows
}


def session(name: str = "lexgrove", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share.

    Where the setting is unset and all runs in one process, a temporary folder that goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexgrove-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/lexgrove/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: for what several branches of a plan use."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, each: int, weight: Column | None = None) -> int:
    """So many partitions that each has about `each` rows, or as much of a weight; at least as many as run at once.

    For repartition() before an aggregate or a sort: partitions of a given number are not joined by their compressed bytes, which say little of what a task holds in memory.
    """
    total = df.agg(F.count("*") if weight is None else F.sum(weight)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(total) // each))


def remove(spark: SparkSession, path: str) -> bool:
    """Take a written table away, on whatever file system it is; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
