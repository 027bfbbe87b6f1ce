"""What the operators of this subpackage share: input tables, scratch tables, words."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the contracts: space and \t \n \v \f \r. bytes.split() without arguments splits at exactly these.
WORD = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset and all runs in one process (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexgrove-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base[len("file://"):], ignore_errors=True)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/lexgrove/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a lost executor costs no recomputation of what is written."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give a Python worker's free memory back: workers live on, and the next stage's share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first three columns -> batches of whole blocks, which are small, with the sizes of these."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.concat_batches([*rest, batch])
        key = np.stack([rows.column(k).to_numpy() for k in range(3)])
        ends = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
        if len(ends):
            yield rows.slice(0, ends[-1]), np.diff(ends, prepend=0)
            rows = rows.slice(ends[-1])
        rest = [rows]
    if rest and rest[0].num_rows:
        yield rest[0], np.array([rest[0].num_rows])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def tokenizer_path(name: str, directory: str | None = None) -> str:
    """Place of a public vocabulary file; directory overrides that of the installed package."""
    if directory:
        return os.path.join(directory, name)
    import public_tokenizers

    return public_tokenizers.path(name)
