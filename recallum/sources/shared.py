"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes of a block of a query table.
QUERIES, BYTES = 2048, 64 << 20
#: Bytes of a batch of rows on its way to a Python worker, within `small_batches`.
BATCH = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only in local mode, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` on shared storage: its rows survive a lost executor, its plan starts anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """What is executed within sends rows to Python workers in batches of about `size` bytes, unless the session sets that itself.

    An executor and each of its workers hold a batch or two beside the heap.  By
    default only 10,000 rows end a batch of texts, so a few long texts a row are
    hundreds of megabytes.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed within go when its action ends, not when the driver happens to collect its garbage; for work that is `cut` or read once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hinted(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`df` (already cut, of a few narrow columns) with a broadcast hint if it has at most `most` rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def query_blocks(queries: DataFrame, columns: list[str], rows: int = QUERIES, size: int = BYTES) -> Iterator[pa.Table]:
    """The query table, whose rows and bytes are counted first, in blocks that fit the driver and every worker."""
    n, total = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns)))), F.lit(0))).first()
    blocks = max(-(-n // rows), -(-total // size))
    for k in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).select(*columns).toArrow()


def against(rows: DataFrame, queries: DataFrame, on: Column, key: str = "qid", most: int = 50_000) -> DataFrame:
    """Join a large table with a query table on a predicate that is no equality.

    The query table is counted and goes to the executors in blocks of about
    `most` rows, so what is broadcast is bounded; the large table is never moved.
    """
    blocks = -(-queries.count() // most) or 1
    parts = [queries if blocks == 1 else queries.where(F.pmod(F.hash(key), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(p), on) for p in parts])
