"""Shared pieces: tables written to the cluster's shared folder, range-ordered running totals, word rules."""

from __future__ import annotations

import ctypes
import functools
import glob
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all tasks run here, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='candlemill-')}"
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/candlemill-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path.getParent())
    fs.deleteOnExit(jvm_path)
    return path


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, so a lost executor costs only a re-read."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to Python: with whole texts in it, Spark's default of 10,000 rows takes too much of an executor.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches, where they are higher."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if size(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.cache
def settle_worker() -> None:
    """For tasks with many small matrix products, where numpy brings OpenBLAS and runs on glibc: one thread, as Spark has a task
    for every core and the products are too small to share; and freed memory stays with the process, as fresh pages cost
    more than the arithmetic on them."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "libscipy_openblas64_*.so")):
        set_threads = getattr(ctypes.CDLL(path), "scipy_openblas_set_num_threads64_", None)
        if set_threads is not None:
            set_threads(1)
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def range_staged(df: DataFrame, label: str, *order: str) -> DataFrame:
    """df range-partitioned by order and written; column __pid numbers its ranges, in order."""
    n = shuffle_partitions(df.sparkSession)
    return stage_table(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), label)


def running_total(df: DataFrame, label: str, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows before this one, by order within group.

    No group meets in one task: rows are range-partitioned by (group, order), each range is summed on its own, and
    the sums of the ranges (one row for each range and group in it) give every range its offset.
    """
    staged = range_staged(df, label, *group, *order)
    keys = ["__pid", *group]
    sums = staged.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"__o_{k}") for k in keys), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__o_{k}")) if k != "__pid" else F.col(k) == F.col(f"__o_{k}")
        same = c if same is None else same & c
    within = staged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(offsets, same).withColumn(out, F.col("__inside") + F.col("__offset")).select(*df.columns, out)
