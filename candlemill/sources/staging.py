"""Tables written to the folder that the cluster shares and read again: what follows doesn't compute them anew, and a lost
executor costs a re-read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir, removed when the application ends; a temporary folder where that is unset and all
    tasks run here, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='candlemill-')}"
    path = f"{base.rstrip('/')}/candlemill-{app}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path.getParent())
    fs.deleteOnExit(jvm_path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
