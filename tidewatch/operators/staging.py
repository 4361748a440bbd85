"""Write an intermediate result once to shared storage and read it back.

Used where a result feeds several branches: the branches then scan narrow Parquet columns instead of
repeating the work, and a lost executor costs a re-read instead of a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only for local sessions without the setting."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidewatch-")
    return _local_root


def staged(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
