"""What the operators share: the given tables and rows kept in the shared folder."""

from __future__ import annotations

from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.staging import shared_root, staged

__all__ = ["column_or_null", "filesystem", "fold", "new_folder", "staged", "table", "whole_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that whatever their names are they meet no other; `select("whole.*")` has them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of this run under the one that driver and executors share."""
    import uuid

    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, named by URI or bare path, and the path in it. A task opens its files by these."""
    if urlsplit(folder).scheme:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder
