"""Small helpers of the text operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import cut_lineage, stage_folder

__all__ = ["cut_lineage", "fold", "read", "sha", "stage_folder", "write_stage"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids go to fold -1."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(parts), F.lit(-1)).cast("int")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back by column."""
    spark = df.sparkSession
    path = stage_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
