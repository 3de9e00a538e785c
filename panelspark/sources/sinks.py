"""Writers and keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, sort: Sequence[str],
                 partition_by: Sequence[str] = (), spread: int = 0) -> None:
    """Zstandard Parquet, rows sorted inside each file.

    With ``partition_by`` the rows are laid out by range of (partition, sort)
    first, so one large partition value is written by many tasks and the file
    count stays near ``spread`` instead of tasks x partition values.
    """
    if partition_by:
        order = [*partition_by, *sort]
        df = (df.repartitionByRange(spread, *order) if spread
              else df.repartitionByRange(*order))
        df = df.sortWithinPartitions(*order)
    else:
        df = df.sortWithinPartitions(*sort)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def consolidate(src: DataFrame, path: str, partition_by: str, sort: str,
                files: int) -> None:
    """Rewrite many part files as few range-sorted ones per partition value."""
    write_sorted(src, path, [sort], [partition_by], files)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option(
        "compression", "gzip" if gzip else "none").csv(path)


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last written row per key. An aggregate, so repeats shrink map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max(F.struct(F.col(seq).alias("__first"), *rest)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def merge_by_key(existing: DataFrame, incoming: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """Replace-on-key: incoming rows win, others stay."""
    both = existing.withColumn("__seq", F.lit(0)).unionByName(
        incoming.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "__seq").drop("__seq")


def first_per_key(df: DataFrame, keys: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """First row per key in an order, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min(F.struct(F.struct(*order).alias("__first"), *rest)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """``k`` rows per key without ties; the group limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(
        F.col("__rn") <= k).drop("__rn")
