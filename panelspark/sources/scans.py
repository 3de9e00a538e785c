"""Readers. Each returns a lazy scan; pruning and pushdown are left to Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions.text import pad_code, year_from_path
from panelspark.operators.core import require


def read_columns(spark: SparkSession, path: str,
                 columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*columns)


def read_for_ids(df: DataFrame, ids: DataFrame, key: str = "pixel_id",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is in ``ids``: a semi join, filtered before the shuffle.

    The engine adds a runtime bloom filter to the scan when the id set is
    selective, and broadcasts it only when its measured size is small.
    """
    out = df.select(key, *[c for c in columns or df.columns if c != key])
    return out.join(ids.select(key).distinct(), key, "left_semi")


def read_partition(spark: SparkSession, path: str, column: str,
                   value: str | int) -> DataFrame:
    """One partition of a partitioned dataset (directory pruning)."""
    return spark.read.parquet(path).where(F.col(column) == value)


def fit_columns(df: DataFrame, schema: str) -> DataFrame:
    """Project onto a declared schema: cast what is there, null what is not."""
    want = StructType.fromDDL(schema)
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in want])


def stack_files(parts: Sequence[DataFrame], schema: str | None = None) -> DataFrame:
    """Union by name; columns some parts lack are null in them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return fit_columns(out, schema) if schema else out


def stack_common(parts: Sequence[DataFrame]) -> DataFrame:
    """Union on the columns all parts share, in the order of the first."""
    shared = [c for c in parts[0].columns
              if all(c in p.columns for p in parts[1:])]
    out = parts[0].select(*shared)
    for p in parts[1:]:
        out = out.unionByName(p.select(*shared))
    return out


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV lookup with a declared schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema,
                          enforceSchema=False)


def read_estimates(df: DataFrame, estimator: str) -> DataFrame:
    """Result rows of one estimator in the canonical estimate columns.

    All inputs are text. ``attgt`` rows carry their time in ``egt`` and mark
    the pooled row by term; ``etwfe`` rows carry ``year`` or ``event``.
    """
    def col(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    def num(name: str) -> Column:
        return col(name).try_cast("double")

    agg, term = col("aggregation"), col("term")
    if estimator == "attgt":
        overall = F.coalesce(term == "overall", F.lit(False))
        kind = (F.when(overall, "overall").when(agg == "group", "cohort")
                .when(agg == "dynamic", "event")
                .when(agg == "calendar", "calendar"))
        time = F.when(~overall, num("egt"))
    else:
        kind = (F.when(agg == "calendar", "calendar").when(agg == "event", "event")
                .when(agg == "simple", "overall"))
        time = (F.when(agg == "calendar", num("year"))
                .when(agg == "event", num("event")))
    blank = F.lit("")
    return df.select(
        col("run_id").alias("run_id"), F.lit(estimator).alias("estimator"),
        *[col(c).alias(c) for c in ("pairing", "outcome", "transform")],
        F.coalesce(col("stratum"), blank).alias("stratum"),
        F.coalesce(col("ecoregion"), blank).alias("ecoregion"),
        num("base_shift").cast("int").alias("base_shift"),
        agg.alias("aggregation"), term.alias("term"), kind.alias("time_type"),
        time.alias("time"), num("estimate").alias("estimate"),
        num("std.error").alias("std_error"), num("statistic").alias("statistic"),
        num("p.value").alias("p_value"), num("conf.low").alias("conf_low"),
        num("conf.high").alias("conf_high"), num("crit_val").alias("crit_val"))


def read_windows(auto: DataFrame, revised: DataFrame | None,
                 code: str = "ecoregion") -> DataFrame:
    """Result windows: the edited copy when there is one, codes padded again."""
    df = revised if revised is not None else auto
    c = F.coalesce(F.trim(F.col(code).cast("string")), F.lit(""))
    return df.withColumn(code, F.when(c == "", "").otherwise(
        F.coalesce(pad_code(c), c)))


def file_years(spark: SparkSession, glob: str, first: int, last: int) -> DataFrame:
    """(path, year) of the files under a glob; listing only, contents unread."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    return files.withColumn("year", year_from_path(F.col("path"), first, last))


def layer_index(files: DataFrame, first: int, last: int) -> DataFrame:
    """One row per year of the span: file count, and ok / duplicate / gap."""
    spark = files.sparkSession
    span = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counts = files.where(F.col("year").isNotNull()).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("path").alias("path"))
    n = F.coalesce(F.col("n_files"), F.lit(0))
    return span.join(counts, "year", "left").select(
        "year", n.alias("n_files"), "path",
        F.when(n == 0, "gap").when(n > 1, "duplicate").otherwise("ok").alias("state"))


def layer_registry(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the layer registries; the job fails on a name that occurs twice.

    :func:`layer_name_counts` reports the names instead.
    """
    return require(layer_name_counts(parts), F.col("n_entries") > 1,
                   "layer names must be unique across registries")


def layer_name_counts(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the layer registries with the number of entries of each name."""
    stacked = stack_files([d.withColumn("store", F.lit(s))
                           for s, d in parts.items()])
    dup = stacked.groupBy("layer").agg(F.count(F.lit(1)).alias("n_entries"))
    return stacked.join(dup, "layer")


def layer_years(registry: DataFrame) -> DataFrame:
    """Years each active layer covers, one row per (layer, year)."""
    return registry.where("active").select("layer", "store", F.explode(
        F.sequence("first_year", "last_year")).alias("year"))


def expected_keys(layers: DataFrame, classes: DataFrame) -> DataFrame:
    """Every (layer, year, class) there should be; the class list is counted."""
    from panelspark.operators.core import small_side

    return layers.join(small_side(classes.distinct(), 10_000), F.lit(True))


def completeness(expected: DataFrame, present: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """Expected keys with a flag for those found in ``present``.

    ``present`` may be the data itself: it is reduced to its keys map-side.
    """
    found = present.select(*keys).distinct().withColumn("present", F.lit(True))
    return expected.join(found, list(keys), "left").withColumn(
        "present", F.coalesce("present", F.lit(False)))


def named_value(table: DataFrame, name: str, value: str = "value") -> DataFrame:
    """The value stored under a name; a job error when it is absent."""
    hit = table.where(F.col("name") == name).agg(F.max(value).alias(value))
    return hit.select(F.coalesce(
        F.col(value), F.raise_error(F.lit(f"no entry named {name}"))
        .cast("double")).alias(value))
