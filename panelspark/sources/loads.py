"""Whole loads: sampled layers, static layers and record layers to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import resolve_event_year
from panelspark.operators.core import require, small_side
from panelspark.operators.lookups import crosswalk_join
from panelspark.sources.scans import fit_columns, stack_common
from panelspark.sources.schemas import RECORDS


def load_layers(samples: DataFrame, layers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sampled values with the no-data code removed and the scale applied.

    ``layers`` (layer, source, nodata, scale) and ``sources`` (source, nodata,
    scale) are registries; what a layer states wins over its source. All layers
    and years go through one job, which fails on a layer that has no registry row.
    """
    s = sources.select("source", F.col("nodata").alias("__sn"), F.col("scale").alias("__ss"))
    reg = small_side(layers.join(s, "source", "left").select(
        "layer", F.coalesce("nodata", "__sn").alias("__nodata"),
        F.coalesce("scale", "__ss", F.lit(1.0)).alias("__scale")), 10_000)
    samples = require(samples.join(reg, "layer", "left"), F.col("__scale").isNull(),
                      "a sampled layer has no registry row")
    v = F.col("value").cast("double")
    missing = F.coalesce(v == F.col("__nodata"), F.lit(False))
    return samples.withColumn(
        "value", F.when(~missing, v * F.col("__scale"))).drop("__nodata", "__scale")


def null_gate(values: DataFrame, keys: Sequence[str] = ("layer", "year")) -> DataFrame:
    """Per layer and year: cells, valid values, and whether any is valid."""
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid")).withColumn(
        "ok", F.col("n_valid") > 0)


def load_static(parts: Sequence[DataFrame]) -> DataFrame:
    """One static layer from one or several sampled files: mean over the files."""
    from panelspark.operators.spatial import mean_of_files

    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return mean_of_files(stacked) if len(parts) > 1 else stacked


def load_records(parts: Sequence[DataFrame], key_field: str, table: str | None = None,
                 crosswalk: DataFrame | None = None, status_field: str | None = None,
                 status_keep: str | None = None, date_field: str | None = None,
                 date_null: str | None = None, year_field: str | None = None,
                 key_field_2: str | None = None, method_field: str | None = None,
                 uid_candidates: Sequence[str] = ()) -> DataFrame:
    """Attribute files of a record layer as one table of the record schema.

    Files are stacked on their common columns, filtered by status, dated
    (completion date first, plan year second) and classed by the crosswalk.
    """
    d = stack_common(parts)
    names = {c.lower(): c for c in d.columns}

    def field(name: str | None) -> Column | None:
        if name is None:
            return None
        if name.lower() not in names:
            raise ValueError(f"field {name} is not in the record files")
        return F.col(names[name.lower()])

    def text(name: str | None) -> Column:
        c = field(name)
        return F.lit(None).cast("string") if c is None else c.cast("string")

    if status_field:
        d = d.where(F.trim(text(status_field)) == status_keep)
    uid = next((u for u in uid_candidates if u.lower() in names), None)
    out = d.select(
        "pixel_id", text(uid).alias("poly_uid"),
        resolve_event_year(field(date_field), field(year_field), date_null)
        .alias("event_year"), text(key_field).alias("key_value"),
        text(key_field_2).alias("key_value_2"), text(method_field).alias("method_value"))
    if table is not None:
        out = crosswalk_join(out, table, crosswalk).withColumnRenamed("origin", "xwalk_origin")
    return fit_columns(out, RECORDS)
