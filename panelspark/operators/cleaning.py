"""Layer reading rules: sentinel, unit, cleaning, in that order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import eastness, lookup, near, northness
from panelspark.operators.core import require


def convert_units(value: Column, layer: Column, units: Mapping,
                  carbon_fraction: float) -> Column:
    """Factor, then carbon fraction. An undeclared layer fails the job."""
    factor = lookup(layer, {k: float(u[0]) * (carbon_fraction if u[1] else 1.0)
                            for k, u in units.items()})
    declared = F.coalesce(factor, F.raise_error(F.concat(
        F.lit("no unit entry for layer "), layer)).cast("double"))
    return value.cast("double") * declared


def sentinel_hit(value: Column, layer: Column,
                 sentinels: Mapping[str, float]) -> Column:
    target = lookup(layer, dict(sentinels))
    return F.coalesce(near(value.cast("double"), target), F.lit(False))


def rule_hits(value: Column, layer: Column, reference: Column,
              rules: Sequence[tuple]) -> dict[str, Column]:
    """For each rule, whether it touches the converted value."""
    out = {}
    for name, rule, bound in rules:
        on = layer == name
        if rule == "clip_upper":
            hit = on & (value > bound)
        elif rule == "clip_lower":
            hit = on & (value < bound)
        elif rule == "mask_by_reference":
            hit = on & reference.isNull() & value.isNotNull()
        else:
            raise ValueError(f"unknown cleaning rule {rule}")
        out[f"{name}:{rule}"] = F.coalesce(hit, F.lit(False))
    return out


def apply_rules(value: Column, layer: Column, reference: Column,
                rules: Sequence[tuple]) -> Column:
    out = value
    for name, rule, bound in rules:
        hit = rule_hits(out, layer, reference, [(name, rule, bound)])
        repl = F.lit(None).cast("double") if bound is None else F.lit(float(bound))
        out = F.when(next(iter(hit.values())), repl).otherwise(out)
    return out


def _needs_reference(rules: Sequence[tuple], reference: DataFrame | None) -> None:
    if reference is None and any(r[1] == "mask_by_reference" for r in rules):
        raise ValueError("the masking rule needs a reference layer")


def clean_layer(stored: DataFrame, units: Mapping, carbon_fraction: float,
                sentinels: Mapping[str, float], rules: Sequence[tuple],
                reference: DataFrame | None = None) -> DataFrame:
    """Stored ``(layer, year, pixel_id, value)`` to clean values.

    The type limit is compared on stored values, units come next, bounds last.
    ``reference`` holds (pixel_id, year, ref_value) for the masking rule; one
    equi-join serves every layer.
    """
    layer = F.col("layer")
    raw = F.col("value").cast("double")
    out = stored.withColumn("__s", sentinel_hit(raw, layer, sentinels))
    out = out.withColumn("value", convert_units(
        F.when(~F.col("__s"), raw), layer, units, carbon_fraction)).drop("__s")
    _needs_reference(rules, reference)
    if reference is None:
        ref = F.lit(None)
    else:
        out = out.join(reference, ["pixel_id", "year"], "left")
        ref = F.col("ref_value")
    out = out.withColumn("value", apply_rules(F.col("value"), layer, ref, rules))
    return out.drop("ref_value") if reference is not None else out


def rule_effects(stored: DataFrame, units: Mapping, carbon_fraction: float,
                 sentinels: Mapping[str, float], rules: Sequence[tuple],
                 reference: DataFrame | None = None) -> DataFrame:
    """Rows touched per layer, year and rule, in one pass."""
    _needs_reference(rules, reference)
    layer = F.col("layer")
    raw = F.col("value").cast("double")
    d = stored.withColumn("__s", sentinel_hit(raw, layer, sentinels))
    d = d.withColumn("__v", convert_units(F.when(~F.col("__s"), raw), layer,
                                          units, carbon_fraction))
    if reference is not None:
        d = d.join(reference, ["pixel_id", "year"], "left")
        ref = F.col("ref_value")
    else:
        ref = F.lit(None)
    hits = {"sentinel": F.col("__s"), **rule_hits(F.col("__v"), layer, ref, rules)}
    agg = d.groupBy("layer", "year").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(h.cast("long")).alias(k) for k, h in hits.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in hits)
    return agg.selectExpr(
        "layer", "year", "n",
        f"stack({len(hits)}, {pairs}) AS (rule, n_affected)")


def read_category(value: Column) -> Column:
    """Class codes are whole numbers and carry no unit."""
    return F.round(value.cast("double")).cast("int")


def add_bearing(df: DataFrame, aspect: str = "aspect") -> DataFrame:
    a = F.col(aspect).cast("double")
    return df.withColumn("northness", northness(a)).withColumn(
        "eastness", eastness(a))


def covariate_table(grid: DataFrame, statics: Mapping[str, DataFrame],
                    zones: Mapping[str, DataFrame],
                    zone_width: Mapping[str, int],
                    ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Grid cells with one column per static layer, gates included.

    Long inputs are pivoted by one aggregation instead of one join per layer:
    every layer is tagged, stacked and reduced by cell. A duplicated id, of a layer or
    of the grid, a code of the wrong width or a value outside its entry in ``ranges``
    fails the job, so the table has the rows of the grid or none.
    """
    parts = [d.select("pixel_id", F.lit(n).alias("__layer"),
                      F.col("value").cast("double").alias("__num"),
                      F.lit(None).cast("string").alias("__txt"))
             for n, d in statics.items()]
    parts += [d.select("pixel_id", F.lit(n).alias("__layer"),
                       F.lit(None).cast("double").alias("__num"),
                       F.col("value").cast("string").alias("__txt"))
              for n, d in zones.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    aggs = []
    for n in [*statics, *zones]:
        on = F.col("__layer") == n
        src = "__num" if n in statics else "__txt"
        aggs.append(F.max(F.when(on, F.col(src))).alias(n))
        aggs.append(F.sum(on.cast("int")).alias(f"__n_{n}"))
    wide = stacked.groupBy("pixel_id").agg(*aggs)
    dup = F.lit(False)
    for n in [*statics, *zones]:
        dup = dup | (F.col(f"__n_{n}") > 1)
    wide = require(wide, dup, "duplicate id in a static layer")
    for n, w in zone_width.items():
        wide = require(wide, F.coalesce(F.length(n) != w, F.lit(False)),
                       f"ragged code width in {n}")
    wide = wide.drop(*[f"__n_{n}" for n in [*statics, *zones]])
    for n, (low, high) in (ranges or {}).items():
        wide = require(wide, F.coalesce(~F.col(n).between(low, high), F.lit(False)),
                       f"{n} outside its range")
    once = require(grid.groupBy("pixel_id").agg(F.count(F.lit(1)).alias("__n")),
                   F.col("__n") > 1, "duplicate id in the grid").select("pixel_id")
    return grid.join(once, "pixel_id").join(wide, "pixel_id", "left")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every column present. NaN counts as missing in numbers."""
    cond = F.lit(True)
    kinds = dict(df.dtypes)
    for c in columns:
        ok = F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
        cond = cond & ok
    return df.where(cond)


def complete_case_loss(df: DataFrame, columns: Sequence[str],
                       by: Sequence[str] = ()) -> DataFrame:
    """Rows, complete rows and missing per column, one pass."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(whole.cast("long")).alias("n_complete"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}")
          for c in columns])
