"""Matched rows to units, units to panels, and the checks in between."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators.core import (exact_quantiles, global_index,
                                       null_safe_join, registry)
from panelspark.operators.lookups import pair_attribute


def pair_check(df: DataFrame, pair: str = "subclass",
               treat: str = "treat") -> DataFrame:
    """Pairs that do not hold exactly one treated and one control row."""
    t = (F.col(treat) == 1).cast("long")
    return df.groupBy(pair).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(t).alias("n_treated"),
        F.sum(1 - t).alias("n_control")).where(
        (F.col("n_treated") != 1) | (F.col("n_control") != 1))


def modal_shift(df: DataFrame, a: str, b: str,
                by: Sequence[str] = ()) -> DataFrame:
    """Most frequent ``a - b`` (the smaller of equals) and its spread."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        *by, (F.col(a) - F.col(b)).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("shift")).alias("neg")))
    return n.groupBy(*by).agg(
        best.alias("b"), F.count(F.lit(1)).alias("n_shifts"),
        F.sum("n").alias("n_rows")).select(
        *by, (-F.col("b.neg")).alias("shift"), F.col("b.n").alias("n_at_shift"),
        "n_shifts", "n_rows")


def treatment_year(treat: Column, cohort: Column, established: Column | None = None,
                   floor: int | None = None) -> Column:
    """0 for controls; the cohort for treated rows.

    With ``established``, treatment is protection: an unknown or early year is
    the floor, the first panel year.
    """
    if established is None:
        y = cohort.cast("int")
    else:
        y = F.greatest(F.coalesce(established.cast("int"), F.lit(floor)),
                       F.lit(floor))
    return F.when(treat == 1, y).otherwise(F.lit(0)).cast("int")


def shift_base(gvar: Column, shift: int) -> Column:
    return F.when(gvar > 0, gvar - shift).otherwise(gvar)


def drop_unusable_pairs(df: DataFrame, pair: str = "subclass") -> DataFrame:
    """Without the pairs whose treated row has no usable treatment year."""
    bad = df.where((F.col("treat") == 1)
                   & (F.col("gvar").isNull() | (F.col("gvar") <= 0)))
    return df.join(bad.select(pair).distinct(), pair, "left_anti")


def build_units(matched: DataFrame, attrs: DataFrame, shift_column: str,
                floor: int | None = None) -> DataFrame:
    """Matched rows with the treated side's attributes, gvar and dense ids.

    ``attrs`` has (pixel_id, cohort_year, pa_est_year, stratum, analysis_group,
    eligibility). ``shift_column`` names the column of the level year to keep
    for the audit. With ``floor`` the arm is protection.
    """
    from panelspark.operators.lookups import must_match

    base = matched.drop(*[c for c in ("cohort_year", "stratum", "analysis_group")
                          if c in matched.columns and c != shift_column])
    u = must_match(base, attrs.withColumnRenamed("cohort_year", "__cohort"),
                   ["pixel_id"], ["__cohort", "pa_est_year", "stratum",
                                  "analysis_group", "eligibility"])
    u = u.withColumnRenamed("stratum", "__stratum")
    u = pair_attribute(u, "subclass", "treat", {
        "__cohort": "cohort_year", "__stratum": "stratum",
        "pa_est_year": "__est"})
    has = u.where("treat = 1").select("subclass").distinct()
    u = u.join(has, "subclass", "left_semi")
    est = F.col("__est") if floor is not None else None
    u = u.withColumn("gvar", treatment_year(F.col("treat"), F.col("cohort_year"),
                                            est, floor))
    u = u.withColumn("pa_year_known", F.col("__est").isNotNull()).drop(
        "__est", "__cohort", "__stratum")
    return number_units(drop_unusable_pairs(u))


def number_units(df: DataFrame, pair: str = "subclass") -> DataFrame:
    """``pair_id`` in pair order, ``unit_id`` in (pair, treated first) order."""
    pairs = global_index(df.select(pair).distinct(), [F.col(pair)], "pair_id")
    rows = global_index(df, [F.col(pair), F.col("treat").desc(),
                             F.col("pixel_id")], "unit_id")
    return rows.join(pairs, pair)


def _bitmap(value: Column, cond: Column) -> Column:
    """Set of the whole numbers of one bitmap bucket, merged map-side."""
    return F.bitmap_construct_agg(F.when(cond, F.bitmap_bit_position(value.cast("long"))))


def _distinct_ids(units: DataFrame, by: Sequence[str], key: str,
                  conds: Mapping[str, Column]) -> DataFrame:
    """Exact distinct counts of whole-number ids, one per condition, as bitmaps.

    A row goes into the bitmap of its id's bucket (32,768 ids in 4 kB); what is shuffled
    is one row per group and bucket that a task has met, never one per unit.
    """
    bucket = F.bitmap_bucket_number(F.col(key).cast("long"))
    sets = units.groupBy(*by, bucket.alias("__bucket")).agg(
        *[_bitmap(F.col(key), c).alias(n) for n, c in conds.items()])
    return sets.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).alias(n) for n in conds])


def units_summary(units: DataFrame, by: Sequence[str], first_year: int) -> DataFrame:
    """Counts per pairing, with control reuse and the always-treated share.

    ``pair_id`` and ``pixel_id`` are whole numbers, best dense ones.
    """
    by = list(by)
    t = F.col("treat") == 1
    always = t & (F.col("gvar") <= first_year)
    year = F.when(t, F.col("gvar"))
    base = units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(t.cast("long")).alias("__t"),
        F.sum((~t).cast("long")).alias("n_control_rows"),
        F.size(F.collect_set(year)).cast("long").alias("n_cohorts"),  # as many as years
        F.min(year).alias("gvar_min"), F.max(year).alias("gvar_max"),
        F.sum(always.cast("long")).alias("n_always_treated"))
    pairs = _distinct_ids(units, by, "pair_id", {"n_pairs": F.lit(True)})
    cells = _distinct_ids(units, by, "pixel_id",
                          {"n_treated_pixels": t, "n_control_pixels": ~t})
    d = base.crossJoin(pairs).crossJoin(cells) if not by else null_safe_join(  # one row each
        null_safe_join(base, pairs, by), cells, by)
    return d.select(
        *by, "n_units", "n_pairs", "n_treated_pixels", "n_control_rows", "n_control_pixels",
        F.round(F.col("n_control_rows") / F.greatest("n_control_pixels", F.lit(1)), 4)
        .alias("control_reuse"), "n_cohorts", "gvar_min", "gvar_max", "n_always_treated",
        F.round(100.0 * F.col("n_always_treated") / F.col("__t"), 2).alias("pct_always_treated"))


def build_panel(units: DataFrame, values: DataFrame, first: int, last: int,
                key: str = "pixel_id") -> DataFrame:
    """Long unit-year panel: yearly values fanned out to the units of a cell.

    Values outside the years and of cells without units go before the join;
    null outcomes are no rows.
    """
    v = values.where(F.col("year").between(first, last)
                     & F.col("value").isNotNull())
    return units.join(v.select(key, "year", "value"), key)


def panel_years(layer_first: int, layer_last: int, first: int,
                last: int) -> tuple[int, int]:
    """Years a layer and the panel share."""
    return max(layer_first, first), min(layer_last, last)


def panel_manifest(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, units, years and value range per panel; exact median."""
    base = panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("unit_id").alias("n_units"),
        F.min("year").alias("year_first"), F.max("year").alias("year_last"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"))
    med = exact_quantiles(panel, by, "value", {"value_median": .5})
    return null_safe_join(base, med, list(by), "left")


def pct_missing(units: DataFrame, panel: DataFrame, n_years: int) -> DataFrame:
    """Share of unit-years without a value."""
    a = units.agg((F.count(F.lit(1)) * n_years).alias("expected"))
    b = panel.agg(F.count(F.lit(1)).alias("present"))
    return a.crossJoin(b).withColumn(  # one row each
        "pct_missing", F.round(
            100.0 * (1 - F.col("present") / F.col("expected")), 3))


def subset_levels(units: DataFrame, pairing: str = "pairing",
                  stratum: str = "stratum", zone: str = "zone") -> DataFrame:
    """Unit, treated, pair and cohort counts for every analysis cell.

    Cells are all rows, each stratum, each zone and each combination. One pass makes a row
    per finest cell and bucket of pair ids, with bitmaps of pairs and cohorts; the
    grouping sets merge those. Cells without a treated unit and cells of an empty level
    are left out; pooled levels read ''. Pair ids are whole numbers, cohorts are years.
    """
    t = F.col("treat") == 1
    g = F.when(t & (F.col("gvar") > 0), F.col("gvar"))
    ps, pz, p, b = F.col(stratum), F.col(zone), F.col(pairing), F.col("__bucket")
    fine = units.groupBy(pairing, stratum, zone, F.bitmap_bucket_number(
        F.col("pair_id").cast("long")).alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(t.cast("long")).alias("__t"),
        _bitmap(F.col("pair_id"), F.lit(True)).alias("__pairs"),
        F.bitmap_construct_agg(g.cast("long")).alias("__years"),
        F.min(g).alias("__lo"), F.max(g).alias("__hi"))
    sets = fine.groupingSets([[p, b], [p, ps, b], [p, pz, b], [p, ps, pz, b]], p, ps, pz, b).agg(
        F.grouping(stratum).alias("__gs"), F.grouping(zone).alias("__gz"),
        F.sum("__n").alias("__n"), F.sum("__t").alias("__t"),
        F.bitmap_count(F.bitmap_or_agg("__pairs")).alias("__k"),
        F.bitmap_or_agg("__years").alias("__years"),
        F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    out = sets.groupBy(pairing, stratum, zone, "__gs", "__gz").agg(
        F.sum("__n").alias("n_units"), F.sum("__t").alias("n_treated"),
        F.sum("__k").alias("n_pairs"), F.bitmap_count(F.bitmap_or_agg("__years")).alias("n_cohorts"),
        F.min("__lo").alias("gvar_min"), F.max("__hi").alias("gvar_max"))
    ok_s = (F.col("__gs") == 1) | (ps.isNotNull() & (ps != ""))
    ok_z = (F.col("__gz") == 1) | (pz.isNotNull() & (pz != ""))
    return out.where((F.col("n_treated") > 0) & ok_s & ok_z).select(
        pairing, F.when(F.col("__gs") == 1, "").otherwise(ps).alias(stratum),
        F.when(F.col("__gz") == 1, "").otherwise(pz).alias(zone),
        "n_units", "n_treated", "n_pairs", "n_cohorts", "gvar_min", "gvar_max")


def run_grid(manifest: DataFrame, levels: DataFrame, pairings: Mapping,
             outcomes: Mapping, min_treated: int,
             stratified: Sequence[str] = ("fire", "thin"), estimator: str = "etwfe",
             base_shift: Mapping[str, int] = P.BASE_SHIFT) -> DataFrame:
    """Every estimation run of an estimator: manifest x transform x analysis cell.

    Stratified arms keep stratum cells, the others pooled ones; an outcome scoped to an
    arm runs for its pairings only; cells below the treated floor are left out. The
    varying-base estimator runs the zones of a stratum beside the whole, so zones whose
    whole is below the floor go as well. Estimated rows scale the panel by its units.
    The protection arm adds the calendar series to its aggregations.
    """
    from panelspark.functions.text import run_id

    kinds = {"etwfe": "event", "attgt": "dynamic; simple"}[estimator]
    spark = manifest.sparkSession
    arms = registry(spark, ["pairing", "arm", "stratified", "base_shift", "aggregations"], [
        (p, a, a in stratified, base_shift.get(a, 0), f"calendar; {kinds}" if a == "pa" else kinds)
        for p, (_t, _c, a) in pairings.items()])
    tf = registry(spark, ["outcome", "scope", "transform"], [
        (o, scope, t) for o, (_l, lg, nat, scope) in outcomes.items()
        for t, on in (("log1p", lg), ("none", nat)) if on])
    base = levels.where("stratum = '' AND zone = ''").select(
        "pairing", F.col("n_units").alias("n_units_all"))
    lev = levels.join(arms, "pairing").where(
        (F.col("stratified") == (F.col("stratum") != "")) & (F.col("n_treated") >= min_treated))
    if estimator == "attgt":
        whole = lev.where("zone = ''").select("pairing", "stratum")
        lev = lev.join(whole, ["pairing", "stratum"], "left_semi")
    out = manifest.join(tf, "outcome").join(lev, "pairing").join(base, "pairing").where(
        F.col("scope").isin("all") | (F.col("scope") == F.col("arm")))
    rows = F.round(F.col("n_rows").cast("double") * F.col("n_units")
                   / F.col("n_units_all")).cast("long")
    return out.select(
        run_id(F.col("pairing"), F.col("outcome"), F.col("transform"),
               F.col("stratum"), F.col("zone")).alias("run_id"),
        "pairing", "outcome", "transform", "stratum", "zone", "arm", "n_units",
        "n_treated", "n_pairs", "n_cohorts", rows.alias("est_rows"),
        F.lit(estimator).alias("estimator"), F.col("base_shift").cast("int").alias("base_shift"),
        "aggregations")


def viable_cohorts(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Without the treated rows whose cohort lies after the last observed year."""
    last = panel.groupBy(*by).agg(F.max("year").alias("__last"))
    j = null_safe_join(panel, last, list(by)) if by else panel.crossJoin(last)
    return j.where((F.col("gvar") == 0) | (F.col("gvar") <= F.col("__last"))).drop(
        "__last")


def half_pairs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of which one side is left."""
    t = (F.col("treat") == 1).cast("int")
    sides = df.groupBy(*by, "pair_id").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    return sides.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum((F.col("lo") == F.col("hi")).cast("long")).alias("n_half"))


def balanced_panel(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units observed in every year their cell has."""
    n = panel.select(*by, "year").distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("__ny"))
    u = panel.groupBy(*by, "unit_id").agg(F.count(F.lit(1)).alias("__n"))
    full = (null_safe_join(u, n, list(by)) if by else u.crossJoin(n)).where(
        F.col("__n") == F.col("__ny")).select(*by, "unit_id")
    return panel.join(full, [*by, "unit_id"], "left_semi")
