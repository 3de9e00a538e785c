"""Units, panels, analysis cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators import units as U
from panelspark.operators.core import registry
from panelspark.plans.estimate import analysis_cells
from panelspark.queries.base import (cohorts, matched_units, n_if, query, table, unit_panel,
                                     with_, yearly_value)


@query("pair_check", with_("cohorts") + """SELECT zone AS subclass, count(*) AS n_rows,
    count(*) FILTER (gvar > 0) AS n_treated, count(*) FILTER (gvar = 0) AS n_control FROM cohorts
    GROUP BY zone HAVING count(*) FILTER (gvar > 0) <> 1 OR count(*) FILTER (gvar = 0) <> 1""")
def pair_check(spark, sf):
    c = cohorts(spark, sf).withColumn("treat", (F.col("gvar") > 0).cast("int"))
    return U.pair_check(c.withColumnRenamed("zone", "subclass"))


@query("modal_shift", with_("cohorts", "yearly_value", f="""SELECT pixel_id, max(year) AS y
    FROM yearly_value GROUP BY pixel_id""", n="""SELECT lulc, CAST(f.y - gvar AS INTEGER) AS shift,
    count(*) AS n FROM cohorts JOIN f USING (pixel_id) WHERE gvar > 0 GROUP BY ALL""")
    + """SELECT lulc, arg_max(shift, (n, -shift)) AS shift, max(n) AS n_at_shift,
    count(*) AS n_shifts, CAST(sum(n) AS BIGINT) AS n_rows FROM n GROUP BY lulc""")
def modal_shift(spark, sf):
    y = yearly_value(spark, sf).groupBy("pixel_id").agg(F.max("year").alias("y"))
    d = cohorts(spark, sf).where(F.col("gvar") > 0).join(y, "pixel_id")
    return U.modal_shift(d, "y", "gvar", ["lulc"])


@query("treatment_year", with_("cohorts") + """SELECT pixel_id, CASE WHEN gvar = 0 THEN 0
    WHEN lulc = 'BUILDING' THEN greatest(CASE WHEN x1 < 0 THEN 1997 ELSE gvar END, 1997)
    ELSE gvar END AS gvar, CASE WHEN gvar > 0 THEN gvar - 1 ELSE 0 END AS gvar_shifted
    FROM cohorts""")
def treatment_year(spark, sf):
    c = cohorts(spark, sf)
    treat = (F.col("gvar") > 0).cast("int")
    est = F.when(F.col("x1") >= 0, F.col("gvar"))
    g = F.when(F.col("lulc") == "BUILDING", U.treatment_year(treat, F.col("gvar"), est, 1997)
               ).otherwise(U.treatment_year(treat, F.col("gvar")))
    return c.select("pixel_id", g.alias("gvar"), U.shift_base(F.col("gvar"), 1)
                    .alias("gvar_shifted"))


@query("drop_unusable_pairs", with_("matched_units", m="""SELECT unit_id, pair_id, treat,
    CASE WHEN zone > '12' OR treat = 0 THEN gvar END AS gvar FROM matched_units""")
    + """SELECT unit_id, pair_id FROM m WHERE pair_id NOT IN (SELECT pair_id FROM m
    WHERE treat = 1 AND gvar IS NULL)""")
def drop_unusable_pairs(spark, sf):
    m = matched_units(spark, sf).withColumn("gvar", F.when(
        (F.col("zone") > "12") | (F.col("treat") == 0), F.col("gvar")))
    return U.drop_unusable_pairs(m, "pair_id").select("unit_id", "pair_id")


@query("dense_ids", with_("matched_units") + """SELECT pixel_id, dense_rank() OVER
    (ORDER BY pair_id) AS pair_no, row_number() OVER (ORDER BY pair_id, treat DESC, pixel_id)
    AS unit_no FROM matched_units""")
def dense_ids(spark, sf):
    m = matched_units(spark, sf).select("pixel_id", "treat", F.col("pair_id").alias("subclass"))
    return U.number_units(m).select("pixel_id", F.col("pair_id").alias("pair_no"),
                                    F.col("unit_id").alias("unit_no"))


@query("build_units", with_("matched_units") + """SELECT a.pixel_id, a.treat, CASE WHEN a.treat = 1
    THEN a.gvar ELSE 0 END AS gvar, b.gvar AS cohort_year, b.zone AS stratum, dense_rank() OVER
    (ORDER BY a.pair_id) AS pair_id FROM matched_units a JOIN matched_units b
    ON a.pair_id = b.pair_id AND b.treat = 1""")
def build_units(spark, sf):
    m = matched_units(spark, sf).select("pixel_id", "treat", "lulc",
                                        F.col("pair_id").alias("subclass"))
    c = cohorts(spark, sf).select(
        "pixel_id", F.when(F.col("gvar") > 0, F.col("gvar")).alias("cohort_year"),
        F.lit(None).cast("int").alias("pa_est_year"), F.col("zone").alias("stratum"),
        F.col("lulc").alias("analysis_group"), F.lit("treatment").alias("eligibility"))
    return U.build_units(m, c, "win_key").select(
        "pixel_id", "treat", "gvar", "cohort_year", "stratum", "pair_id")


@query("units_summary", with_("matched_units") + f"""SELECT lulc, count(*) AS n_units,
    count(DISTINCT pair_id) AS n_pairs, count(DISTINCT CASE WHEN treat = 1 THEN pixel_id END)
    AS n_treated_pixels, {n_if("treat = 0")} AS n_control_rows,
    count(DISTINCT CASE WHEN treat = 0 THEN pixel_id END) AS n_control_pixels,
    round({n_if("treat = 0")} / count(DISTINCT CASE WHEN treat = 0 THEN pixel_id END), 4)
    AS control_reuse, count(DISTINCT CASE WHEN treat = 1 THEN gvar END) AS n_cohorts,
    min(gvar) FILTER (treat = 1) AS gvar_min, max(gvar) FILTER (treat = 1) AS gvar_max,
    {n_if("treat = 1 AND gvar <= 1995")} AS n_always_treated,
    round(100.0 * {n_if("treat = 1 AND gvar <= 1995")} / {n_if("treat = 1")}, 2)
    AS pct_always_treated FROM matched_units GROUP BY lulc""")
def units_summary(spark, sf):
    return U.units_summary(matched_units(spark, sf), ["lulc"], 1995)


@query("panel_long", with_("panel") + """SELECT unit_id, pair_id, treat, gvar, year,
    round(value, 4) AS value FROM panel WHERE year BETWEEN 1996 AND 2000""")
def panel_long(spark, sf):
    lo, hi = U.panel_years(1990, 2000, 1996, 2005)
    return U.build_panel(matched_units(spark, sf), yearly_value(spark, sf), lo, hi).select(
        "unit_id", "pair_id", "treat", "gvar", "year", F.round("value", 4).alias("value"))


@query("panel_manifest", with_("panel") + """SELECT lulc, count(*) AS n_rows,
    count(DISTINCT unit_id) AS n_units, min(year) AS year_first, max(year) AS year_last,
    round(min(value), 4) AS value_min, round(max(value), 4) AS value_max,
    round(quantile_cont(value, 0.5), 6) AS value_median FROM panel GROUP BY lulc""")
def panel_manifest(spark, sf):
    return U.panel_manifest(unit_panel(spark, sf), ["lulc"]).select(
        "lulc", "n_rows", "n_units", "year_first", "year_last",
        F.round("value_min", 4).alias("value_min"), F.round("value_max", 4).alias("value_max"),
        F.round("value_median", 6).alias("value_median"))


@query("pct_missing", with_("panel") + """SELECT (SELECT count(*) * 7 FROM matched_units)
    AS expected, count(*) AS present, round(100.0 * (1 - count(*) / (SELECT count(*) * 7
    FROM matched_units)), 3) AS pct_missing FROM panel""")
def pct_missing(spark, sf):
    return U.pct_missing(matched_units(spark, sf), unit_panel(spark, sf), 7)


LEV = with_("matched_units", m="""SELECT 'P1' AS pairing, CASE WHEN x1 < 0 THEN '' WHEN x1 > 9000
    THEN NULL ELSE lulc END AS stratum, zone, treat, gvar, pair_id FROM matched_units""",
    lev="""SELECT pairing, CASE WHEN grouping(stratum) = 1 THEN '' ELSE stratum END AS stratum,
    CASE WHEN grouping(zone) = 1 THEN '' ELSE zone END AS zone, count(*) AS n_units,
    CAST(sum(treat) AS BIGINT) AS n_treated, count(DISTINCT pair_id) AS n_pairs,
    count(DISTINCT CASE WHEN treat = 1 THEN gvar END) AS n_cohorts,
    min(CASE WHEN treat = 1 THEN gvar END) AS gvar_min,
    max(CASE WHEN treat = 1 THEN gvar END) AS gvar_max FROM m
    GROUP BY GROUPING SETS ((pairing), (pairing, stratum), (pairing, zone),
      (pairing, stratum, zone)) HAVING sum(treat) > 0 AND (grouping(stratum) = 1
      OR coalesce(stratum, '') <> '') AND (grouping(zone) = 1 OR coalesce(zone, '') <> '')""")


def _levels(spark, sf):
    m = matched_units(spark, sf)
    x = F.col("x1")
    return U.subset_levels(m.withColumn("pairing", F.lit("P1")).withColumn(
        "stratum", F.when(x < 0, "").when(x > 9000, None).otherwise(F.col("lulc"))))


query("subset_levels", LEV + "SELECT * FROM lev")(_levels)


@query("run_grid", LEV + """SELECT 'FP_UP-' || o.outcome || '-' || transform || '-' || stratum
    || '-' || CASE WHEN zone = '' THEN 'statewide' ELSE 'eco' || zone END AS run_id, o.outcome,
    transform, stratum, zone, n_treated, CAST(round(CAST(n_rows AS DOUBLE) * n_units / (SELECT
    n_units FROM lev WHERE stratum = '' AND zone = '')) AS BIGINT) AS est_rows FROM lev,
    (VALUES ('gpp', 'log1p'), ('gpp', 'none'), ('nep', 'none')) o(outcome, transform),
    (SELECT count(*) AS n_rows FROM lineitem) WHERE stratum <> '' AND n_treated >= 5""")
def run_grid(spark, sf):
    n = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))
    man = registry(spark, ["pairing", "outcome"], [("FP_UP", "gpp"), ("FP_UP", "nep")]
                   ).crossJoin(n)  # two rows, one row
    lev = _levels(spark, sf).withColumn("pairing", F.lit("FP_UP"))
    return U.run_grid(man, lev, P.PAIRINGS, P.OUTCOMES, 5).select(
        "run_id", "outcome", "transform", "stratum", "zone", "n_treated", "est_rows")


@query("run_grid_arms", LEV + """SELECT pairing || '-' || o.outcome || '-' || transform || '-' ||
    CASE WHEN stratum = '' THEN 'all' ELSE stratum END || '-' || CASE WHEN zone = '' THEN 'statewide'
    ELSE 'eco' || zone END AS run_id, pairing, o.outcome, transform, stratum, zone, n_treated,
    'attgt' AS estimator, CAST(shift AS INTEGER) AS base_shift, agg AS aggregations
    FROM (SELECT * EXCLUDE (pairing) FROM lev WHERE n_treated >= 5) l,
    (VALUES ('UP_UNP', 'pa', 0, 'calendar; dynamic; simple'), ('FP_UP', 'fire', 0, 'dynamic; simple'),
      ('TP_UP', 'thin', 1, 'dynamic; simple')) p(pairing, arm, shift, agg),
    (VALUES ('gpp', 'all', 'log1p'), ('gpp', 'all', 'none'), ('nbp', 'fire', 'none'))
      o(outcome, scope, transform)
    WHERE (scope = 'all' OR scope = arm) AND (arm = 'pa') = (stratum = '')
      AND EXISTS (FROM lev w WHERE w.stratum = l.stratum AND w.zone = '' AND w.n_treated >= 5)""")
def run_grid_arms(spark, sf):
    """Runs of three arms: scope of the outcome, shift, aggregations, floor of the whole."""
    n = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))
    man = registry(spark, ["pairing", "outcome"], [
        (p, o) for p in ("UP_UNP", "FP_UP", "TP_UP") for o in ("gpp", "nbp")]).crossJoin(n)  # one row
    lev = _levels(spark, sf).drop("pairing").crossJoin(  # three arms
        registry(spark, ["pairing"], [("UP_UNP",), ("FP_UP",), ("TP_UP",)]))
    return U.run_grid(man, lev, P.PAIRINGS, P.OUTCOMES, 5, estimator="attgt").select(
        "run_id", "pairing", "outcome", "transform", "stratum", "zone", "n_treated", "estimator",
        "base_shift", "aggregations")


@query("viable_cohorts", with_("panel") + """SELECT lulc, count(*) AS n_rows,
    count(DISTINCT unit_id) AS n_units FROM (SELECT *, max(year) OVER (PARTITION BY lulc) AS last
    FROM (SELECT * REPLACE (CASE WHEN gvar > 0 THEN gvar + 2 ELSE 0 END AS gvar) FROM panel))
    WHERE gvar = 0 OR gvar <= last GROUP BY lulc""")
def viable_cohorts(spark, sf):
    # cohorts two years later, so that some lie beyond the panel
    d = unit_panel(spark, sf).withColumn("gvar", F.when(F.col("gvar") > 0, F.col("gvar") + 2)
                                         .otherwise(0))
    return U.viable_cohorts(d, ["lulc"]).groupBy("lulc").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit_id").alias("n_units"))


@query("half_pairs", with_("panel", s="""SELECT lulc, pair_id, min(treat) AS a, max(treat) AS b
    FROM panel GROUP BY ALL""") + f"""SELECT lulc, count(*) AS n_pairs,
    {n_if("a = b")} AS n_half FROM s GROUP BY lulc""")
def half_pairs(spark, sf):
    return U.half_pairs(unit_panel(spark, sf), ["lulc"])


@query("balanced_panel", with_("panel", u="""SELECT lulc, unit_id, count(*) AS n FROM panel
    GROUP BY ALL""", y="SELECT lulc, count(DISTINCT year) AS ny FROM panel GROUP BY lulc")
    + """SELECT unit_id, year, round(value, 4) AS value FROM panel p WHERE unit_id IN
    (SELECT unit_id FROM u JOIN y USING (lulc) WHERE n = ny)""")
def balanced_panel(spark, sf):
    return U.balanced_panel(unit_panel(spark, sf), ["lulc"]).select(
        "unit_id", "year", F.round("value", 4).alias("value"))


@query("analysis_cells", with_("panel", c="""SELECT '' AS lulc, '' AS zone, value FROM panel
    UNION ALL SELECT lulc, '', value FROM panel UNION ALL SELECT '', zone, value FROM panel
    UNION ALL SELECT lulc, zone, value FROM panel""") + """SELECT lulc, zone, count(*) AS n,
    round(sum(value), 4) AS total FROM c GROUP BY lulc, zone""")
def cells(spark, sf):
    return analysis_cells(unit_panel(spark, sf), "lulc", "zone").groupBy("lulc", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
