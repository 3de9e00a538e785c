"""Data-quality jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import quality as Q
from panelspark.queries.base import (cohorts, event_frame, layer_values, matched_units, n_if, query,
                                     table, unit_panel, units, with_)


@query("value_profile", with_("layer_values", v="SELECT layer, year, CASE WHEN value > 48 THEN "
    "NULL ELSE value - 20 END AS value FROM layer_values") + f"""SELECT layer, year, count(*) AS n,
    round(100.0 * {n_if("value IS NULL")} / count(*), 3) AS pct_null,
    round(100.0 * {n_if("value = 0")} / count(*), 3) AS pct_zero,
    round(100.0 * {n_if("value < 0")} / count(*), 3) AS pct_negative,
    round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.99), 6) AS q99 FROM v GROUP BY ALL""")
def value_profile(spark, sf):
    v = layer_values(spark, sf).withColumn("value", F.when(
        F.col("value") <= 48, F.col("value") - 20))
    return Q.value_profile(v, ["layer", "year"]).withColumns({
        c: F.round(c, 6) for c in ("q01", "median", "q99")})


@query("id_integrity", f"""WITH s AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE
    l_returnflag = 'R' GROUP BY ALL), g AS (SELECT p_partkey AS k FROM part WHERE p_size > 3)
    SELECT {n_if("s.k IS NOT NULL")} AS n_ids, {n_if("n > 1")} AS n_duplicated,
    {n_if("g.k IS NULL")} AS n_outside, {n_if("s.k IS NULL")} AS n_absent
    FROM s FULL JOIN g ON s.k = g.k""")
def id_integrity(spark, sf):
    s = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("pixel_id"))
    g = table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("pixel_id"))
    return Q.id_integrity(s, g)


@query("layer_agreement", with_("layer_values", j="""SELECT a.value AS x, b.value AS y FROM
    layer_values a JOIN layer_values b ON a.pixel_id = b.pixel_id AND a.year = b.year
    AND a.layer = 'LA' AND b.layer = 'LR'""", r="""SELECT *, rank() OVER (ORDER BY x) + (count(*)
    OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER
    (PARTITION BY y) - 1) / 2.0 AS ry FROM j""") + """SELECT count(*) AS n, round(corr(x, y), 6)
    AS pearson, round(corr(rx, ry), 6) AS spearman, round(median(x), 6) AS median_a,
    round(median(y), 6) AS median_b, round(median(x) / median(y), 6) AS median_ratio FROM r""")
def layer_agreement(spark, sf):
    v = layer_values(spark, sf)
    d = Q.layer_agreement(v.where("layer = 'LA'"), v.where("layer = 'LR'"), ["pixel_id", "year"])
    return d.withColumns({c: F.round(c, 6) for c in d.columns if c != "n"})


@query("static_zero_mask", with_("layer_values", v="""SELECT pixel_id, year, CASE WHEN pixel_id
    % 10 = 0 OR value = 50 THEN 0 ELSE value END AS value FROM layer_values WHERE layer = 'LR'""",
    c=f"SELECT pixel_id, {n_if('value = 0')} AS z FROM v GROUP BY pixel_id",
    y="SELECT count(DISTINCT year) AS k FROM v") + f"""SELECT {n_if("z > 0")} AS n_ever_zero,
    {n_if("z = k")} AS n_always_zero, {n_if("z > 0")} = {n_if("z = k")} AS static FROM c, y""")
def static_zero_mask(spark, sf):
    v = layer_values(spark, sf).where("layer = 'LR'").withColumn("value", F.when(
        (F.col("pixel_id") % 10 == 0) | (F.col("value") == 50), 0.0).otherwise(F.col("value")))
    return Q.static_zero_mask(v)


@query("out_of_bounds", with_("layer_values") + f"""SELECT layer, count(value) AS n,
    {n_if("value < CASE layer WHEN 'LA' THEN 2 WHEN 'LR' THEN 10 END")} AS n_below,
    {n_if("value > CASE layer WHEN 'LA' THEN 49 WHEN 'LR' THEN 45 END")} AS n_above,
    min(value) AS value_min, max(value) AS value_max FROM layer_values GROUP BY layer""")
def out_of_bounds(spark, sf):
    return Q.out_of_bounds(layer_values(spark, sf), {"LA": (2, 49), "LR": (10, 45)})


@query("zone_codes", f"""WITH z AS (SELECT CASE WHEN c_nationkey = 3 THEN NULL WHEN c_nationkey < 7
    THEN CAST(c_nationkey AS VARCHAR) ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS z,
    count(*) AS n FROM customer GROUP BY ALL) SELECT count(*) AS n_codes, {n_if("z IS NULL")}
    AS n_null, {n_if("length(z) <> 2")} AS n_bad_width, 0::BIGINT AS n_spaces,
    0::BIGINT AS n_not_digits, {n_if("n < 60")} AS n_small FROM z""")
def zone_codes(spark, sf):
    k = F.col("c_nationkey")
    c = table(spark, sf, "customer").withColumn("zone", F.when(k == 3, None).when(
        k < 7, k.cast("string")).otherwise(F.lpad(k.cast("string"), 2, "0")))
    return Q.zone_codes(c, "zone", 2, 60)


@query("record_profile", with_("frame", p="""SELECT source_layer, pixel_id, count(*) AS k,
    count(DISTINCT event_year) AS ky FROM frame GROUP BY ALL""", a=f"""SELECT source_layer,
    CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_pixels, round(sum(k) / count(*), 4)
    AS rows_per_pixel, max(k) AS max_rows, {n_if("ky > 1")} AS n_multi_year FROM p GROUP BY ALL""",
    b=f"""SELECT source_layer, CAST(min(event_year) AS INTEGER) AS year_first,
    CAST(max(event_year) AS INTEGER) AS year_last, {n_if("event_year IS NULL")} AS n_undated
    FROM frame GROUP BY ALL""") + "SELECT * FROM a JOIN b USING (source_layer)")
def record_profile(spark, sf):
    return Q.record_profile(event_frame(spark, sf))


@query("units_ratio", with_("layer_values", v="""SELECT layer, CASE WHEN layer = 'LN' THEN value
    * 3 ELSE value END AS value FROM layer_values""", m="""SELECT layer, median(value) AS md
    FROM v WHERE value > 0 GROUP BY layer""") + """SELECT layer, round(md, 6) AS median,
    round(md / (SELECT md FROM m WHERE layer = 'LA'), 6) AS ratio, md / (SELECT md FROM m WHERE
    layer = 'LA') BETWEEN 1 / 2.5 AND 2.5 AS ok FROM m""")
def units_ratio(spark, sf):
    v = layer_values(spark, sf).withColumn("value", F.when(
        F.col("layer") == "LN", F.col("value") * 3).otherwise(F.col("value")))
    return Q.units_ratio(v, "LA").withColumns({c: F.round(c, 6) for c in ("median", "ratio")})


@query("sentinel_scan", with_("layer_values") + f"""SELECT layer, t.l::DOUBLE AS type_limit,
    count(value) AS n, {n_if("abs(value - t.l) <= abs(t.l) * 1e-6 + 1e-9")} AS n_hit
    FROM layer_values, (VALUES (50), (1), (-32768)) t(l) GROUP BY layer, t.l""")
def sentinel_scan(spark, sf):
    return Q.sentinel_scan(layer_values(spark, sf), ["layer"], [50.0, 1.0, -32768.0])


@query("late_degradation", f"""WITH a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
    count(*) AS n, {n_if("l_quantity = 50")} AS n_failed, {n_if("l_returnflag = 'R'")}
    AS n_exposed, {n_if("l_quantity = 50 AND l_returnflag = 'R'")} AS n_failed_exposed
    FROM lineitem GROUP BY ALL) SELECT *, round(100 * n_failed / n, 3) AS pct_failed,
    round((n_failed_exposed / n_exposed) / (n_failed / n), 3) AS enrichment FROM a""")
def late_degradation(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return Q.late_degradation(li, F.col("l_quantity") == 50, F.col("l_returnflag") == "R")


@query("column_profile", """SELECT column_name, count(*) AS n, count(*) - count(v) AS n_missing,
    round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS v_min, max(v) AS v_max
    FROM (SELECT 'p_size' AS column_name, CAST(nullif(p_size, 7) AS DOUBLE) AS v FROM part
    UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY column_name""")
def column_profile(spark, sf):
    p = table(spark, sf, "part").withColumn("p_size", F.nullif("p_size", F.lit(7)))
    return Q.column_profile(p, ["p_size", "p_retailprice"]).withColumns({
        c: F.round(c, 6) for c in ("mean", "sd")})


@query("group_invariants", """SELECT check_name, 0::BIGINT AS n_bad, true AS ok FROM (SELECT unnest([
    'id_present', 'status_known', 'group_implies_role', 'treated_has_cohort',
    'treated_has_one_event', 'treated_detected', 'control_without_event', 'offset_has_start',
    'suffix_matches_status', 'chain_in_code', 'counts_add_up', 'years_in_order']) AS check_name)
    WHERE (SELECT count(*) FROM customer) > 0""")
def group_invariants(spark, sf):
    from panelspark.queries.history import groups

    return Q.assertions(groups(spark, sf), Q.group_table_checks())


def _verified(spark, sf, g):
    from panelspark import profile as P
    from panelspark.operators.ledger import exclusion_rules
    from panelspark.queries.base import FIRST, LAST, detections, event_frame, units

    names = list(exclusion_rules(FIRST, LAST, True))
    return Q.assertions(g, Q.declared_checks(FIRST, LAST, names, P.GROUPS)).unionByName(
        Q.source_checks(g, units(spark, sf), event_frame(spark, sf), detections(spark, sf),
                        ["Tribal"], FIRST))


# counts of what breaks each rule, from the classification written in SQL
_VERIFY = """SELECT unnest(map_entries(MAP {'class_complete': 0, 'status_complete': 0,
    'eligibility_complete': 0, 'group_declared': 0, 'eligibility_declared': 0,
    'assigned_has_role': 0, 'role_has_group': 0, 'none_falls_through': 0, 'group_and_arm': 0,
    'group_and_stratum': 0, 'cohort_present': 0, 'cohort_absent': 0,
    'cohort_in_window': (SELECT count(*) FROM k_group WHERE grp IS NOT NULL AND ne = 1
      AND NOT yr BETWEEN 1996 AND 2000),
    'undisturbed_without_event': (SELECT count(*) FROM k_group WHERE ne > 0
      AND left(grp, 1) IN ('U', 'O')),
    'protected_before_cohort': (SELECT count(*) FROM k_group WHERE status = 'P' AND ne = 1
      AND grp IS NOT NULL AND est > yr),
    'keeps_early_protection': (SELECT CAST(count(*) = 0 AS BIGINT) FROM k_group
      WHERE grp = 'UP' AND est < 1996), 'none_invented': 0, 'tribal_set': 0, %s})) AS e"""


@query("group_verifier", with_("k_group", v=_VERIFY % """'row_count': 0, 'id_unique': 0, 'id_set':
    0, 'lulc_as_grid': 0, 'thin_present': 0, 'fire_present': 0, 'offset_set': 0,
    'detected_set': 0""") + """SELECT e.key AS check_name, CAST(e.value AS BIGINT) AS n_bad,
    e.value = 0 AS ok FROM v""")
def group_verifier(spark, sf):
    from panelspark.queries.history import groups

    return _verified(spark, sf, groups(spark, sf))


# the table damaged by cell number: lost, doubled, unclassed, moved, undetected, unset, emptied
@query("group_verifier_damaged", with_("k_group", "frame", "detections", "units",
    m="SELECT pixel_id % 50 AS m, pixel_id FROM units", v=(_VERIFY % """
    'row_count': (SELECT abs(count(*) FILTER (m = 2) - count(*) FILTER (m = 1)) FROM m),
    'id_unique': (SELECT count(*) FROM m WHERE m = 2), 'id_set': (SELECT count(*) FROM m WHERE m = 1),
    'lulc_as_grid': (SELECT count(*) FROM m WHERE m = 4),
    'thin_present': (SELECT count(DISTINCT pixel_id) FROM m JOIN frame USING (pixel_id)
      WHERE m = 7 AND arm = 'thin'), 'fire_present': (SELECT count(DISTINCT pixel_id) FROM m
      JOIN frame USING (pixel_id) WHERE m = 7 AND arm = 'fire'),
    'offset_set': (SELECT count(DISTINCT pixel_id) FROM m JOIN frame USING (pixel_id) WHERE m = 6
      AND arm = 'offset' AND event_year IS NOT NULL), 'detected_set': (SELECT count(DISTINCT
      pixel_id) FROM m JOIN detections USING (pixel_id) WHERE m = 5)""").replace(
    "'class_complete': 0", "'class_complete': (SELECT count(*) FROM m WHERE m = 3)")) + """SELECT
    e.key AS check_name, CAST(e.value AS BIGINT) AS n_bad, e.value = 0 AS ok FROM v""")
def group_verifier_damaged(spark, sf):
    from panelspark.queries.history import groups

    m = F.col("pixel_id") % 50
    g = groups(spark, sf).where(m != 1)
    g = g.withColumns({
        "class_code": F.when(m != 3, F.col("class_code")),
        "lulc": F.when(m == 4, "elsewhere").otherwise(F.col("lulc")),
        "n_detect": F.when(m == 5, 0).otherwise(F.col("n_detect")),
        "offset_start": F.when(m != 6, F.col("offset_start")),
        **{k: F.when(m == 7, 0).otherwise(F.col(k)) for k in ("n_thin", "n_fire", "n_events")},
        "undated_thin": (m != 7) & F.col("undated_thin")})
    return _verified(spark, sf, g.unionByName(g.where(m == 2)))


_PAIRS = """, p AS (SELECT pair_id, count(*) AS n, sum(treat) AS t, count(DISTINCT lulc) AS s,
    count(DISTINCT CASE WHEN gvar > 0 THEN gvar END) AS g FROM d GROUP BY pair_id),
    v AS (SELECT unnest(map_entries(MAP {'pairs_not_two': (SELECT count(*) FROM p WHERE n <> 2),
      'pairs_not_one_treated': (SELECT count(*) FROM p WHERE t <> 1),
      'pairs_split_stratum': (SELECT count(*) FROM p WHERE s > 1),
      'pairs_split_gvar': (SELECT count(*) FROM p WHERE g > 1),
      'duplicate_treated_cells': (SELECT count(*) - count(DISTINCT pixel_id) FROM d
        WHERE treat = 1)})) AS e) SELECT e.key AS check_name, CAST(e.value AS BIGINT) AS n_bad,
    e.value = 0 AS ok FROM v"""


@query("pair_structure", with_("matched_units", d="SELECT * FROM matched_units")[:-1] + _PAIRS)
def pair_structure(spark, sf):
    return Q.pair_structure(matched_units(spark, sf), "lulc")


# damaged by cell number: lost, doubled, moved to another stratum, another cohort, both treated
@query("pair_structure_damaged", with_("matched_units", d="""SELECT pair_id, pixel_id,
    CASE WHEN pixel_id % 20 = 5 THEN 1 ELSE treat END AS treat,
    CASE WHEN pixel_id % 20 = 3 THEN 'elsewhere' ELSE lulc END AS lulc,
    CASE WHEN pixel_id % 20 = 4 THEN gvar + 1 WHEN pixel_id % 20 = 6 THEN 1990 ELSE gvar END AS gvar
    FROM (SELECT * FROM matched_units UNION ALL SELECT * FROM matched_units
      WHERE pixel_id % 20 = 2) WHERE pixel_id % 20 <> 1""")[:-1] + _PAIRS)
def pair_structure_damaged(spark, sf):
    u = matched_units(spark, sf)
    m = F.col("pixel_id") % 20
    d = u.unionByName(u.where(m == 2)).where(m != 1)
    return Q.pair_structure(d.withColumns({
        "treat": F.when(m == 5, 1).otherwise(F.col("treat")),
        "lulc": F.when(m == 3, "elsewhere").otherwise(F.col("lulc")),
        "gvar": F.when(m == 4, F.col("gvar") + 1).when(m == 6, 1990).otherwise(F.col("gvar"))}), "lulc")


_PANEL_CHECKS = """, a AS (SELECT pair_id, pixel_id, treat, count(*) AS n, min(gvar) AS g,
      max(gvar) AS h FROM un GROUP BY ALL),
    b AS (SELECT pair_id, pixel_id, treat, count(*) AS m, min(gvar) AS w FROM ma GROUP BY ALL),
    ab AS (SELECT a.n, a.g, a.h, b.m, b.w FROM a FULL JOIN b ON a.pair_id = b.pair_id
      AND a.pixel_id = b.pixel_id AND a.treat = b.treat),
    ids AS (SELECT unit_id, count(*) AS k, max(gvar) FILTER (treat = 1) AS c FROM un GROUP BY 1),
    v AS (SELECT unnest(map_entries(MAP {
      'unit_not_matched': (SELECT coalesce(sum(n), 0) FROM ab WHERE m IS NULL),
      'cohort_differs': (SELECT coalesce(sum(n), 0) FROM ab WHERE m IS NOT NULL AND n IS NOT NULL
        AND (g IS DISTINCT FROM w OR h IS DISTINCT FROM w)),
      'matched_not_unit': (SELECT coalesce(sum(m), 0) FROM ab WHERE n IS NULL),
      'unit_id_repeated': (SELECT count(*) - count(DISTINCT unit_id) FROM un),
      'unit_without_rows': (SELECT count(*) FROM ids WHERE unit_id NOT IN (SELECT unit_id FROM pa)),
      'cohort_not_viable': (SELECT count(*) FROM ids WHERE c > (SELECT max(year) FROM pa)),
      'row_of_no_unit': (SELECT count(*) FROM pa WHERE unit_id NOT IN (SELECT unit_id FROM un)),
      'row_repeated': (SELECT count(*) - count(DISTINCT (unit_id, year)) FROM pa),
      'row_without_value': (SELECT count(*) FROM pa WHERE value IS NULL),
      'row_out_of_window': (SELECT count(*) FROM pa WHERE year NOT BETWEEN 1995 AND 2001),
      'value_without_log': (SELECT count(*) FROM pa WHERE value < 0),
      'year_absent': (SELECT count(*) FROM range(1995, 2002) y(year) WHERE year NOT IN
        (SELECT year FROM pa))})) AS e)
    SELECT e.key AS check_name, CAST(e.value AS BIGINT) AS n_bad, e.value = 0 AS ok FROM v"""


@query("panel_verifier", with_("panel", "cohorts", un="SELECT * FROM matched_units",
    ma="SELECT m.* REPLACE (c.gvar AS gvar) FROM matched_units m JOIN cohorts c USING (pixel_id)",
    pa="SELECT * FROM panel")[:-1] + _PANEL_CHECKS)
def panel_verifier(spark, sf):
    u = matched_units(spark, sf)
    source = u.drop("gvar").join(cohorts(spark, sf).select("pixel_id", "gvar"), "pixel_id")
    return Q.panel_verifier(u, source, unit_panel(spark, sf), 1995, 2001)


# each check meets a damage of its own: lost, doubled and renamed units, other cohorts, lost,
# doubled and moved rows, no values, negative values, a year that nobody has
@query("panel_verifier_damaged", with_("panel", "cohorts", un="""SELECT * REPLACE (
      CASE WHEN pixel_id % 40 = 3 THEN -pixel_id ELSE pair_id END AS pair_id,
      CASE WHEN pixel_id % 40 = 4 THEN gvar + 1 WHEN pixel_id % 40 = 5 AND treat = 1 THEN 2105
        ELSE gvar END AS gvar) FROM (SELECT * FROM matched_units UNION ALL SELECT * FROM matched_units
      WHERE pixel_id % 40 = 2) WHERE pixel_id % 40 <> 1""",
    ma="SELECT m.* REPLACE (c.gvar AS gvar) FROM matched_units m JOIN cohorts c USING (pixel_id)",
    pa="""SELECT * REPLACE (CASE WHEN pixel_id % 40 = 8 THEN year + 30 ELSE year END AS year,
      CASE WHEN pixel_id % 40 = 9 THEN NULL WHEN pixel_id % 40 = 10 THEN -value ELSE value END
        AS value) FROM (SELECT * FROM panel UNION ALL SELECT * FROM panel WHERE pixel_id % 40 = 7)
      WHERE pixel_id % 40 <> 6 AND (year <> 1998 OR pixel_id % 40 = 8)""")[:-1] + _PANEL_CHECKS)
def panel_verifier_damaged(spark, sf):
    whole, rows, m = matched_units(spark, sf), unit_panel(spark, sf), F.col("pixel_id") % 40
    source = whole.drop("gvar").join(cohorts(spark, sf).select("pixel_id", "gvar"), "pixel_id")
    u = whole.unionByName(whole.where(m == 2)).where(m != 1).withColumns({
        "pair_id": F.when(m == 3, -F.col("pixel_id")).otherwise(F.col("pair_id")),
        "gvar": F.when(m == 4, F.col("gvar") + 1).when(
            (m == 5) & (F.col("treat") == 1), 2105).otherwise(F.col("gvar"))})
    p = rows.unionByName(rows.where(m == 7)).where(
        (m != 6) & ((F.col("year") != 1998) | (m == 8))).withColumns({
            "year": F.when(m == 8, F.col("year") + 30).otherwise(F.col("year")),
            "value": F.when(m == 10, -F.col("value")).when(m != 9, F.col("value"))})
    return Q.panel_verifier(u, source, p, 1995, 2001)


@query("unit_invariants", with_("matched_units", c=f"""SELECT {n_if("treat = 1 AND gvar < 1996")}
    AS b FROM matched_units""") + """SELECT check_name, CASE WHEN check_name =
    'treated_gvar_in_range' THEN b ELSE 0 END AS n_bad, NOT (check_name = 'treated_gvar_in_range'
    AND b > 0) AS ok FROM c, (SELECT unnest(['treat_binary', 'control_gvar_zero',
    'treated_gvar_positive', 'treated_gvar_in_range', 'pair_present']) AS check_name)""")
def unit_invariants(spark, sf):
    return Q.assertions(matched_units(spark, sf), Q.unit_checks(1996, 2001))


@query("source_reconcile", with_("k_hist", "units") + f"""SELECT {n_if("true")} AS n_a,
    {n_if("true")} AS n_b, {n_if("true")} AS n_both, 0::BIGINT AS only_a, 0::BIGINT AS only_b,
    true AS equal FROM k_hist""")
def source_reconcile(spark, sf):
    from panelspark.plans.classify import event_entries
    from panelspark.queries.history import groups

    return Q.source_reconcile(groups(spark, sf), event_entries(event_frame(spark, sf)))


@query("pool_composition", with_("k_group", n="""SELECT grp AS analysis_group, zone, count(*) AS n
    FROM k_group JOIN units USING (pixel_id) WHERE grp IN ('UP', 'UNP') GROUP BY ALL""", s="""SELECT
    *, round(100.0 * n / sum(n) OVER (PARTITION BY analysis_group), 2) AS pct FROM n""")
    + "SELECT *, max(pct) OVER (PARTITION BY analysis_group) AS top_pct FROM s")
def pool_composition(spark, sf):
    from panelspark.queries.history import groups

    return Q.pool_composition(groups(spark, sf), units(spark, sf).select("pixel_id", "zone"),
                              ["UP", "UNP"])


@query("field_profile", """SELECT field, count(*) AS n, count(*) - count(v) AS n_missing,
    0::BIGINT AS n_blank, count(DISTINCT v) AS n_distinct FROM (SELECT 'p_brand' AS field,
    nullif(p_brand, 'Brand#7') AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part)
    GROUP BY field""")
def field_profile(spark, sf):
    p = table(spark, sf, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#7")))
    return Q.field_profile(p, ["p_brand", "p_type"])


@query("join_cardinality", """WITH s AS (SELECT o_orderkey, o_custkey FROM orders WHERE
    left(md5('7:' || o_custkey), 8) < '40000000'), m AS (SELECT l_orderkey, count(*) AS m
    FROM lineitem GROUP BY ALL), j AS (SELECT coalesce(m, 0) AS m FROM s LEFT JOIN m
    ON l_orderkey = o_orderkey) SELECT count(*) AS n_sampled, CAST(sum(m) AS BIGINT) AS n_joined,
    max(m) AS max_fanout, count(*) FILTER (m > 0) AS n_hit, (SELECT count(*) FROM orders)
    AS n_total, CAST(round(sum(m) * (SELECT count(*) FROM orders) / count(*)) AS BIGINT)
    AS n_estimated FROM j""")
def join_cardinality(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return Q.join_cardinality(o, li, ["o_orderkey"], "o_custkey", 0.25, 7)


@query("lookup_audit", f"""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer
    GROUP BY ALL), b AS (SELECT DISTINCT s_nationkey AS k, 1 AS m FROM supplier WHERE
    s_nationkey < 20) SELECT {n_if("a.k IS NOT NULL")} AS n_ids,
    {n_if("a.k IS NOT NULL AND b.k IS NOT NULL")} AS n_matched, {n_if("b.k IS NULL")}
    AS n_unmatched, {n_if("a.k IS NULL")} AS n_unused, CAST(coalesce(sum(n) FILTER
    (b.k IS NULL), 0) AS BIGINT) AS n_rows_without_cohort FROM a FULL JOIN b ON a.k = b.k""")
def lookup_audit(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit(" n"), "c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").where("s_nationkey < 20").select(
        F.concat(F.lit("N"), "s_nationkey").alias("k"), F.col("s_suppkey").alias("year"))
    return Q.lookup_audit(c, "k", s, "k", "year")
