"""Lookups, crosswalks, set operations, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators import lookups as J
from panelspark.operators.core import registry
from panelspark.queries.base import (cohorts, detections, event_log, layer_values,
                                     matched_units, n_if, query, table, units, with_,
                                     yearly_value)


@query("align_ids", with_("units", "yearly_value") + """SELECT u.pixel_id, v.year,
    round(v.value, 4) AS value FROM units u LEFT JOIN (SELECT * FROM yearly_value
    WHERE year = 2001) v USING (pixel_id)""")
def align_ids(spark, sf):
    v = yearly_value(spark, sf).where(F.col("year") == 2001)
    return J.align(units(spark, sf).select("pixel_id"), v).select(
        "pixel_id", "year", F.round("value", 4).alias("value"))


@query("semi_join", """SELECT o_orderstatus, count(*) AS n FROM orders WHERE (o_custkey)
    IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL""")
def semi_join(spark, sf):
    keep = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("o_custkey"))
    return J.semi(table(spark, sf, "orders"), keep, ["o_custkey"]).groupBy(
        "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("composite_semi_join", """SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem
    WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity = 50) GROUP BY ALL""")
def composite_semi_join(spark, sf):
    li = table(spark, sf, "lineitem")
    hot = li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50))
    return J.semi(li, hot, ["l_partkey", "l_suppkey"]).groupBy(
        "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("anti_join", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("c_custkey"))
    return J.anti(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


PUB = [("A", "1 URGENT", "Low", "m1", "treatment_LMH"),
       ("A", "2 HIGH", "High", "m2", "treatment_LMH"),
       ("B", "5 LOW", "Low", "m1", "treatment_LMH")]
ALIAS = [("A", "2-high", "alias", "Medium", "m9", "disturbance_only"),
         ("A", "3 - Medium", "assigned", "Medium", "m3", "treatment_LMH"),
         ("A", "<MISSING>", "assigned", "N/A", "m0", "non_disturbing")]


def _xwalk(spark):
    cols = ["intensity", "method", "record_class"]
    return J.crosswalk_table(
        registry(spark, ["table", "activity_key", *cols], PUB),
        registry(spark, ["table", "observed_activity", "resolution", *cols], ALIAS))


@query("crosswalk_join", """WITH x(k, intensity, origin) AS (VALUES
    ('1-URGENT', 'Low', 'published'), ('2-HIGH', 'High', 'published'),
    ('3-MEDIUM', 'Medium', 'alias_assigned'), ('', 'N/A', 'alias_assigned')),
    o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS k FROM orders)
    SELECT coalesce(intensity, 'none') AS intensity, coalesce(origin, 'unresolved') AS origin,
    count(*) AS n FROM o LEFT JOIN x USING (k) GROUP BY ALL""")
def crosswalk_join(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "").otherwise(
        F.lower("o_orderpriority")).alias("key_value"))
    return J.crosswalk_join(o, "A", _xwalk(spark)).groupBy(
        F.coalesce("intensity", F.lit("none")).alias("intensity"),
        F.coalesce("origin", F.lit("unresolved")).alias("origin")).agg(
        F.count(F.lit(1)).alias("n"))


@query("key_profile", """WITH x(k, origin) AS (VALUES ('1-URGENT', 'published'),
    ('2-HIGH', 'published'), ('3-MEDIUM', 'alias_assigned')) SELECT
    coalesce(origin, 'unresolved') AS resolved_by, count(*) AS n_records,
    count(DISTINCT o_orderpriority) AS n_keys FROM orders LEFT JOIN x
    ON k = o_orderpriority GROUP BY ALL""")
def key_profile(spark, sf):
    from panelspark.operators.quality import key_profile as op

    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "key_value")
    return op(o, "A", _xwalk(spark))


@query("folded_lookup", """SELECT n_regionkey, count(*) AS n FROM customer JOIN nation
    ON c_nationkey = n_nationkey GROUP BY ALL""")
def folded_lookup(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.concat(
        F.lit("  nation_"), F.col("c_nationkey").cast("string"), F.lit(" ")))
    return J.folded_lookup(c, "k", table(spark, sf, "nation"), "n_name",
                           ["n_regionkey"]).groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("n"))


@query("program_lookup", """SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN n_nationkey END
    AS start_year FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def program_lookup(spark, sf):
    n = table(spark, sf, "nation").where(F.col("n_regionkey") == 1)
    c = table(spark, sf, "customer").withColumn("k", F.concat(
        F.lit("Nation_"), F.col("c_nationkey").cast("string")))
    return J.folded_lookup(c, "k", n, "n_name", ["n_nationkey"]).select(
        "c_custkey", F.col("n_nationkey").alias("start_year"))


@query("fan_out_units", with_("panel") + """SELECT pair_id, year, count(*) AS n,
    round(sum(value), 4) AS total FROM panel GROUP BY ALL""")
def fan_out_units(spark, sf):
    from panelspark.queries.base import unit_panel

    return unit_panel(spark, sf).groupBy("pair_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("pair_attributes", with_("matched_units") + """SELECT a.unit_id, b.gvar AS pair_gvar,
    b.zone AS pair_zone FROM matched_units a JOIN matched_units b ON a.pair_id = b.pair_id
    AND b.treat = 1""")
def pair_attributes(spark, sf):
    m = matched_units(spark, sf)
    return J.pair_attribute(m, "pair_id", "treat", {
        "gvar": "pair_gvar", "zone": "pair_zone"}).select("unit_id", "pair_gvar", "pair_zone")


@query("must_match", """SELECT o_custkey, count(*) AS n, c_mktsegment FROM orders
    JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def must_match(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return J.must_match(o, c, ["o_custkey"], ["c_mktsegment"])


@query("prefixed_join", """SELECT c_custkey, c_name AS name, n_name AS match_name FROM customer
    JOIN nation ON c_nationkey = n_nationkey""")
def prefixed_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"),
                                            F.col("c_nationkey").alias("k"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"),
                                          F.col("n_name").alias("name"))
    return J.prefixed_join(c, n, ["k"], ["name"], "match_").drop("k")


@query("edit_distance", """SELECT t.p_name, d.key AS nearest, d.dist AS distance FROM
    (SELECT DISTINCT p_name FROM part) t, LATERAL (SELECT key, levenshtein(upper(t.p_name),
    upper(key)) AS dist FROM (VALUES ('blue bolt'), ('RED WIDGET'), ('Small Gear'),
    ('green')) v(key) ORDER BY dist, key LIMIT 1) d""")
def edit_distance(spark, sf):
    reg = registry(spark, ["key"], [("blue bolt",), ("RED WIDGET",), ("Small Gear",),
                                    ("green",)])
    return J.nearest_key(table(spark, sf, "part"), "p_name", reg, "key").withColumn(
        "distance", F.col("distance").cast("long"))


@query("reconcile_counts", with_("event_log", "detections", a="""SELECT event_year AS year,
    count(*) AS n FROM event_log WHERE token = 'F4' GROUP BY ALL""", b="""SELECT year,
    count(*) AS n FROM detections GROUP BY ALL""") + """SELECT year, coalesce(a.n, 0) AS n_a,
    coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference
    FROM a FULL JOIN b USING (year)""")
def reconcile_counts(spark, sf):
    e = event_log(spark, sf).where(F.col("token") == "F4").withColumnRenamed(
        "event_year", "year")
    return J.reconcile(e, detections(spark, sf), ["year"])


@query("set_reconcile", with_("event_log", "detections", a="SELECT DISTINCT pixel_id FROM "
    "event_log WHERE token = 'F4'", b="SELECT DISTINCT pixel_id FROM detections")
    + f"""SELECT {n_if("a.pixel_id IS NOT NULL")} AS n_a,
    {n_if("b.pixel_id IS NOT NULL")} AS n_b,
    {n_if("a.pixel_id IS NOT NULL AND b.pixel_id IS NOT NULL")} AS n_both,
    {n_if("b.pixel_id IS NULL")} AS only_a, {n_if("a.pixel_id IS NULL")} AS only_b,
    {n_if("b.pixel_id IS NULL")} = 0 AND {n_if("a.pixel_id IS NULL")} = 0 AS equal
    FROM a FULL JOIN b ON a.pixel_id = b.pixel_id""")
def set_reconcile(spark, sf):
    e = event_log(spark, sf).where(F.col("token") == "F4")
    return J.set_equal(e, detections(spark, sf), "pixel_id")


@query("layer_pairs", with_("layer_values") + """SELECT a.year, count(*) AS n,
    round(sum(a.value - b.value), 4) AS sum_diff FROM layer_values a JOIN layer_values b
    ON a.pixel_id = b.pixel_id AND a.year = b.year AND a.layer = 'LA' AND b.layer = 'LR'
    GROUP BY a.year""")
def layer_pairs(spark, sf):
    v = layer_values(spark, sf)
    a = v.where(F.col("layer") == "LA").select("pixel_id", "year", F.col("value").alias("va"))
    b = v.where(F.col("layer") == "LR").select("pixel_id", "year", F.col("value").alias("vb"))
    return a.join(b, ["pixel_id", "year"]).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("va") - F.col("vb")), 4).alias("sum_diff"))


@query("renamed_key_join", with_("event_log", "detections", a="""SELECT event_year, count(*)
    AS n_events FROM event_log GROUP BY ALL""", b="""SELECT year, count(*) AS n_det FROM
    detections GROUP BY ALL""") + "SELECT year, n_events, n_det FROM a JOIN b ON event_year = year")
def renamed_key_join(spark, sf):
    a = event_log(spark, sf).groupBy("event_year").agg(F.count(F.lit(1)).alias("n_events"))
    b = detections(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n_det"))
    return a.withColumnRenamed("event_year", "year").join(b, "year")


@query("side_sources", with_("k_group", m="""SELECT * FROM (VALUES ('UP_UNP', 'UP', 1),
    ('UP_UNP', 'UNP', 0), ('ONP_UNP', 'ONP', 1), ('ONP_UNP', 'UNP', 0), ('FP_UP', 'F2P', 1),
    ('FP_UP', 'F3P', 1), ('FP_UP', 'F4P', 1), ('FP_UP', 'UP', 0), ('FNP_UNP', 'F2NP', 1),
    ('FNP_UNP', 'F3NP', 1), ('FNP_UNP', 'F4NP', 1), ('FNP_UNP', 'UNP', 0), ('TP_UP', 'T1P', 1),
    ('TP_UP', 'T2P', 1), ('TP_UP', 'T3P', 1), ('TP_UP', 'UP', 0), ('TNP_UNP', 'T1NP', 1),
    ('TNP_UNP', 'T2NP', 1), ('TNP_UNP', 'T3NP', 1), ('TNP_UNP', 'UNP', 0)) v(p, g, t)""")
    + """SELECT p AS pairing, CAST(t AS BIGINT) AS treat, grp AS analysis_group, count(*) AS n
    FROM k_group JOIN m ON g = grp GROUP BY ALL""")
def side_sources(spark, sf):
    from panelspark.queries.history import groups

    g = groups(spark, sf).where(F.col("analysis_group").isNotNull())
    return J.side_source(P.PAIRINGS, g, g).groupBy("pairing", "treat", "analysis_group").agg(
        F.count(F.lit(1)).alias("n"))


@query("number_runs", with_("event_log", d="""SELECT DISTINCT token, pixel_id FROM event_log""", i="""SELECT *, pixel_id - row_number() OVER (PARTITION BY token
    ORDER BY pixel_id) AS g FROM d""") + """SELECT token, min(pixel_id) AS run_first,
    max(pixel_id) AS run_last, count(*) AS n FROM i GROUP BY token, g""")
def number_runs(spark, sf):
    from panelspark.operators.support import number_runs as op

    return op(event_log(spark, sf), ["token"], "pixel_id")


@query("run_compaction", with_("cohorts", "yearly_value", i="""SELECT pixel_id, year, year -
    row_number() OVER (PARTITION BY pixel_id ORDER BY year) AS g FROM yearly_value""",
    r="""SELECT pixel_id, min(year) AS a, max(year) AS b, count(*) AS n FROM i
    GROUP BY pixel_id, g""") + """SELECT pixel_id, string_agg(CASE WHEN a = b THEN
    CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges, count(*) AS n_runs,
    CAST(sum(n) AS BIGINT) AS n_numbers FROM r GROUP BY pixel_id""")
def run_compaction(spark, sf):
    from panelspark.operators.support import number_ranges, number_runs as op

    return number_ranges(op(yearly_value(spark, sf), ["pixel_id"], "year"), ["pixel_id"])


@query("wide_reshape", with_("cohorts") + """SELECT lulc, """ + ", ".join(
    f'count(*) FILTER (gvar = {g}) AS "{g}"' for g in (0, *range(1995, 2002))).replace(
    "count(*) FILTER", "nullif(count(*) FILTER").replace(") AS", "), 0) AS")
    + " FROM cohorts GROUP BY lulc")
def wide_reshape(spark, sf):
    from panelspark.operators.support import wide_by

    n = cohorts(spark, sf).groupBy("lulc", F.col("gvar").cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n"))
    return wide_by(n, ["lulc"], "g", ["0", *map(str, range(1995, 2002))], "n")


@query("union_intersect", """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM
    customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*)
    FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier
    WHERE s_acctbal > 5000) UNION ALL SELECT 'all', (SELECT count(*) FROM customer)
    + (SELECT count(*) FROM supplier)""")
def union_intersect(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    one = F.count(F.lit(1)).alias("n")
    a = c.union(s.select("k")).distinct().agg(one).select(F.lit("union").alias("op"), "n")
    b = c.intersect(s.where(F.col("s_acctbal") > 5000).select("k")).agg(one).select(
        F.lit("intersect").alias("op"), "n")
    d = c.union(s.select("k")).agg(one).select(F.lit("all").alias("op"), "n")
    return a.union(b).union(d)
