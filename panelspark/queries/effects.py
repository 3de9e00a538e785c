"""Group-time effects, aggregates and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import did
from panelspark.operators.units import balanced_panel
from panelspark.plans.estimate import estimation_rows
from panelspark.queries.base import query, unit_panel, with_
from panelspark.session import cut_lineage

ROWS = with_("panel", r="""SELECT lulc, unit_id, pair_id, gvar, year, ln(1 + value) AS y
    FROM panel""", cm="""SELECT lulc, gvar, year, count(*) AS n, avg(y) AS m FROM r
    GROUP BY ALL""", u="""SELECT unit_id FROM panel GROUP BY unit_id HAVING count(*) = 7""",
    br="SELECT * FROM r WHERE unit_id IN (SELECT unit_id FROM u)",
    bm="SELECT gvar, year, count(*) AS n, avg(y) AS m FROM br GROUP BY ALL",
    gt="""SELECT a.gvar, a.year, a.year - a.gvar AS e, b.year AS base_year, a.n AS n_gt,
      (a.m - b.m) - (c.m - d.m) AS att FROM bm a JOIN bm b ON a.gvar = b.gvar AND b.year =
      CASE WHEN a.year < a.gvar THEN a.year - 1 ELSE a.gvar - 1 END
      JOIN bm c ON c.gvar = 0 AND c.year = a.year JOIN bm d ON d.gvar = 0 AND d.year = b.year
      WHERE a.gvar > 0""",
    fx="""SELECT a.lulc, a.gvar, a.year, a.year - a.gvar AS e, b.year AS base_year, a.n AS n_gt,
      (a.m - b.m) - (c.m - d.m) AS att FROM cm a JOIN cm b ON a.lulc = b.lulc AND a.gvar = b.gvar
      AND b.year = a.gvar - 1 AND a.year <> b.year
      JOIN cm c ON c.lulc = a.lulc AND c.gvar = 0 AND c.year = a.year
      JOIN cm d ON d.lulc = a.lulc AND d.gvar = 0 AND d.year = b.year WHERE a.gvar > 0""")


def rows(spark, sf):
    return estimation_rows(unit_panel(spark, sf), ["lulc"], F.lit("log1p"))


def balanced(spark, sf):
    return cut_lineage(balanced_panel(rows(spark, sf)))


def _r(d, *cols):
    return d.withColumns({c: F.round(c, 6) for c in cols})


@query("cohort_means", ROWS + "SELECT lulc, gvar, year, n, round(m, 6) AS ybar FROM cm")
def cohort_means(spark, sf):
    return _r(did.cell_means(rows(spark, sf), ["lulc"]), "ybar")


@query("att_gt", ROWS + """SELECT gvar, year, CAST(e AS INTEGER) AS e, base_year, n_gt,
    round(att, 6) AS att FROM gt""")
def att_gt(spark, sf):
    g = did.group_time(did.cell_means(balanced(spark, sf), []), [])
    return _r(g.drop("n_gb"), "att")


def _agg(spark, sf, est, kind, by):
    d = balanced(spark, sf) if est == "attgt" else rows(spark, sf)
    a = did.group_time(did.cell_means(d, by), by, "varying" if est == "attgt" else "fixed")
    w = did.target_weights(a, by, kind)
    return _r(did.aggregate(w, by), "estimate")


AGG = ("round(sum(att * n_gt) / sum(n_gt), 6) AS estimate, count(*) AS n_effects, "
       "count(DISTINCT gvar) AS n_cohorts")


@query("att_dynamic", ROWS + f"SELECT CAST(e AS INTEGER) AS time, {AGG} FROM gt GROUP BY e")
def att_dynamic(spark, sf):
    return _agg(spark, sf, "attgt", "event", [])


@query("att_calendar", ROWS + f"SELECT year AS time, {AGG} FROM gt WHERE e >= 0 GROUP BY year")
def att_calendar(spark, sf):
    return _agg(spark, sf, "attgt", "calendar", [])


@query("att_simple", ROWS + f"SELECT 0 AS time, {AGG} FROM gt WHERE e >= 0")
def att_simple(spark, sf):
    return _agg(spark, sf, "attgt", "simple", [])


@query("etwfe_event", ROWS + f"SELECT lulc, CAST(e AS INTEGER) AS time, {AGG} FROM fx "
       "GROUP BY lulc, e")
def etwfe_event(spark, sf):
    return _agg(spark, sf, "etwfe", "event", ["lulc"])


@query("etwfe_calendar", ROWS + f"SELECT lulc, year AS time, {AGG} FROM fx WHERE e >= 0 "
       "GROUP BY lulc, year")
def etwfe_calendar(spark, sf):
    return _agg(spark, sf, "etwfe", "calendar", ["lulc"])


@query("att_overall", ROWS + """, t AS (SELECT e, sum(att * n_gt) / sum(n_gt) AS est FROM gt
    WHERE e >= 0 GROUP BY e) SELECT round(avg(est), 6) AS estimate, count(*) AS n_targets
    FROM t""")
def att_overall(spark, sf):
    a = did.group_time(did.cell_means(balanced(spark, sf), []), [])
    w = did.aggregate(did.target_weights(a, [], "event"), [])
    return _r(did.overall_row(w, [], "event"), "estimate")


@query("always_treated_level", ROWS + """SELECT a.lulc, a.gvar, a.year, 'level' AS kind,
    round(a.m - c.m, 6) AS level_difference FROM cm a JOIN cm c ON a.lulc = c.lulc
    AND a.year = c.year AND c.gvar = 0 WHERE a.gvar = 1995""")
def always_treated_level(spark, sf):
    return _r(did.always_treated_levels(did.cell_means(rows(spark, sf), ["lulc"]), ["lulc"],
                                        1995), "level_difference")


SCORE = """, w AS (SELECT *, n_gt / sum(n_gt) OVER (PARTITION BY lulc, e) AS w FROM fx),
    k AS (SELECT lulc, e, gvar, year, w AS c FROM w UNION ALL SELECT lulc, e, gvar, base_year, -w
      FROM w UNION ALL SELECT lulc, e, 0, year, -w FROM w UNION ALL
      SELECT lulc, e, 0, base_year, w FROM w),
    kc AS (SELECT lulc, e, gvar, year, sum(c) AS c FROM k GROUP BY ALL),
    sc AS (SELECT r.lulc, e, pair_id, sum(c / n * (y - m)) AS s FROM r JOIN cm
      USING (lulc, gvar, year) JOIN kc USING (lulc, gvar, year) GROUP BY ALL) """


@query("etwfe_cluster_se", ROWS + SCORE + """SELECT lulc, CAST(e AS INTEGER) AS time,
    round(sqrt(sum(s * s)), 6) AS std_error, count(*) AS n_clusters FROM sc GROUP BY lulc, e""")
def etwfe_cluster_se(spark, sf):
    d = rows(spark, sf)
    m = did.cell_means(d, ["lulc"])
    w = did.target_weights(did.group_time(m, ["lulc"], "fixed"), ["lulc"], "event")
    return _r(did.clustered_se(did.pair_scores(d, m, w, ["lulc"]), ["lulc"]), "std_error")


ATT_SCORE = """, w AS (SELECT *, n_gt / sum(n_gt) OVER (PARTITION BY e) AS w,
    sum(n_gt * att) OVER (PARTITION BY e) / sum(n_gt) OVER (PARTITION BY e) AS th,
    sum(n_gt) OVER (PARTITION BY e) AS nk FROM gt),
    k AS (SELECT e, gvar, year, w AS c FROM w UNION ALL SELECT e, gvar, base_year, -w FROM w
      UNION ALL SELECT e, 0, year, -w FROM w UNION ALL SELECT e, 0, base_year, w FROM w),
    kc AS (SELECT e, gvar, year, sum(c) AS c FROM k GROUP BY ALL),
    z AS (SELECT e, pair_id, c / n * (y - m) AS s FROM br JOIN bm USING (gvar, year)
      JOIN kc USING (gvar, year) UNION ALL SELECT e, pair_id, (att - th) / nk FROM w
      JOIN (SELECT DISTINCT unit_id, pair_id, gvar FROM br) USING (gvar)),
    sc AS (SELECT e, pair_id, sum(s) AS s FROM z GROUP BY ALL) """


def tail(z: str) -> str:
    """SQL of the two-sided normal tail, by Simpson's rule in 400 steps."""
    return f"""CASE WHEN {z} > 8 THEN 0.0 ELSE greatest(1 - sqrt(2 / pi()) * {z} / 1200 * list_sum(
      list_transform(range(0, 401), lambda i: exp(-(({z} * i / 400) ** 2) / 2) * CASE
        WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)), 0.0) END"""


@query("att_cluster_se", ROWS + ATT_SCORE + """SELECT CAST(e AS INTEGER) AS time,
    round(sqrt(sum(s * s)), 6) AS std_error, count(*) AS n_clusters FROM sc GROUP BY e""")
def att_cluster_se(spark, sf):
    d = balanced(spark, sf)
    m = did.cell_means(d, [])
    w = did.target_weights(did.group_time(m, []), [], "event")
    return _r(did.clustered_se(did.pair_scores(d, m, w, [], random_weights=True), []),
              "std_error")


@query("estimate_rows", ROWS + SCORE + """, es AS (SELECT lulc, e, sum(att * n_gt) / sum(n_gt)
    AS est FROM fx GROUP BY ALL), se AS (SELECT lulc, e, sqrt(sum(s * s)) AS se FROM sc
    GROUP BY ALL) SELECT lulc, CAST(e AS INTEGER) AS time, round(est, 6) AS estimate,
    round(est - 1.959963984540054 * se, 6) AS conf_low,
    round(est + 1.959963984540054 * se, 6) AS conf_high, round(est / se, 5) AS statistic
    FROM es JOIN se USING (lulc, e)""")
def estimate_rows(spark, sf):
    d = did.estimate(rows(spark, sf), ["lulc"], "etwfe", "event")
    return _r(d, "estimate", "conf_low", "conf_high").select(
        "lulc", "time", "estimate", "conf_low", "conf_high", F.round("statistic", 5)
        .alias("statistic"))


@query("estimate_p_values", ROWS + ATT_SCORE + f""", v AS (SELECT e, any_value(th) AS est,
    any_value(se) AS se FROM w JOIN (SELECT e, sqrt(sum(s * s)) AS se FROM sc GROUP BY e) USING (e)
    GROUP BY e), x AS (SELECT *, abs(est) / se AS z FROM v) SELECT CAST(e AS INTEGER) AS time,
    round(est, 6) AS estimate, round(se, 6) AS std_error, round({tail("z")}, 6) AS p_value
    FROM x""")
def estimate_p_values(spark, sf):
    d = did.estimate(balanced(spark, sf), [], "attgt", "event")
    return _r(d.select("time", "estimate", "std_error", "p_value"), "estimate", "std_error",
              "p_value")


@query("etwfe_p_values", ROWS + SCORE + f""", es AS (SELECT lulc, e, sum(att * n_gt) / sum(n_gt)
    AS est FROM fx GROUP BY ALL), se AS (SELECT lulc, e, sqrt(sum(s * s)) AS se FROM sc
    GROUP BY ALL), z AS (SELECT *, abs(est) / se AS z FROM es JOIN se USING (lulc, e))
    SELECT lulc, CAST(e AS INTEGER) AS time, round(est, 6) AS estimate, round(se, 6) AS std_error,
    round({tail("z")}, 6) AS p_value FROM z""")
def etwfe_p_values(spark, sf):
    d = did.estimate(rows(spark, sf), ["lulc"], "etwfe", "event")
    return _r(d.select("lulc", "time", "estimate", "std_error", "p_value"), "estimate",
              "std_error", "p_value")


@query("pretrend_summary", ROWS + SCORE + """, es AS (SELECT lulc, e, sum(att * n_gt) / sum(n_gt)
    AS est FROM fx GROUP BY ALL), se AS (SELECT lulc, e, sqrt(sum(s * s)) AS se FROM sc
    GROUP BY ALL) SELECT lulc, count(*) AS n_pre, count(*) FILTER (abs(est) >
    1.959963984540054 * se) AS n_pre_sig, round(max(abs(est)), 6) AS max_abs_pre FROM es
    JOIN se USING (lulc, e) WHERE e < 0 GROUP BY lulc""")
def pretrend_summary(spark, sf):
    d = did.estimate(rows(spark, sf), ["lulc"], "etwfe", "event")
    return _r(did.pretrend_summary(d, ["lulc"]), "max_abs_pre")


def _mix(z: str, shift: int, factor: int) -> str:
    """One step of the integer mixing, modulo 2^64."""
    return (f"CAST((CAST(xor({z}, {z} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT) "
            "% 18446744073709551616::UHUGEINT AS UBIGINT)")


# one sign per pair and draw, then order statistics of the signed sums
_DRAWS = f""", z0 AS (SELECT pair_id, draw, CAST((CAST(pair_id AS UHUGEINT) * 11400714819323198485
      + CAST(draw AS UHUGEINT) * 15111065706836454659 + 160617) % 18446744073709551616 AS UBIGINT)
      AS z FROM (SELECT DISTINCT pair_id FROM sc), range(999) d(draw)),
    z1 AS (SELECT pair_id, draw, {_mix("z", 30, 13787848793156543929)} AS z FROM z0),
    z2 AS (SELECT pair_id, draw, {_mix("z", 27, 10723151780598845931)} AS z FROM z1),
    sg AS (SELECT pair_id, draw, 1 - 2 * CAST(xor(z, z >> 31) & 1 AS INTEGER) AS g FROM z2),
    dr AS (SELECT e, draw, sum(s * g) AS v FROM sc JOIN sg USING (pair_id) GROUP BY ALL),
    sp AS (SELECT e, (o[750] - o[250]) / (2 * 0.6744897501960817) AS se FROM (SELECT e,
      list_sort(list(v)) AS o FROM dr GROUP BY e)),
    mx AS (SELECT list_sort(list(t)) AS o FROM (SELECT draw, max(abs(v / se)) AS t FROM dr
      JOIN sp USING (e) WHERE se > 0 GROUP BY draw)) """


@query("bootstrap_bands", ROWS + ATT_SCORE + _DRAWS + """SELECT CAST(e AS INTEGER) AS time,
    round(se, 6) AS std_error, round(o[950], 6) AS crit_val FROM sp, mx""")
def bootstrap_bands(spark, sf):
    """Simultaneous bands from signed pair scores."""
    d = balanced(spark, sf)
    m = did.cell_means(d, [])
    w = did.target_weights(did.group_time(m, []), [], "event")
    s = did.pair_scores(d, m, w, [], random_weights=True)
    return _r(did.simultaneous_bands(did.bootstrap_draws(s, [], 999, 160617), []),
              "std_error", "crit_val")


@query("cell_status", ROWS + """, c AS (SELECT lulc, count(*) AS n_rows, count(DISTINCT CASE
    WHEN gvar > 0 THEN unit_id END) AS n_treated, count(DISTINCT CASE WHEN gvar = 0 THEN unit_id
    END) AS n_never FROM r GROUP BY lulc) SELECT *, CASE WHEN n_treated < 142 THEN 'skipped'
    ELSE 'ok' END AS status, CASE WHEN n_treated < 142 THEN 'below_floor' END AS reason FROM c""")
def cell_status(spark, sf):
    return did.cell_status(rows(spark, sf), ["lulc"], 142)


# the run grid is every segment and cohort year; a cell keeps the rows of one cohort
@query("cell_status_grid", ROWS + """, g AS (SELECT lulc, CAST(z AS INTEGER) AS z FROM (SELECT
    DISTINCT lulc FROM units0), range(1994, 2002) t(z)), p AS (SELECT lulc, gvar AS z, unit_id,
    gvar FROM r WHERE gvar > 0), c AS (SELECT g.lulc, g.z, count(unit_id) AS n_rows,
    count(DISTINCT unit_id) AS n_treated, CAST(0 AS BIGINT) AS n_never FROM g LEFT JOIN p
    ON p.lulc = g.lulc AND p.z = g.z GROUP BY ALL) SELECT *, 'skipped' AS status,
    CASE WHEN n_rows = 0 THEN 'no_rows' ELSE 'no_never' END AS reason FROM c""".replace(
    "units0", "(SELECT c_mktsegment AS lulc FROM customer)"))
def cell_status_grid(spark, sf):
    from panelspark.queries.base import table

    seg = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("lulc")).distinct()
    grid = seg.withColumn("z", F.explode(F.sequence(F.lit(1994), F.lit(2001))))
    d = rows(spark, sf).where("gvar > 0").withColumn("z", F.col("gvar"))
    return did.cell_status(d, ["lulc", "z"], 1, expected=grid)


@query("estimate_kinds", ROWS + """, fk AS (SELECT 'event' AS kind, e AS time, * FROM fx UNION ALL
    SELECT 'calendar', year, * FROM fx WHERE e >= 0 UNION ALL SELECT 'simple', 0, * FROM fx
    WHERE e >= 0), w AS (SELECT *, n_gt / sum(n_gt) OVER (PARTITION BY lulc, kind, time) AS w
    FROM fk), k AS (SELECT lulc, kind, time, gvar, year, w AS c FROM w UNION ALL
      SELECT lulc, kind, time, gvar, base_year, -w FROM w UNION ALL
      SELECT lulc, kind, time, 0, year, -w FROM w UNION ALL
      SELECT lulc, kind, time, 0, base_year, w FROM w),
    kc AS (SELECT lulc, kind, time, gvar, year, sum(c) AS c FROM k GROUP BY ALL),
    sc AS (SELECT r.lulc, kind, time, pair_id, sum(c / n * (y - m)) AS s FROM r JOIN cm
      USING (lulc, gvar, year) JOIN kc USING (lulc, gvar, year) GROUP BY ALL),
    se AS (SELECT lulc, kind, time, sqrt(sum(s * s)) AS se FROM sc GROUP BY ALL),
    es AS (SELECT lulc, kind, time, sum(att * w) AS est FROM w GROUP BY ALL)
    SELECT lulc, kind AS aggregation, CAST(time AS INTEGER) AS time, round(est, 6) AS estimate,
    round(se, 6) AS std_error FROM es JOIN se USING (lulc, kind, time)""")
def estimate_kinds(spark, sf):
    """Event, calendar and simple targets from one pass of scores."""
    d = did.estimate(rows(spark, sf), ["lulc"], "etwfe", ("event", "calendar", "simple"))
    return _r(d.select("lulc", "aggregation", "time", "estimate", "std_error"), "estimate",
              "std_error")


@query("att_pooled", ROWS + ATT_SCORE + """, p AS (SELECT pair_id, sum(s) / (SELECT
    count(DISTINCT e) FROM gt WHERE e >= 0) AS s FROM sc WHERE e >= 0 GROUP BY 1),
    t AS (SELECT e, any_value(th) AS th FROM w WHERE e >= 0 GROUP BY e),
    v AS (SELECT avg(th) AS est, count(*) AS k FROM t) SELECT round(est, 6) AS estimate,
    k AS n_effects, round(se, 6) AS std_error, round(est - 1.959963984540054 * se, 6) AS conf_low,
    round(est + 1.959963984540054 * se, 6) AS conf_high FROM v,
    (SELECT sqrt(sum(s * s)) AS se FROM p)""")
def att_pooled(spark, sf):
    """Mean of the event effects after treatment, with its interval."""
    d = did.estimate(balanced(spark, sf), [], "attgt", "event", pooled=True)
    return _r(d.where("time IS NULL"), "estimate", "std_error", "conf_low", "conf_high").select(
        "estimate", "n_effects", "std_error", "conf_low", "conf_high")


_SIGNED = """, k AS (SELECT lulc, kind, time, gvar, year, w AS c FROM w UNION ALL
      SELECT lulc, kind, time, gvar, base_year, -w FROM w WHERE base_year IS NOT NULL UNION ALL
      SELECT lulc, kind, time, 0, year, -w FROM w UNION ALL
      SELECT lulc, kind, time, 0, base_year, w FROM w WHERE base_year IS NOT NULL),
    kc AS (SELECT lulc, kind, time, gvar, year, sum(c) AS c FROM k GROUP BY ALL),
    sc AS (SELECT r.lulc, kind, time, pair_id, sum(c / n * (y - m)) AS s FROM r JOIN cm
      USING (lulc, gvar, year) JOIN kc USING (lulc, gvar, year) GROUP BY ALL),
    se AS (SELECT lulc, kind, time, sqrt(sum(s * s)) AS se FROM sc GROUP BY ALL),
    es AS (SELECT lulc, kind, time, sum(att * w) AS est, count(*) AS k FROM w GROUP BY ALL) """


@query("estimate_pooled", ROWS + """, fk AS (SELECT 'event' AS kind, e AS time, * FROM fx UNION ALL
    SELECT 'calendar', year, * FROM fx WHERE e >= 0), w AS (SELECT *, n_gt / sum(n_gt) OVER
      (PARTITION BY lulc, kind, time) AS w FROM fk)""" + _SIGNED + """, po AS (SELECT lulc, kind,
      avg(est) AS est, count(*) AS k FROM es WHERE kind = 'calendar' OR time >= 0 GROUP BY ALL),
    ps AS (SELECT lulc, kind, sqrt(sum(s * s)) AS se FROM (SELECT lulc, kind, pair_id,
      sum(s) / any_value(k) AS s FROM sc JOIN po USING (lulc, kind) WHERE kind = 'calendar'
      OR time >= 0 GROUP BY ALL) GROUP BY ALL)
    SELECT lulc, kind AS aggregation, round(est, 6) AS estimate, k AS n_effects,
    round(se, 6) AS std_error FROM po JOIN ps USING (lulc, kind)""")
def estimate_pooled(spark, sf):
    d = did.estimate(rows(spark, sf), ["lulc"], "etwfe", ("event", "calendar"), pooled=True)
    return _r(d.where("time IS NULL"), "estimate", "std_error").select(
        "lulc", "aggregation", "estimate", "n_effects", "std_error")


@query("calendar_always_treated", ROWS + """, fk AS (SELECT 'calendar' AS kind, year AS time, *
      FROM fx WHERE e >= 0 UNION ALL SELECT 'calendar', a.year, a.lulc, a.gvar, a.year,
      a.year - a.gvar, NULL, a.n, a.m - c.m FROM cm a JOIN cm c ON c.lulc = a.lulc
      AND c.year = a.year AND c.gvar = 0 WHERE a.gvar > 0 AND NOT EXISTS (FROM cm b
      WHERE b.lulc = a.lulc AND b.gvar = a.gvar AND b.year = a.gvar - 1)),
    w AS (SELECT *, n_gt / sum(n_gt) OVER (PARTITION BY lulc, kind, time) AS w FROM fk)"""
    + _SIGNED + """SELECT lulc, CAST(time AS INTEGER) AS time, round(est, 6) AS estimate,
    k AS n_effects, round(se, 6) AS std_error FROM es JOIN se USING (lulc, kind, time)""")
def calendar_always_treated(spark, sf):
    """Calendar series in which the always-treated cohort counts by its level difference."""
    d = did.estimate(rows(spark, sf), ["lulc"], "etwfe", "calendar", always_treated="level")
    return _r(d, "estimate", "std_error").select("lulc", "time", "estimate", "n_effects", "std_error")
