"""Detections against events: windows, lags, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import detect as D
from panelspark.operators import events as E
from panelspark.operators import quality as Q
from panelspark.queries.base import (cohorts, detections, event_log, layer_values, n_if,
                                     query, units, with_)

EV_COLS = ["pixel_id", "event_year", "token", "layer"]


def evs(spark, sf):
    return event_log(spark, sf).select(*EV_COLS)


@query("detection_screen", with_("layer_values") + """SELECT a.pixel_id, a.year,
    a.value AS treefrac_loss, b.value AS agb_loss FROM layer_values a LEFT JOIN layer_values b
    ON b.layer = 'LN' AND a.pixel_id = b.pixel_id AND a.year = b.year
    WHERE a.layer = 'LR' AND a.value > 30""")
def detection_screen(spark, sf):
    v = layer_values(spark, sf)
    return E.detection_screen(v.where(F.col("layer") == "LR"),
                              v.where(F.col("layer") == "LN"), 30)


@query("screen_tally", with_("layer_values") + f"""SELECT year, count(value) AS n_valid,
    {n_if("value > 30")} AS n_detected, round(100.0 * {n_if("value > 30")} / count(value), 3)
    AS pct_detected FROM layer_values WHERE layer = 'LR' GROUP BY year""")
def screen_tally(spark, sf):
    return E.screen_tally(layer_values(spark, sf).where(F.col("layer") == "LR"), 30)


@query("detections_per_cell", with_("detections", c="""SELECT pixel_id, count(*) AS n_rows
    FROM detections GROUP BY pixel_id""") + """SELECT n_rows, count(*) AS n_keys FROM c
    GROUP BY n_rows""")
def detections_per_cell(spark, sf):
    return E.count_of_counts(detections(spark, sf), "pixel_id")


@query("interval_detect", with_("cohorts", "detections") + """SELECT pixel_id, gvar,
    EXISTS (SELECT 1 FROM detections d WHERE d.pixel_id = c.pixel_id
      AND abs(d.year - c.gvar) <= CASE WHEN lulc = 'BUILDING' THEN 2 ELSE 1 END) AS
      detect_at_event, CAST((SELECT count(*) FROM detections d WHERE d.pixel_id = c.pixel_id)
      AS INTEGER) AS n_detect FROM cohorts c""")
def interval_detect(spark, sf):
    c = cohorts(spark, sf)
    w = F.when(F.col("lulc") == "BUILDING", 2).otherwise(1)
    return D.detected_near(c, D.detection_history(detections(spark, sf)), w, "gvar").select(
        "pixel_id", "gvar", "detect_at_event", "n_detect")


ATTACH = with_("event_log", "detections", x="""SELECT e.pixel_id, e.event_year, e.token, e.layer,
    coalesce((SELECT max(treefrac_loss) FROM detections d WHERE d.pixel_id = e.pixel_id
      AND d.year - e.event_year BETWEEN -1 AND 1), 0.0) AS treefrac_loss,
    (SELECT max(agb_loss) FROM detections d WHERE d.pixel_id = e.pixel_id
      AND d.year - e.event_year BETWEEN -1 AND 1) AS agb_loss FROM event_log e""",
    ev="SELECT *, treefrac_loss > 0.02 AS detected FROM x")


def attached(spark, sf):
    d = D.attach_loss(evs(spark, sf), D.detection_history(detections(spark, sf)), -1, 1)
    return d.withColumn("detected", F.col("treefrac_loss") > 0.02)


query("attach_loss", ATTACH + "SELECT * FROM ev")(attached)


@query("coverage_expand", with_("detections") + """SELECT DISTINCT pixel_id, CAST(unnest(
    range(year - 1, year + 2)) AS INTEGER) AS year FROM detections""")
def coverage_expand(spark, sf):
    return D.coverage(detections(spark, sf), 1)


def _two_part(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_events, {n_if("detected")} AS n_detected,
    round(100.0 * {n_if("detected")} / count(*), 2) AS detect_rate,
    round(avg(treefrac_loss), 5) AS loss_mean,
    round(quantile_cont(treefrac_loss, 0.95), 4) AS loss_p95,
    round(quantile_cont(treefrac_loss, 0.99), 4) AS loss_p99,
    round(quantile_cont(treefrac_loss, 0.25) FILTER (detected), 4) AS det_loss_p25,
    round(quantile_cont(treefrac_loss, 0.5) FILTER (detected), 4) AS det_loss_p50,
    round(quantile_cont(treefrac_loss, 0.75) FILTER (detected), 4) AS det_loss_p75,
    round(quantile_cont(agb_loss, 0.5) FILTER (detected), 3) AS det_agb_p50
    FROM ev GROUP BY {by}"""


@query("two_part_summary", ATTACH + _two_part("layer, token"))
def two_part_summary(spark, sf):
    return D.two_part_summary(attached(spark, sf), ["layer", "token"])


@query("monotonicity", ATTACH + f""", s AS ({_two_part("layer, token")}), u AS (SELECT layer,
    row_number() OVER w = 1 OR detect_rate > lag(detect_rate) OVER w AS a,
    row_number() OVER w = 1 OR det_loss_p75 > lag(det_loss_p75) OVER w AS b FROM s
    WHERE n_events >= 100 WINDOW w AS (PARTITION BY layer ORDER BY token))
    SELECT layer, count(*) AS n_levels, count(*) > 1 AND bool_and(a) AS detect_rate_monotone,
    count(*) > 1 AND bool_and(b) AS det_loss_p75_monotone FROM u GROUP BY layer""")
def monotonicity(spark, sf):
    return D.monotonicity(two_part_summary(spark, sf), "layer", "token",
                          ["detect_rate", "det_loss_p75"], 100)


LAGS = list(range(-6, 7))
SWEEP = with_("event_log", "detections", l="SELECT unnest(range(-6, 7)) AS lag",
              s="""SELECT token, lag, count(*) AS n_events, round(100.0 * count(d.pixel_id)
    / count(*), 2) AS detect_rate FROM event_log e CROSS JOIN l LEFT JOIN detections d
    ON d.pixel_id = e.pixel_id AND d.year = e.event_year + lag AND d.treefrac_loss > 0.02
    GROUP BY ALL""")


def _sweep(spark, sf):
    return D.lag_sweep(evs(spark, sf), D.detection_history(detections(spark, sf)), ["token"],
                       LAGS, 0.02)


@query("lag_sweep", SWEEP + "SELECT token, CAST(lag AS INTEGER) AS lag, n_events, detect_rate "
       "FROM s")
def lag_sweep(spark, sf):
    return _sweep(spark, sf)


@query("peak_lag", SWEEP + """SELECT token, max(n_events) AS n_events,
    CAST(arg_max(lag, (detect_rate, -lag)) AS INTEGER) AS peak_lag,
    max(detect_rate) AS peak_rate, max(detect_rate) FILTER (lag = 0) AS rate_at_zero,
    arg_max(lag, (detect_rate, -lag)) IN (-6, 6) AS at_window_edge FROM s GROUP BY token""")
def peak_lag(spark, sf):
    return D.peak_lag(_sweep(spark, sf), ["token"], -6, 6)


@query("cumulative_detection", with_("event_log", "detections", w="SELECT unnest(range(0, 7)) "
    "AS half_width", d="""SELECT token, (SELECT min(abs(d.year - e.event_year)) FROM
    detections d WHERE d.pixel_id = e.pixel_id AND d.treefrac_loss > 0.02) AS dist
    FROM event_log e""") + """SELECT token, CAST(half_width AS INTEGER) AS half_width,
    round(100.0 * count(*) FILTER (dist <= half_width) / count(*), 2) AS cum_detect_rate
    FROM d, w GROUP BY ALL""")
def cumulative_detection(spark, sf):
    return D.cumulative_detection(evs(spark, sf), D.detection_history(detections(spark, sf)),
                                  ["token"], 6, 0.02)


@query("cliffs_delta", ATTACH + """, c AS (SELECT * FROM (VALUES ('F4 vs F3', 'F4', 'F3'),
    ('F4 vs Fu', 'F4', 'Fu')) v(contrast, hi, lo)), r AS (SELECT layer, contrast,
    CAST(token = hi AS INTEGER) AS side, treefrac_loss AS v, rank() OVER w + (count(*) OVER
    (PARTITION BY layer, contrast, treefrac_loss) - 1) / 2.0 AS rk FROM ev JOIN c
    ON token IN (hi, lo) WINDOW w AS (PARTITION BY layer, contrast ORDER BY treefrac_loss)),
    g AS (SELECT layer, contrast, CAST(sum(side) AS BIGINT) AS n_hi,
    CAST(sum(1 - side) AS BIGINT) AS n_lo, avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) AS z,
    sum(CASE WHEN side = 1 THEN rk END) AS sr FROM r GROUP BY ALL)
    SELECT layer, contrast, n_hi, n_lo, round(z, 3) AS tie_frac, round(2 * (sr - n_hi *
    (n_hi + 1) / 2.0) / (CAST(n_hi AS DOUBLE) * n_lo) - 1, 3) AS delta FROM g""")
def cliffs_delta(spark, sf):
    return D.separation(attached(spark, sf), "token", "treefrac_loss",
                        [("F4", "F3"), ("F4", "Fu")], ["layer"])


@query("separation_table", ATTACH + """, c AS (SELECT * FROM (VALUES ('F4 vs F3', 'F4', 'F3'),
    ('F4 vs Fu', 'F4', 'Fu')) v(contrast, hi, lo)), b AS (SELECT stratum, contrast,
    CAST(token = hi AS INTEGER) AS side, v, unnest(CASE WHEN v > 0 THEN [0, 1] ELSE [0] END) AS d
    FROM (SELECT unnest(['pooled', layer]) AS stratum, token, treefrac_loss AS v FROM ev) JOIN c
    ON token IN (hi, lo)), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY stratum,
    contrast, d, v) - 1) / 2.0 AS rk FROM b WINDOW w AS (PARTITION BY stratum, contrast, d
    ORDER BY v)), g AS (SELECT stratum, contrast, d, CAST(sum(side) AS BIGINT) AS nh,
    CAST(sum(1 - side) AS BIGINT) AS nl, avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) AS z,
    sum(CASE WHEN side = 1 THEN rk END) AS sr, avg(CASE WHEN side = 1 THEN CAST(v > 0.05 AS DOUBLE)
    END) AS rh, avg(CASE WHEN side = 0 THEN CAST(v > 0.05 AS DOUBLE) END) AS rl FROM r GROUP BY ALL),
    t AS (SELECT *, CASE WHEN nh > 0 AND nl > 0 THEN round(2 * (sr - nh * (nh + 1) / 2.0)
      / (CAST(nh AS DOUBLE) * nl) - 1, 3) END AS delta FROM g)
    SELECT a.stratum, a.contrast, a.nh AS n_hi, a.nl AS n_lo, coalesce(b.nh, 0) AS n_det_hi,
    coalesce(b.nl, 0) AS n_det_lo, round(100 * (a.rh - a.rl), 2) AS detect_rate_diff_pp,
    round(a.z, 3) AS tie_frac, a.delta AS delta_uncond, b.delta AS delta_detected FROM t a
    LEFT JOIN t b ON a.stratum = b.stratum AND a.contrast = b.contrast AND b.d = 1
    WHERE a.d = 0""")
def separation_table(spark, sf):
    return D.separation_table(attached(spark, sf), "token", "treefrac_loss",
                              [("F4", "F3"), ("F4", "Fu")], "layer", 0.05,
                              F.col("treefrac_loss") > 0)


@query("spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag
    ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0
    AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER
    (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY ALL""")
def spearman(spark, sf):
    from panelspark.queries.base import table

    return D.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                      ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


@query("ratio_outliers", ATTACH + f""", d AS ({_two_part("layer, token")}),
    o AS ({_two_part("token")}) SELECT layer, d.token, round(d.detect_rate /
    greatest(o.detect_rate, 1e-6), 2) AS ratio_to_class FROM d JOIN o USING (token)
    WHERE round(d.detect_rate / greatest(o.detect_rate, 1e-6), 2) NOT BETWEEN 0.98 AND 1.02""")
def ratio_outliers(spark, sf):
    ev = attached(spark, sf)
    d = D.two_part_summary(ev, ["layer", "token"])
    o = D.two_part_summary(ev, ["token"])
    return D.ratio_outliers(d, o, "token", "detect_rate", 0.98, 1.02).select(
        "layer", "token", "ratio_to_class")


# -- thresholds -----------------------------------------------------------------

REF = with_("units", "event_log", "detections", ref="""SELECT pixel_id FROM units WHERE
    pixel_id NOT IN (SELECT pixel_id FROM event_log WHERE token = 'F4' AND layer = 'P')
    AND pixel_id NOT IN (SELECT pixel_id FROM event_log WHERE token = 'T2' AND layer = 'F')""")


def reference(spark, sf):
    e = event_log(spark, sf)
    return D.reference_cells(units(spark, sf),
                             e.where("token = 'F4' AND layer = 'P'"),
                             e.where("token = 'T2' AND layer = 'F'"))


query("reference_cells", REF + "SELECT pixel_id FROM ref")(reference)
GRID = [round(i * 0.0025, 4) for i in range(41)]
ROC = REF[:-1] + """, rv AS (SELECT pixel_id, arg_min(treefrac_loss, md5('7:' || pixel_id || '-'
    || year)) AS v FROM detections JOIN ref USING (pixel_id) GROUP BY pixel_id),
    pos AS (SELECT max(treefrac_loss) AS v FROM event_log e JOIN detections d USING (pixel_id)
      WHERE token = 'F4' AND layer = 'P' AND abs(d.year - e.event_year) <= 1
      GROUP BY pixel_id, event_year),
    t AS (SELECT CAST(unnest(range(0, 41)) * 25 AS DOUBLE) / 10000 AS threshold),
    roc AS (SELECT threshold, (SELECT avg(CASE WHEN v > threshold THEN 1.0 ELSE 0 END) FROM pos)
      AS sensitivity, (SELECT avg(CASE WHEN v <= threshold THEN 1.0 ELSE 0 END) FROM rv)
      AS specificity FROM t) """


def _roc(spark, sf):
    det = detections(spark, sf)
    vals = det.select("pixel_id", "year", F.col("treefrac_loss").alias("value"))
    rv = D.one_year_each(vals.join(reference(spark, sf), "pixel_id", "left_semi"), 7)
    pos = event_log(spark, sf).where("token = 'F4' AND layer = 'P'").select(
        "pixel_id", "event_year").distinct()
    pv = D.attach_loss(pos, D.detection_history(det), -1, 1).where(
        F.col("treefrac_loss") > 0)
    near = D.detected_near(pos, D.detection_history(det), F.lit(1)).where("detect_at_event")
    pv = D.attach_loss(near.select("pixel_id", "event_year"), D.detection_history(det), -1, 1)
    return D.threshold_roc(rv, pv.select(F.col("treefrac_loss").alias("value")), GRID)


@query("threshold_roc", ROC + """SELECT threshold, round(sensitivity, 6) AS sensitivity,
    round(specificity, 6) AS specificity, round(sensitivity + specificity - 1, 6) AS youden
    FROM roc""")
def threshold_roc(spark, sf):
    return _roc(spark, sf).select("threshold", *[F.round(c, 6).alias(c) for c in (
        "sensitivity", "specificity", "youden")])


@query("threshold_choice", ROC + """, p AS (SELECT quantile_cont(treefrac_loss, 0.99) AS p99
    FROM detections JOIN ref USING (pixel_id)), b AS (SELECT arg_max(threshold,
    (round(sensitivity + specificity - 1, 12), -threshold)) AS youden_t FROM roc)
    SELECT youden_t, round(p99, 6) AS p99, round(least(youden_t, p99), 6) AS "primary"
    FROM b, p""")
def threshold_choice(spark, sf):
    from panelspark.operators.core import exact_quantiles

    d = detections(spark, sf).join(reference(spark, sf), "pixel_id", "left_semi")
    roc = _roc(spark, sf).withColumn("youden", F.round("youden", 12))
    c = D.choose_threshold(roc, exact_quantiles(d, [], "treefrac_loss", {"p99": .99}))
    return c.select("youden_t", F.round("p99", 6).alias("p99"),
                    F.round("primary", 6).alias("primary"))


@query("threshold_retention", REF[:-1] + """, m AS (SELECT max(treefrac_loss) AS m FROM
    detections JOIN ref USING (pixel_id) GROUP BY pixel_id), t AS (SELECT
    CAST(unnest(range(0, 41)) * 25 AS DOUBLE) / 10000 AS threshold) SELECT threshold,
    round(100 * avg(CASE WHEN m <= threshold THEN 1.0 ELSE 0 END), 3) AS retention_pct
    FROM t, m GROUP BY threshold""")
def threshold_retention(spark, sf):
    d = detections(spark, sf).join(reference(spark, sf), "pixel_id", "left_semi")
    return D.retention_at(d.select("pixel_id", F.col("treefrac_loss").alias("value")), GRID)


@query("reference_quantiles", REF[:-1] + """ SELECT year, count(*) AS n_valid,
    round(100.0 * sum(CASE WHEN treefrac_loss = 0 THEN 1 ELSE 0 END) / count(*), 2) AS zero_pct,
    round(quantile_cont(treefrac_loss, 0.5), 6) AS p50,
    round(quantile_cont(treefrac_loss, 0.95), 6) AS p95,
    round(quantile_cont(treefrac_loss, 0.99), 6) AS p99
    FROM detections JOIN ref USING (pixel_id) GROUP BY year""")
def reference_quantiles(spark, sf):
    from panelspark.operators.core import exact_quantiles

    d = detections(spark, sf).join(reference(spark, sf), "pixel_id", "left_semi")
    z = F.sum((F.col("treefrac_loss") == 0).cast("long"))
    b = d.groupBy("year").agg(F.count(F.lit(1)).alias("n_valid"),
                              F.round(100.0 * z / F.count(F.lit(1)), 2).alias("zero_pct"))
    q = exact_quantiles(d, ["year"], "treefrac_loss", {"p50": .5, "p95": .95, "p99": .99})
    return b.join(q, "year").select("year", "n_valid", "zero_pct", *[
        F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


# -- records assumed harmless ----------------------------------------------------

HARM = with_("units", "event_log", "detections", rec="""SELECT pixel_id, event_year,
    layer AS activity FROM event_log WHERE token = 'Td'""", clean="""SELECT pixel_id FROM units
    WHERE pixel_id NOT IN (SELECT pixel_id FROM event_log WHERE token = 'Td')""",
    cov="""SELECT DISTINCT pixel_id, unnest(range(year - 1, year + 2)) AS year FROM
    detections""", rn="""SELECT zone, count(*) AS d FROM clean JOIN units USING (pixel_id)
    GROUP BY zone""", rh="""SELECT zone, year, count(*) AS h FROM clean JOIN units USING
    (pixel_id) JOIN cov USING (pixel_id) GROUP BY ALL""",
    a="""SELECT r.activity, r.pixel_id, coalesce(h, 0) / d AS e, EXISTS (SELECT 1 FROM cov c
    WHERE c.pixel_id = r.pixel_id AND c.year = r.event_year) AS hit FROM rec r
    JOIN units u USING (pixel_id) JOIN rn ON rn.zone = u.zone
    LEFT JOIN rh ON rh.zone = u.zone AND rh.year = r.event_year
    WHERE u.zone IN (SELECT zone FROM rh) AND r.event_year IN (SELECT year FROM rh)""")


def _harm(spark, sf):
    e = event_log(spark, sf)
    td = e.where(F.col("token") == "Td")
    u = units(spark, sf)
    clean = u.select("pixel_id").join(td.select("pixel_id").distinct(), "pixel_id", "left_anti")
    return D.harmless_rates(td.select("pixel_id", "event_year", F.col("layer").alias("activity")),
                            clean, u.select("pixel_id", "zone"), detections(spark, sf), 1)


@query("harmless_rates", HARM + f"""SELECT activity, count(*) AS n_records,
    count(DISTINCT pixel_id) AS n_pixels, {n_if("hit")} AS n_hit, round(avg(e), 6) AS exp_rate,
    round({n_if("hit")} / count(*), 6) AS obs_rate FROM a GROUP BY activity""")
def harmless_rates(spark, sf):
    return _harm(spark, sf).select("activity", "n_records", "n_pixels", "n_hit", *[
        F.round(c, 6).alias(c) for c in ("exp_rate", "obs_rate")])


# the binomial tail term by term, an expected rate of 0 or 1 has no p value
@query("harmless_decision", HARM + f"""SELECT activity, round(ratio, 6) AS ratio,
    round(p, 9) AS p_value, CASE WHEN coalesce(ratio >= 2 AND n_pixels >= 100 AND p < 0.001, false)
      THEN 'disturbing' ELSE 'non_disturbing' END AS decision
    FROM (SELECT *, CASE WHEN e > 0 THEN k / n / e END AS ratio,
      CASE WHEN e > 0 AND e < 1 THEN CASE WHEN k <= 0 THEN 1.0 ELSE list_sum(list_transform(
        range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
          + i * ln(e) + (n - i) * ln(1 - e)))) END END AS p
      FROM (SELECT activity, count(*) AS n, count(DISTINCT pixel_id) AS n_pixels,
        {n_if("hit")} AS k, avg(e) AS e FROM a GROUP BY activity))""")
def harmless_decision(spark, sf):
    return D.harmless_decision(_harm(spark, sf)).select(
        "activity", F.round("ratio", 6).alias("ratio"), F.round("p_value", 9).alias("p_value"),
        "decision")


@query("screen_audit", with_("units", "detections") + f"""SELECT n_cells, n_never, n_detections,
    n_agreeing, round(100.0 * n_never / n_cells, 3) AS pct_never,
    round(100.0 * n_agreeing / n_detections, 3) AS pct_agreeing FROM (SELECT count(*) AS n_cells,
    {n_if("pixel_id NOT IN (SELECT pixel_id FROM detections)")} AS n_never FROM units) a,
    (SELECT count(*) AS n_detections, {n_if("agb_loss > 0")} AS n_agreeing FROM detections) b""")
def screen_audit(spark, sf):
    return Q.screen_audit(detections(spark, sf), units(spark, sf))
