"""Event-time support, caps, result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators import support as S
from panelspark.operators.core import registry
from panelspark.queries.base import cohorts, query, table, with_

CELL = ["lulc", "outcome"]
WIN = [("agb", 1995, 2001), ("gpp", 1997, 2000)]


def _windows(spark):
    return registry(spark, ["outcome", "year_first", "year_last"], WIN).withColumns({
        c: F.col(c).cast("int") for c in ("year_first", "year_last")})


def sup(spark, sf):
    return S.event_support(cohorts(spark, sf), ["lulc"], _windows(spark), -8, 8)


SUP = with_("cohorts", win="SELECT * FROM (VALUES ('agb', 1995, 2001), ('gpp', 1997, 2000)) "
    "w(outcome, y0, y1)", sp0="""SELECT lulc, outcome, CAST(e AS INTEGER) AS event_time,
    count(*) AS n_treated, count(*) FILTER (gvar + e BETWEEN y0 AND y1) AS n_units,
    count(DISTINCT CASE WHEN gvar + e BETWEEN y0 AND y1 THEN gvar END) AS n_cohorts,
    min(gvar) FILTER (gvar + e BETWEEN y0 AND y1) AS cohort_first,
    max(gvar) FILTER (gvar + e BETWEEN y0 AND y1) AS cohort_last
    FROM cohorts, win, (SELECT unnest(range(-8, 9)) AS e) t WHERE gvar > 0 GROUP BY ALL""",
    sp="""SELECT *, CASE WHEN event_time >= 0 THEN max(n_units) OVER (PARTITION BY lulc, outcome,
      event_time >= 0 ORDER BY event_time) ELSE max(n_units) OVER (PARTITION BY lulc, outcome,
      event_time >= 0 ORDER BY event_time DESC) END AS den,
      max(CASE WHEN event_time = 0 THEN n_units END) OVER (PARTITION BY lulc, outcome) AS n0,
      max(n_units) OVER (PARTITION BY lulc, outcome) AS nref FROM sp0""",
    sr="""SELECT *, CASE WHEN den > 0 THEN round(n_units / den, 4) END AS retention,
      round(n0 / n_treated, 4) AS share_at_0 FROM sp""")


@query("event_support", SUP + """SELECT lulc, outcome, event_time, n_treated, n_units, n_cohorts,
    cohort_first, cohort_last FROM sp""")
def event_support(spark, sf):
    return sup(spark, sf).select(*CELL, "event_time", "n_treated", "n_units", "n_cohorts",
                                 "cohort_first", "cohort_last")


@query("retention", SUP + """SELECT lulc, outcome, event_time, den AS n_units_den, n0 AS n_units_0,
    nref AS n_units_ref, round(n_units / n_treated, 4) AS share_units, share_at_0, retention,
    (SELECT min(event_time) FROM sp q WHERE q.lulc = sr.lulc AND q.outcome = sr.outcome
      AND q.n_units = q.nref) AS e_ref FROM sr""")
def retention(spark, sf):
    return sup(spark, sf).select(*CELL, "event_time", "n_units_den", "n_units_0", "n_units_ref",
                                 "share_units", "share_at_0", "retention", "e_ref")


@query("half_life", SUP + """SELECT lulc, outcome, max(n_treated) AS n_treated, max(share_at_0)
    AS share_at_0, coalesce(min(event_time) FILTER (retention < 0.5), max(event_time))
    AS half_gone_at FROM sr WHERE event_time >= 0 GROUP BY ALL""")
def half_life(spark, sf):
    return S.half_life(sup(spark, sf), CELL)


def cap_rows(spark, sf):
    w = F.lit(1.0) + F.abs("event_time") * 0.4
    return sup(spark, sf).withColumn("ci_width", F.when(F.col("event_time") != 2, w))


CAP = SUP[:-1] + """, cw AS (SELECT *, CASE WHEN event_time <> 2 THEN 1 + abs(event_time) * 0.4
    END AS ci FROM sr), rf AS (SELECT lulc, outcome, median(ci) AS ref FROM cw WHERE event_time
    BETWEEN 0 AND 5 GROUP BY ALL) """


def _cap_sql(n: str, k: str, r: str, m: str = "2.0", extra: str = "", frm: str = "cw",
             key: str = "lulc, outcome") -> str:
    return f""", fl AS (SELECT {key}, event_time AS e, n_units >= {n} AS a, n_cohorts >= {k} AS b,
      coalesce(retention >= {r}, false) AS c, event_time = 0 OR coalesce(ci <= {m} * ref, false)
      AS d FROM {frm} JOIN rf USING (lulc, outcome)), cp AS (SELECT {key},
      min(e) FILTER (e >= 0 AND NOT (a AND b AND c)) AS f1, min(e) FILTER (e >= 0 AND NOT
      (a AND b AND d)) AS f2, max(e) FILTER (e < 0 AND NOT (a AND b AND c)) AS f3,
      max(e) AS last, min(e) AS first FROM fl GROUP BY {key}), cap AS (SELECT *,
      CASE WHEN f1 IS NULL THEN last WHEN f1 > 0 THEN f1 - 1 END AS cap,
      CASE WHEN f2 IS NULL THEN last WHEN f2 > 0 THEN f2 - 1 END AS cap_ci,
      CASE WHEN f3 IS NULL THEN first WHEN f3 < -1 THEN f3 + 1 END AS cap_lo FROM cp) """


@query("support_cap", CAP + _cap_sql("20", "3", "0.3") + """SELECT cap.lulc, cap.outcome, cap,
    cap_lo, cap_ci, CASE WHEN f1 IS NULL THEN 'end_of_data' WHEN f1 > 0 THEN (SELECT
      concat_ws('+', CASE WHEN NOT a THEN 'n_units' END, CASE WHEN NOT b THEN 'n_cohorts' END,
      CASE WHEN NOT c THEN 'retention' END) FROM fl WHERE fl.lulc = cap.lulc AND fl.outcome =
      cap.outcome AND e = f1) END AS bind FROM cap""")
def support_cap(spark, sf):
    return S.support_caps(cap_rows(spark, sf), CELL, 20, 3, 0.3).select(
        *CELL, "cap", "cap_lo", "cap_ci", "bind")


@query("cap_sweep", CAP + """, st AS (SELECT *, unnest([0.0, 0.25, 0.5])::DOUBLE AS setting
    FROM cw)""" + _cap_sql("20", "3", "setting", frm="st", key="setting, lulc, outcome")
    + """SELECT setting, outcome, count(*) AS n_cells, count(cap) AS n_capped, min(cap) AS cap_min,
    median(cap) AS cap_med, max(cap) AS cap_max FROM cap GROUP BY setting, outcome""")
def cap_sweep(spark, sf):
    d = S.cap_sweep(cap_rows(spark, sf), CELL, "retention", [0.0, 0.25, 0.5], 20, 3, 0.3)
    return S.sweep_summary(d, ["outcome"], "cap").drop("n_bind_cohorts")


@query("cap_sweep_cohorts", CAP + """, st AS (SELECT *, unnest([1.0, 3.0, 5.0])::DOUBLE AS setting
    FROM cw)""" + _cap_sql("20", "setting", "0.3", frm="st", key="setting, lulc, outcome")
    + """SELECT setting, outcome, count(*) AS n_cells, count(cap) AS n_capped, min(cap) AS cap_min,
    median(cap) AS cap_med, max(cap) AS cap_max FROM cap GROUP BY setting, outcome""")
def cap_sweep_cohorts(spark, sf):
    d = S.cap_sweep(cap_rows(spark, sf), CELL, "cohorts", [1.0, 3.0, 5.0], 20, 3, 0.3)
    return S.sweep_summary(d, ["outcome"], "cap").drop("n_bind_cohorts")


@query("cap_sweep_width", CAP + """, st AS (SELECT *, unnest([1.2, 1.6, 2.0])::DOUBLE AS setting
    FROM cw)""" + _cap_sql("20", "3", "0.3", "setting", frm="st", key="setting, lulc, outcome")
    + """SELECT setting, outcome, count(*) AS n_cells, count(cap_ci) AS n_capped,
    min(cap_ci) AS cap_min, median(cap_ci) AS cap_med, max(cap_ci) AS cap_max FROM cap
    GROUP BY setting, outcome""")
def cap_sweep_width(spark, sf):
    d = S.cap_sweep(cap_rows(spark, sf), CELL, "width", [1.2, 1.6, 2.0], 20, 3, 0.3)
    return S.sweep_summary(d, ["outcome"], "cap_ci").drop("n_bind_cohorts")


@query("shared_caps", CAP + _cap_sql("20", "3", "0.3") + """SELECT lulc, outcome,
    min(cap) OVER (PARTITION BY lulc) AS cap_use, max(cap_lo) OVER (PARTITION BY lulc)
    AS cap_lo_use, min(cap_ci) OVER (PARTITION BY lulc) AS cap_ci_use FROM cap""")
def shared_caps(spark, sf):
    c = S.support_caps(cap_rows(spark, sf), CELL, 20, 3, 0.3)
    return S.shared_caps(c, ["lulc"]).select(*CELL, "cap_use", "cap_lo_use", "cap_ci_use")


@query("window_diff", CAP + _cap_sql("20", "3", "0.3") + """SELECT lulc, outcome, cap AS cap_auto,
    CASE WHEN lulc <> 'BUILDING' THEN CASE WHEN outcome = 'gpp' THEN 1 ELSE cap END END AS cap_used,
    CASE WHEN cap IS NULL THEN 'same' WHEN lulc = 'BUILDING' THEN 'unlisted'
      WHEN outcome = 'gpp' AND cap <> 1 THEN 'changed' ELSE 'same' END AS state FROM cap""")
def window_diff(spark, sf):
    c = S.support_caps(cap_rows(spark, sf), CELL, 20, 3, 0.3).select(
        *CELL, F.col("cap").alias("cap_use"))
    used = c.where(F.col("lulc") != "BUILDING").withColumn("cap_use", F.when(
        F.col("outcome") == "gpp", 1).otherwise(F.col("cap_use")))
    return S.window_diff(c, used, CELL)


# estimate rows from orders: run = segment x priority, time = year
EST = """WITH es AS (SELECT 'etwfe' AS estimator, CASE WHEN c_mktsegment < 'H' THEN 'FP_UP'
      ELSE 'UP_UNP' END AS pairing, c_mktsegment || '-' || o_orderpriority AS run_id,
      CASE WHEN o_orderstatus = 'P' THEN 'calendar' ELSE 'event' END AS aggregation,
      CASE WHEN o_orderpriority < '3' THEN 'gpp' ELSE 'nep' END AS outcome,
      CASE WHEN o_orderpriority < '3' THEN 'log1p' ELSE 'none' END AS transform,
      CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN '' ELSE 'Low severity' END
        AS stratum, CASE WHEN c_nationkey < 12 THEN '' ELSE '08' END AS ecoregion,
      CAST(year(o_orderdate) - 1996 AS DOUBLE) AS time, avg(o_totalprice) / 1234567.8e0 AS estimate,
      stddev_samp(o_totalprice) / 1234567.8e0 / sqrt(count(*)) AS std_error FROM orders
      JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    er AS (SELECT *, estimate - 1.96 * std_error AS conf_low, estimate + 1.96 * std_error
      AS conf_high, run_id || '-' || ecoregion AS rid FROM es),
    fr AS (SELECT *, CASE WHEN transform = 'log1p' THEN exp(estimate) - 1 END AS estimate_bt,
      CASE pairing WHEN 'FP_UP' THEN 'fire' ELSE 'pa' END AS arm, CASE WHEN time IS NOT NULL AND
      lag(std_error) OVER w > 0 THEN std_error / lag(std_error) OVER w END AS ratio FROM er
      WINDOW w AS (PARTITION BY estimator, rid, aggregation ORDER BY time)) """


def est(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"),
                                        F.col("o_custkey") == F.col("c_custkey"))
    pr, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    x = F.col("o_totalprice")
    zone = F.when(F.col("c_nationkey") < 12, "").otherwise("08")
    d = o.groupBy(
        F.lit("etwfe").alias("estimator"),
        F.when(seg < "H", "FP_UP").otherwise("UP_UNP").alias("pairing"),
        F.concat_ws("-", seg, pr, zone).alias("run_id"),
        F.when(F.col("o_orderstatus") == "P", "calendar").otherwise("event").alias("aggregation"),
        F.when(pr < "3", "gpp").otherwise("nep").alias("outcome"),
        F.when(pr < "3", "log1p").otherwise("none").alias("transform"),
        F.when(pr.isin("1-URGENT", "3-MEDIUM"), "").otherwise("Low severity").alias("stratum"),
        zone.alias("ecoregion"), (F.year("o_orderdate") - 1996).cast("double").alias("time")
    ).agg((F.avg(x) / 1234567.8).alias("estimate"),
          (F.stddev_samp(x) / 1234567.8 / F.sqrt(F.count(F.lit(1)))).alias("std_error"))
    return d.withColumns({
        "conf_low": F.col("estimate") - 1.96 * F.col("std_error"),
        "conf_high": F.col("estimate") + 1.96 * F.col("std_error"),
        "time_type": F.col("aggregation")})


def finished(spark, sf):
    d = est(spark, sf)
    man = d.groupBy("estimator", "run_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.lit("ok").alias("arm"))
    return S.finish_results(d, man, ["n_rows", "arm"], {k: v[2] for k, v in P.PAIRINGS.items()})


@query("finish_results", EST + """SELECT rid AS run_id, aggregation, time, arm, 'ok' AS match_arm,
    CASE WHEN transform = 'log1p' THEN 'proportion' ELSE 'native' END AS scale,
    count(*) OVER (PARTITION BY rid) AS n_rows, round(estimate, 6) AS estimate,
    round(estimate_bt, 6) AS estimate_bt FROM fr""")
def finish_results(spark, sf):
    return finished(spark, sf).select(
        "run_id", "aggregation", "time", "arm", "match_arm", "scale", "n_rows",
        F.round("estimate", 6).alias("estimate"), F.round("estimate_bt", 6).alias("estimate_bt"))


@query("se_ratio", EST + """SELECT rid AS run_id, aggregation, time, round(ratio, 5)
    AS se_ratio_prev FROM fr""")
def se_ratio(spark, sf):
    return finished(spark, sf).select("run_id", "aggregation", "time", F.round(
        "se_ratio_prev", 5).alias("se_ratio_prev"))


@query("collapse_flags", EST + """SELECT rid AS run_id, aggregation, time FROM fr
    WHERE ratio < 0.9""")
def collapse_flags(spark, sf):
    return S.collapse_flags(finished(spark, sf), 0.9).select("run_id", "aggregation", "time")


SPEC = [("Figure A", "etwfe", "FP_UP", "event", "statewide", "stratified"),
        ("Figure B", "etwfe", "FP_UP", "event", "all", "stratified"),
        ("Figure C", "etwfe", "UP_UNP", "calendar", "eco", "pooled")]
WANT = [("gpp", "flux", "log1p"), ("nep", "flux", "none")]
FIG = EST + """, fg AS (SELECT *, CASE WHEN pairing = 'FP_UP' THEN CASE WHEN ecoregion = '' THEN
    'Figure A; Figure B' ELSE 'Figure B' END ELSE 'Figure C' END AS figures FROM fr WHERE
    (pairing = 'FP_UP' AND aggregation = 'event' AND stratum <> '') OR (pairing = 'UP_UNP'
    AND aggregation = 'calendar' AND stratum = '' AND ecoregion = '08')), fv AS (SELECT pairing,
    outcome, stratum, ecoregion, aggregation, time, figures, min(CASE WHEN transform = 'log1p'
    THEN estimate_bt * 100 ELSE estimate END) AS value FROM fg WHERE std_error IS NOT NULL
    GROUP BY ALL) """


def figs(spark, sf):
    spec = registry(spark, ["figure", "estimator", "pairing", "aggregation", "ecoregions",
                            "strata"], SPEC)
    want = registry(spark, ["outcome", "block", "fig_transform"], WANT)
    return S.figure_rows(finished(spark, sf), spec, want, ["08"])


@query("figure_rows", FIG + """SELECT pairing, outcome, stratum, ecoregion, aggregation, time,
    figures, round(min(estimate), 6) AS estimate, CASE WHEN outcome = 'gpp' THEN 'percent' ELSE
    'gC m-2 yr-1' END AS unit FROM fg GROUP BY ALL""")
def figure_rows(spark, sf):
    return figs(spark, sf).select(
        "pairing", "outcome", "stratum", "ecoregion", "aggregation", "time", "figures",
        F.round("estimate", 6).alias("estimate"), "unit")


@query("figure_values", FIG + """SELECT pairing, outcome, transform, stratum, ecoregion, aggregation,
    time, round(v, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi, round(hi - lo, 6) AS ci_width,
    coalesce(transform = CASE outcome WHEN 'gpp' THEN 'log1p' ELSE 'none' END AND v IS NOT NULL
      AND lo IS NOT NULL AND hi IS NOT NULL, false) AS fig_row FROM (SELECT pairing, outcome,
      transform, stratum, ecoregion, aggregation, time,
      min(CASE WHEN transform = 'log1p' THEN expm1_(estimate) ELSE estimate END) AS v,
      min(CASE WHEN transform = 'log1p' THEN expm1_(conf_low) ELSE conf_low END) AS lo,
      min(CASE WHEN transform = 'log1p' THEN expm1_(conf_high) ELSE conf_high END) AS hi FROM fg
      GROUP BY ALL)"""
    .replace("expm1_(", "100 * (-1 + exp(").replace(") ELSE", ")) ELSE"))
def figure_values(spark, sf):
    """Value, interval and width on the scale that a figure draws."""
    return figs(spark, sf).select(
        "pairing", "outcome", "transform", "stratum", "ecoregion", "aggregation", "time",
        *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi", "ci_width")], "fig_row")


@query("applied_windows", FIG + """SELECT pairing, outcome, stratum, ecoregion, time, figures
    FROM (SELECT DISTINCT pairing, outcome, stratum, ecoregion, aggregation, time, figures FROM fg)
    WHERE CASE WHEN aggregation = 'calendar' THEN time BETWEEN 0 AND 3
    WHEN outcome = 'gpp' THEN time BETWEEN -1 AND 2 ELSE time BETWEEN 0 AND 4 END""")
def applied_windows(spark, sf):
    d = figs(spark, sf)
    caps = d.where("aggregation = 'event'").groupBy("pairing", "outcome").agg(
        F.when(F.col("outcome") == "gpp", 2).otherwise(4).alias("cap_use"),
        F.when(F.col("outcome") == "gpp", -20).cast("int").alias("cap_lo_use"))
    cal = registry(spark, ["outcome", "cal_lo", "cal_hi"], [("gpp", 0, 3), ("nep", 0, 3)])
    return S.apply_windows(d, caps, ["pairing", "outcome"], cal, -9).select(
        "pairing", "outcome", "stratum", "ecoregion", "time", "figures")


@query("completeness", """WITH e AS (SELECT o_orderpriority AS arm, c_custkey FROM customer,
    (SELECT DISTINCT o_orderpriority FROM orders)), d AS (SELECT DISTINCT o_orderpriority AS arm,
    o_custkey FROM orders) SELECT arm, count(*) AS n_runs, count(o_custkey) AS n_done, count(*)
    - count(o_custkey) AS n_missing, round(100.0 * count(o_custkey) / count(*), 2) AS pct_done
    FROM e LEFT JOIN d USING (arm) WHERE d.o_custkey = e.c_custkey OR TRUE GROUP BY arm"""
    .replace("LEFT JOIN d USING (arm) WHERE d.o_custkey = e.c_custkey OR TRUE",
             "LEFT JOIN d ON d.arm = e.arm AND d.o_custkey = e.c_custkey")
    .replace("SELECT arm, count(*) AS n_runs", "SELECT e.arm AS arm, count(*) AS n_runs")
    .replace("GROUP BY arm", "GROUP BY e.arm"))
def completeness(spark, sf):
    arms = registry(spark, ["arm"], [("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",),
                                     ("4-NOT SPECIFIED",), ("5-LOW",)])
    exp = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit")).join(
        arms, F.lit(True))
    done = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"),
                                             F.col("o_custkey").alias("unit"))
    return S.completeness_by(exp, done, ["arm", "unit"], ["arm"])


@query("run_state", """WITH r AS (SELECT o_custkey AS k, count(CASE WHEN o_orderstatus = 'F' THEN 1
    END) AS n, max(CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'O' THEN 'error'
    ELSE 'skipped' END) AS s FROM orders GROUP BY ALL)
    SELECT c_custkey AS run_id, CASE WHEN n > 0 THEN 'done' WHEN s IN ('error', 'skipped') THEN s
    ELSE 'missing' END AS state FROM customer LEFT JOIN r ON k = c_custkey""")
def run_state(spark, sf):
    st = F.col("o_orderstatus")
    r = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.when(st == "F", F.col("o_totalprice")).alias("estimate"),
        F.when(st == "F", "ok").when(st == "O", "error").otherwise("skipped").alias("status"),
        st.alias("message"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return S.run_state(c, r, ["run_id"]).select("run_id", "state")
