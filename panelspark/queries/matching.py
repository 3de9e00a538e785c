"""Windows, exact cells, scores, balance, ranking and one-to-one matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators import balance as B
from panelspark.operators import matching as M
from panelspark.operators.penalty import Path, choose_penalty, fit_scores
from panelspark.operators.penalty import penalty_path as whole_path
from panelspark.operators.trees import Boost, boosted_scores, split_table
from panelspark.plans.match import balance_before_after, match_config
from panelspark.queries.base import (cohorts, n_if, query, table, with_, yearly_value)
from panelspark.session import cut_lineage


@query("window_bounds", with_("cohorts", w="""SELECT pixel_id, gvar, lulc, CASE
    WHEN lulc = 'BUILDING' THEN CASE WHEN gvar = 0 OR gvar <= 1995 THEN 1995
      WHEN gvar > 2000 THEN gvar - 5 WHEN gvar - 1995 < 3 THEN 1995 ELSE 1995 END
    ELSE CASE WHEN gvar > 0 THEN greatest(gvar - 5, 1995) END END AS a, CASE
    WHEN lulc = 'BUILDING' THEN CASE WHEN gvar = 0 OR gvar <= 1995 THEN 1999
      WHEN gvar > 2000 THEN gvar - 1 WHEN gvar - 1995 < 3 THEN 1999 ELSE gvar - 1 END
    ELSE CASE WHEN gvar > 0 THEN gvar - 1 - CASE WHEN lulc = 'MACHINERY' THEN 1 ELSE 0 END END
    END AS b FROM cohorts""") + """SELECT pixel_id,
    CASE WHEN b - a + 1 >= 3 THEN CAST(a AS INTEGER) END AS win_start,
    CASE WHEN b - a + 1 >= 3 THEN CAST(b AS INTEGER) END AS win_end,
    CASE WHEN b - a + 1 >= 3 THEN a || '_' || b END AS win_key FROM w""")
def window_bounds(spark, sf):
    return windows(spark, sf).select("pixel_id", "win_start", "win_end", "win_key")


def windows(spark, sf):
    c = cohorts(spark, sf)
    y = F.when(F.col("gvar") > 0, F.col("gvar"))
    arm = F.when(F.col("lulc") == "BUILDING", "pa").when(
        F.col("lulc") == "MACHINERY", "thin").otherwise("fire")
    w = M.window_bounds(y, arm, F.col("lulc") == "BUILDING", (1995, 1999), 1995)
    d = c.withColumn("__w", w)
    return d.withColumn("win_start", F.col("__w.start")).withColumn(
        "win_end", F.col("__w.end")).withColumn(
        "win_key", F.when(F.col("__w").isNotNull(), M.window_key(F.col("__w")))).drop("__w")


PRE = with_("cohorts", "yearly_value", t="""SELECT pixel_id, gvar - 3 AS a, gvar - 1 AS b
    FROM cohorts WHERE gvar >= 1998""")


@query("pretreatment_mean", PRE + """SELECT t.pixel_id, CAST(a AS INTEGER) AS win_start,
    CAST(b AS INTEGER) AS win_end, CASE WHEN count(value) >= 2 THEN round(avg(value), 6) END
    AS value_pre FROM t LEFT JOIN yearly_value v ON v.pixel_id = t.pixel_id
    AND year BETWEEN a AND b GROUP BY ALL""")
def pretreatment_mean(spark, sf):
    u = cohorts(spark, sf).where(F.col("gvar") >= 1998).select(
        "pixel_id", (F.col("gvar") - 3).alias("win_start"), (F.col("gvar") - 1).alias("win_end"))
    return M.pretreatment_mean(u, yearly_value(spark, sf), "value_pre", 2).withColumn(
        "value_pre", F.round("value_pre", 6))


LEVELS = with_("cohorts", t="""SELECT pixel_id, lulc, zone, x1, gvar - 3 || '_' || gvar - 1
    AS win_key, 1 AS treat FROM cohorts WHERE gvar >= 1998""", lv="""SELECT * FROM t UNION ALL
    SELECT c.pixel_id, c.lulc, c.zone, c.x1, k.win_key, 0 FROM cohorts c JOIN (SELECT DISTINCT
    win_key, lulc FROM t) k ON k.lulc = c.lulc WHERE c.gvar = 0""",
    lz="""SELECT * FROM t UNION ALL SELECT c.pixel_id, c.lulc, c.zone, c.x1, k.win_key, 0
    FROM cohorts c JOIN (SELECT DISTINCT win_key, lulc, zone FROM t) k ON k.lulc = c.lulc
    AND k.zone = c.zone WHERE c.gvar = 0""")


def levels(spark, sf, cell=("lulc",)):
    """Treated rows of every pre-treatment window with the controls of their cells."""
    c = cohorts(spark, sf)
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pixel_id")).agg(
        F.avg("o_totalprice").alias("x2"), F.count(F.lit(1)).cast("double").alias("x3"))
    c = c.join(o, "pixel_id", "left")
    t = c.where(F.col("gvar") >= 1998).withColumn("win_end", F.col("gvar") - 1).withColumn(
        "win_key", F.concat_ws("_", (F.col("gvar") - 3).cast("string"),
                               (F.col("gvar") - 1).cast("string")))
    return M.cohort_levels(t, c.where(F.col("gvar") == 0), cell).drop("gvar")


@query("level_pool", LEVELS + """SELECT win_key, zone, count(*) AS n_input,
    CAST(sum(treat) AS BIGINT) AS n_treat, CAST(sum(1 - treat) AS BIGINT) AS n_control
    FROM lz GROUP BY ALL""")
def level_pool(spark, sf):
    return M.level_sizes(levels(spark, sf, ("lulc", "zone")), ["win_key", "zone"])


@query("late_protection_filter", LEVELS + """SELECT win_key, count(*) AS n FROM lv
    WHERE treat = 0 AND CAST(right(win_key, 4) AS INTEGER) + 1 >= 1990 + CAST(zone AS INTEGER) % 12
    GROUP BY win_key""")
def late_protection_filter(spark, sf):
    c = cohorts(spark, sf).withColumn("pa_est_year", F.when(
        F.col("zone").cast("int") % 12 != 0, 1990 + F.col("zone").cast("int") % 12))
    t = c.where(F.col("gvar") >= 1998).withColumn("win_end", F.col("gvar") - 1).withColumn(
        "win_key", F.concat_ws("_", (F.col("gvar") - 3).cast("string"),
                               (F.col("gvar") - 1).cast("string")))
    d = M.cohort_levels(t, c.where(F.col("gvar") == 0), ["lulc"], floor=1990)
    return d.where("treat = 0").groupBy("win_key").agg(F.count(F.lit(1)).alias("n"))


@query("exact_rank_match", LEVELS + """, r AS (SELECT *, row_number() OVER (PARTITION BY win_key,
    lulc, zone, treat ORDER BY pixel_id) AS k FROM lz) SELECT a.win_key, a.lulc, a.zone,
    a.pixel_id AS treated_id, b.pixel_id AS control_id FROM r a JOIN r b ON a.win_key = b.win_key
    AND a.lulc = b.lulc AND a.zone = b.zone AND a.k = b.k AND a.treat = 1 AND b.treat = 0""")
def exact_rank_match(spark, sf):
    return M.rank_match(levels(spark, sf, ("lulc", "zone")), ["win_key", "lulc", "zone"])


@query("feasibility", LEVELS + f""", n AS (SELECT win_key, zone, CAST(sum(treat) AS BIGINT) AS nt,
    CAST(sum(1 - treat) AS BIGINT) AS nc FROM lz GROUP BY ALL) SELECT win_key,
    CAST(sum(nt) AS BIGINT) AS n_treat, CAST(sum(nc) AS BIGINT) AS n_control,
    count(*) AS n_cells, {n_if("nt > 0 AND nc > 0")} AS cells_with_both,
    CAST(sum(least(nt, nc)) AS BIGINT) AS max_pairs,
    round(100.0 * sum(least(nt, nc)) / sum(nt), 1) AS pct_treat_matchable,
    CASE WHEN sum(nc) < sum(nt) THEN 'control' ELSE 'treatment' END AS binding_side
    FROM n GROUP BY win_key""")
def feasibility(spark, sf):
    return B.feasibility(levels(spark, sf, ("lulc", "zone")), ["win_key"], ["zone"])


BAL = LEVELS + """, x AS (SELECT win_key, treat, x1 AS v FROM lv), m AS (SELECT win_key,
    count(*) FILTER (treat = 1) AS n_treat, count(*) FILTER (treat = 0) AS n_ctrl,
    avg(v) FILTER (treat = 1) AS mt, avg(v) FILTER (treat = 0) AS mc,
    stddev_samp(v) FILTER (treat = 1) AS st, stddev_samp(v) FILTER (treat = 0) AS sc
    FROM x GROUP BY win_key), g AS (SELECT win_key, v, sum(sum(treat)) OVER w / sum(sum(treat))
    OVER p AS ft, sum(sum(1 - treat)) OVER w / sum(sum(1 - treat)) OVER p AS fc FROM x
    GROUP BY win_key, v WINDOW w AS (PARTITION BY win_key ORDER BY v),
    p AS (PARTITION BY win_key)), e AS (SELECT win_key, avg(abs(ft - fc)) AS em,
    max(abs(ft - fc)) AS ex FROM g GROUP BY win_key) """


@query("balance_table", BAL + """SELECT win_key, 'x1' AS covariate, n_treat, n_ctrl,
    round(mt, 6) AS mean_treat, round(mc, 6) AS mean_ctrl, round((mt - mc) / st, 6) AS smd,
    round(st * st / (sc * sc), 6) AS vr, round(em, 6) AS ecdf_mean, round(ex, 6) AS ecdf_max
    FROM m JOIN e USING (win_key)""")
def balance_table(spark, sf):
    return B.balance_table(levels(spark, sf), ["win_key"], ["x1"], "unadjusted").select(
        "win_key", "covariate", "n_treat", "n_ctrl", *[F.round(c, 6).alias(c) for c in (
            "mean_treat", "mean_ctrl", "smd", "vr", "ecdf_mean", "ecdf_max")])


@query("pooled_moments", """WITH l AS (SELECT c_mktsegment, c_nationkey, count(*) AS n,
    avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY ALL)
    SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n_all, round(avg(c_acctbal), 6) AS mean_all,
    round(stddev_samp(c_acctbal), 6) AS sd_all FROM customer GROUP BY c_mktsegment""")
def pooled_moments(spark, sf):
    lv = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"),
        F.stddev_samp("c_acctbal").alias("s"))
    return B.pool_moments(lv, ["c_mktsegment"], "n", "m", "s", "all").select(
        "c_mktsegment", "n_all", F.round("mean_all", 6).alias("mean_all"),
        F.round("sd_all", 6).alias("sd_all"))


# specs and balance rows built from orders: config = priority, level = year
SPEC = """WITH specs AS (SELECT 'p' || o_orderstatus AS pairing, 'base' AS arm, o_orderpriority
    AS config, CAST(year(o_orderdate) AS VARCHAR) AS win_key, CAST(year(o_orderdate) AS INTEGER)
    AS cohort_year, 300 + 10 * (year(o_orderdate) - 1995) AS n_treat, 1000 AS n_control,
    CASE WHEN count(*) % 11 = 0 THEN 'failed: no rows' ELSE 'ok' END AS status,
    2 * least(count(*) + 150, 300) AS n_matched FROM orders GROUP BY ALL), lv AS (SELECT pairing,
    arm, win_key, min(cohort_year) AS cohort_year, max(n_treat) AS nt, max(n_control) AS nc,
    count(DISTINCT config) AS k, count(DISTINCT n_treat) AS kt FROM specs GROUP BY ALL) """


def specs(spark, sf):
    o = table(spark, sf, "orders").groupBy(
        F.concat(F.lit("p"), "o_orderstatus").alias("pairing"), F.lit("base").alias("arm"),
        F.col("o_orderpriority").alias("config"), F.year("o_orderdate").alias("cohort_year")
    ).agg(F.count(F.lit(1)).alias("c"))
    return o.select("pairing", "arm", "config", F.col("cohort_year").cast("string").alias(
        "win_key"), "cohort_year", (300 + 10 * (F.col("cohort_year") - 1995)).cast("long").alias(
        "n_treat"), F.lit(1000).cast("long").alias("n_control"), F.when(
        F.col("c") % 11 == 0, "failed: no rows").otherwise("ok").alias("status"),
        (2 * F.least(F.col("c") + 150, F.lit(300))).alias("n_matched"))


@query("level_ledger", SPEC + """SELECT pairing, arm, win_key, cohort_year, nt AS n_treat_level,
    CAST(nc AS BIGINT) AS n_ctrl_level, k AS n_configs_run, kt AS n_distinct_treat FROM lv""")
def level_ledger(spark, sf):
    return B.level_ledger(specs(spark, sf))


COV = SPEC + """, d AS (SELECT pairing, arm, count(*) AS tot, CAST(sum(nt) AS BIGINT) AS ntm
    FROM lv GROUP BY ALL), cov AS (SELECT pairing, arm, config, count(*) FILTER (status = 'ok')
    AS n_levels_ok, count(*) FILTER (status <> 'ok') AS n_levels_failed,
    CAST(coalesce(sum(n_treat) FILTER (status <> 'ok'), 0) AS BIGINT) AS n_treat_failed,
    coalesce(max(CASE WHEN status <> 'ok' THEN 'no rows' END), '') AS fail_reasons,
    sum(n_matched) FILTER (status = 'ok') / 2 AS n_matched_pairs, any_value(tot) AS tot,
    any_value(ntm) AS ntm FROM specs JOIN d USING (pairing, arm) GROUP BY ALL) """


@query("config_coverage", COV + """SELECT pairing, arm, config, n_levels_ok, n_levels_failed,
    n_treat_failed, fail_reasons, tot AS n_levels_total, ntm AS n_treat_matchable,
    tot - n_levels_ok - n_levels_failed AS n_levels_absent,
    tot = n_levels_ok + n_levels_failed AS run_complete,
    round(n_matched_pairs / ntm, 6) AS match_rate FROM cov""")
def config_coverage(spark, sf):
    return B.coverage(specs(spark, sf)).select(
        "pairing", "arm", "config", "n_levels_ok", "n_levels_failed", "n_treat_failed",
        "fail_reasons", "n_levels_total", "n_treat_matchable", "n_levels_absent",
        "run_complete", F.round("match_rate", 6).alias("match_rate"))


def bal_rows(spark, sf):
    """Balance rows per (pairing, arm, config, level, covariate, stage) from orders."""
    o = table(spark, sf, "orders").withColumn("t", (F.col("o_orderkey") % 3 == 0).cast("int"))
    x = F.col("o_totalprice") / 1000
    long = o.select(
        F.concat(F.lit("p"), "o_orderstatus").alias("pairing"),
        F.when(F.col("o_custkey") % 2 == 0, "base").otherwise("wide").alias("arm"),
        F.col("o_orderpriority").alias("config"),
        F.year("o_orderdate").cast("string").alias("win_key"), "t",
        F.explode(F.array(
            F.struct(F.lit("price").alias("covariate"), x.alias("v")),
            F.struct(F.when(F.col("o_custkey") % 2 == 0, "month").otherwise("day")
                     .alias("covariate"), F.month("o_orderdate").cast("double").alias("v"))
        )).alias("c"))
    v = F.col("c.v")
    g = long.groupBy("pairing", "arm", "config", "win_key", F.col("c.covariate").alias("covariate"))
    one = F.col("t") == 1
    b = g.agg(F.count(F.when(one, v)).alias("n_treat"), F.count(F.when(~one, v)).alias("n_ctrl"),
              F.avg(F.when(one, v)).alias("mean_treat"), F.avg(F.when(~one, v)).alias("mean_ctrl"),
              F.stddev_samp(F.when(one, v)).alias("sd_treat"),
              F.stddev_samp(F.when(~one, v)).alias("sd_ctrl"))
    b = b.withColumn("ecdf_mean", F.abs("mean_treat") / 1000).withColumn(
        "ecdf_max", F.abs("mean_ctrl") / 1000)
    un = b.withColumn("stage", F.lit("unadjusted")).where("config = '1-URGENT'")
    return b.withColumn("stage", F.lit("adjusted")).unionByName(un)


BROWS = """WITH o AS (SELECT 'p' || o_orderstatus AS pairing, CASE WHEN o_custkey % 2 = 0 THEN
    'base' ELSE 'wide' END AS arm, o_orderpriority AS config,
    CAST(year(o_orderdate) AS VARCHAR) AS win_key, o_orderkey % 3 = 0 AS t,
    unnest(['price', CASE WHEN o_custkey % 2 = 0 THEN 'month' ELSE 'day' END]) AS covariate,
    unnest([o_totalprice / 1000, CAST(month(o_orderdate) AS DOUBLE)]) AS v FROM orders),
    u AS (SELECT pairing, arm, covariate, stddev_samp(v) FILTER (t) AS den FROM o
      WHERE config = '1-URGENT' GROUP BY ALL),
    a AS (SELECT pairing, arm, config, covariate, count(*) FILTER (t) AS n_treat,
      avg(v) FILTER (t) AS mt, avg(v) FILTER (NOT t) AS mc, stddev_samp(v) FILTER (t) AS st,
      stddev_samp(v) FILTER (NOT t) AS sc FROM o GROUP BY ALL),
    w AS (SELECT pairing, arm, config, covariate, win_key, count(*) FILTER (t) AS nt,
      abs(avg(v) FILTER (NOT t)) / 1000 AS ex FROM o GROUP BY ALL),
    s AS (SELECT a.*, (mt - mc) / den AS smd, (st / sc) ** 2 AS vr FROM a
      JOIN u USING (pairing, arm, covariate)) """


@query("covariate_summary", BROWS + """SELECT pairing, arm, config, covariate,
    CAST(n_treat AS DOUBLE) AS n_treat, round(mt, 6) AS mean_treat, round(st, 6) AS sd_treat,
    round(smd, 6) AS smd, round(vr, 6) AS vr, (SELECT round(sum(ex * nt) / sum(nt), 6) FROM w
      WHERE w.pairing = s.pairing AND w.arm = s.arm AND w.config = s.config
      AND w.covariate = s.covariate) AS ecdf_max_wavg,
    (SELECT arg_max(win_key, (ex, win_key)) FROM w WHERE w.pairing = s.pairing AND w.arm = s.arm
      AND w.config = s.config AND w.covariate = s.covariate) AS worst_level FROM s""")
def covariate_summary(spark, sf):
    return B.covariate_summary(bal_rows(spark, sf)).where("stage = 'adjusted'").select(
        "pairing", "arm", "config", "covariate", "n_treat", *[F.round(c, 6).alias(c) for c in (
            "mean_treat", "sd_treat", "smd", "vr", "ecdf_max_wavg")], "worst_level")


@query("shared_covariates", BROWS + """SELECT pairing, arm, config,
    round(max(abs(smd)) FILTER (covariate = 'price'), 6) AS max_smd_shared,
    round(avg(abs(smd)) FILTER (covariate = 'price'), 6) AS mean_smd_shared,
    round(max(abs(smd)) FILTER (covariate <> 'price'), 6) AS max_smd_added,
    string_agg(covariate, ', ') FILTER (covariate <> 'price') AS added_cov
    FROM s GROUP BY ALL""")
def shared_covariates(spark, sf):
    return B.shared_covariates(B.covariate_summary(bal_rows(spark, sf))).select(
        "pairing", "arm", "config", *[F.round(c, 6).alias(c) for c in (
            "max_smd_shared", "mean_smd_shared", "max_smd_added")], "added_cov")


GATE = {**P.GATE, "ceiling_config": "5-LOW", "retention_min": 0.97, "smd_max": 0.08}


@query("config_rank", BROWS[:-1] + ", " + COV[5:] + """, b AS (SELECT pairing, config,
    max(abs(smd)) AS mx, avg(abs(smd)) AS mn, count(*) FILTER (abs(smd) > 0.08) AS no,
    count(*) FILTER (vr < 0.5 OR vr > 2) AS nv FROM s WHERE s.arm = 'base' GROUP BY ALL),
    r AS (SELECT cov.*, mx, mn, no, nv, n_matched_pairs / ntm AS mr FROM cov
      LEFT JOIN b USING (pairing, config) WHERE tot = n_levels_ok + n_levels_failed),
    q AS (SELECT *, mr / max(mr) FILTER (config = '5-LOW') OVER (PARTITION BY pairing) AS ret
      FROM r), z AS (SELECT *, ret >= 0.97 AS mf, ret >= 0.97 AND no = 0 AND nv = 0 AS el FROM q)
    SELECT pairing, config, round(ret, 6) AS retention_ratio, mf AS meets_floor, el AS eligible,
    CAST(row_number() OVER (PARTITION BY pairing ORDER BY el DESC, mf DESC, CASE WHEN el THEN mn
      ELSE mx END, config) AS INTEGER) AS rank FROM z""")
def config_rank(spark, sf):
    summ = B.covariate_summary(bal_rows(spark, sf)).where("arm = 'base'")
    return B.rank_configs(B.coverage(specs(spark, sf)), summ, GATE).select(
        "pairing", "config", F.round("retention_ratio", 6).alias("retention_ratio"),
        "meets_floor", "eligible", "rank")


X = ["x1", "x2", "x3"]


@query("score_fit")
def score_fit(spark, sf):
    """Score equations at the fitted coefficients: all sums are zero."""
    d = levels(spark, sf)
    s = M.linear_score(d, fit_scores(d, ["win_key"], X), ["win_key"], X)
    r = F.col("treat") - 1 / (1 + F.exp(-F.col("score")))
    return s.groupBy("win_key").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(r), 4).alias("intercept_sum"),
        *[F.round(F.sum(r * F.col(c)) / F.sum(F.abs(F.col(c))), 4).alias(f"{c}_sum") for c in X])


@query("score_fit_check", LEVELS + """SELECT win_key, count(*) AS n, true AS at_optimum FROM lv
    GROUP BY win_key""")
def score_fit_check(spark, sf):
    s = score_fit(spark, sf)
    ok = F.abs("intercept_sum") < 1e-3
    for c in X:
        ok = ok & (F.abs(f"{c}_sum") < 1e-3)
    return s.select("win_key", "n", ok.alias("at_optimum"))


_ROWS = LEVELS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT o_custkey AS pixel_id,
    avg(o_totalprice) AS x2, CAST(count(*) AS DOUBLE) AS x3 FROM orders GROUP BY 1),
    x AS (SELECT win_key, lulc, treat, lv.pixel_id, x1, x2, x3 FROM lv JOIN o USING (pixel_id)
      WHERE x1 IS NOT NULL),"""
SHORT = Path(steps=4, ratio=0.05, folds=3)
# proximal gradient steps for every (level, penalty, fold), until they stand still
_PATH = """
    st AS (SELECT win_key, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2,
      avg(x3) AS m3, stddev_pop(x3) AS s3, avg(treat) AS sh, greatest(abs(covar_pop(x1, treat)) / s1,
      abs(covar_pop(x2, treat)) / s2, abs(covar_pop(x3, treat)) / s3) / 0.5 * 1.000001 AS top,
      0.5 / (sh * (1 - sh)) AS step FROM x GROUP BY win_key),
    z AS (SELECT win_key, pixel_id, treat AS y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2,
      (x3 - m3) / s3 AS z3, CAST('0x' || substr(md5('160617:' || pixel_id), 1, 8) AS BIGINT) % 3
      AS fold FROM x JOIN st USING (win_key)),
    w AS (SELECT win_key, k, fold, 0 AS turn, step, top * 0.05 ** (k / 3.0) AS lam,
        ln(sh / (1 - sh)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3
        FROM st, range(4) a(k), range(-1, 3) b(fold)
      UNION ALL SELECT win_key, k, fold, turn + 1, step, lam, b0 + step * g0,
        sign(b1 + step * g1) * greatest(abs(b1 + step * g1) - step * lam / 2, 0) / (1 + step * lam / 2),
        sign(b2 + step * g2) * greatest(abs(b2 + step * g2) - step * lam / 2, 0) / (1 + step * lam / 2),
        sign(b3 + step * g3) * greatest(abs(b3 + step * g3) - step * lam / 2, 0) / (1 + step * lam / 2)
        FROM (SELECT win_key, k, w.fold, turn, step, lam, b0, b1, b2, b3, avg(y - mu) AS g0,
          avg((y - mu) * z1) AS g1, avg((y - mu) * z2) AS g2, avg((y - mu) * z3) AS g3 FROM (SELECT w.*, y, z1, z2, z3,
            1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3))) AS mu FROM w JOIN z
            ON z.win_key = w.win_key AND z.fold <> w.fold WHERE turn < 250) w
          GROUP BY ALL)),
    fits AS (SELECT * FROM w WHERE turn = 250),
    loss AS (SELECT f.win_key, f.k, f.fold, f.lam, any_value(f.b1) AS b1, any_value(f.b2) AS b2,
      any_value(f.b3) AS b3, count(*) AS n_held, avg(ln(1 + exp(-abs(e))) + greatest(e, 0) - y * e) AS l
      FROM (SELECT f.*, y, b0 + b1 * z1 + b2 * z2 + b3 * z3 AS e FROM fits f JOIN z
        ON z.win_key = f.win_key AND z.fold = f.fold) f GROUP BY f.win_key, f.k, f.fold, f.lam),
    cv AS (SELECT win_key, k, any_value(lam) AS lam, sum(n_held * l) / sum(n_held) AS m,
      sqrt(greatest(sum(n_held * l * l) / sum(n_held) - m * m, 0) / 2) AS e FROM loss
      GROUP BY win_key, k),
    low AS (SELECT win_key, min(m) AS m, arg_min(e, (m, k)) AS e FROM cv GROUP BY win_key),
    pick AS (SELECT win_key, min(k) AS k FROM cv JOIN low USING (win_key)
      WHERE cv.m <= low.m + low.e GROUP BY win_key) """


@query("penalty_path", _ROWS + _PATH + """SELECT win_key, CAST(k AS INTEGER) AS k,
    CAST(fold AS INTEGER) AS fold, n_held, round(lam, 6) AS lam, round(b1, 4) + 0.0 AS b1,
    round(b2, 4) + 0.0 AS b2, round(b3, 4) + 0.0 AS b3, round(l, 6) AS log_loss FROM loss""")
def penalty_path(spark, sf):
    p = whole_path(_complete(levels(spark, sf)), ["win_key"], X, "pixel_id", SHORT)
    return p.where("fold >= 0").select(
        "win_key", "k", "fold", "n_held", F.round("lam", 6).alias("lam"),
        *[(F.round(F.col("beta")[i], 4) + 0.0).alias(f"b{i}") for i in (1, 2, 3)],
        F.round("log_loss", 6).alias("log_loss"))


@query("penalty_choice", _ROWS + _PATH + """SELECT win_key, CAST(k AS INTEGER) AS k,
    round(lam, 6) AS lam, round(m, 6) AS log_loss, round(e, 6) AS loss_error
    FROM pick JOIN cv USING (win_key, k)""")
def penalty_choice(spark, sf):
    p = whole_path(_complete(levels(spark, sf)), ["win_key"], X, "pixel_id", SHORT)
    return choose_penalty(p, ["win_key"]).select(
        "win_key", "k", *[F.round(c, 6).alias(c) for c in ("lam", "log_loss", "loss_error")])


def _complete(df):
    return cut_lineage(df.dropna(subset=["lulc", *X]))


FEW = Boost(trees=2, depth=2, bins=8, rate=0.3)


def _boost_sql(b: Boost) -> str:
    """The same trees step by step: histogram, best split and rows per node."""
    k = [f"""
    cuts AS MATERIALIZED (SELECT win_key, f, list_sort(list_distinct(list_transform(
      range(1, {b.bins}), lambda i: list_sort(v)[CAST(greatest(ceil(len(v) * i / {b.bins}.0 - 1e-9), 1)
        AS BIGINT)]))) AS q FROM (SELECT win_key, f, list(v) AS v FROM long GROUP BY ALL)),
    bins AS MATERIALIZED (SELECT win_key, pixel_id, f, len(list_filter(q, lambda c: c < v)) AS bin
      FROM long JOIN cuts USING (win_key, f)),
    t0 AS MATERIALIZED (SELECT win_key, pixel_id, treat, ln(sh / (1 - sh)) AS score FROM x JOIN
      (SELECT win_key, avg(treat) AS sh FROM x GROUP BY 1) USING (win_key)),"""]
    for t in range(b.trees):
        k.append(f"""
    gr{t} AS MATERIALIZED (SELECT win_key, pixel_id, treat - mu AS g, mu * (1 - mu) AS h FROM
      (SELECT *, 1 / (1 + exp(-score)) AS mu FROM t{t})),
    n{t}_0 AS MATERIALIZED (SELECT win_key, pixel_id, 0 AS node FROM t{t}),""")
        for d in range(b.depth):
            k.append(f"""
    c{t}_{d} AS (SELECT win_key, node, f, bin, sum(sum(g)) OVER w AS gl, sum(sum(h)) OVER w AS hl,
      sum(count(*)) OVER w AS nl, sum(sum(g)) OVER p AS ga, sum(sum(h)) OVER p AS ha,
      sum(count(*)) OVER p AS na FROM n{t}_{d} JOIN gr{t} USING (win_key, pixel_id)
      JOIN bins USING (win_key, pixel_id) GROUP BY win_key, node, f, bin
      WINDOW w AS (PARTITION BY win_key, node, f ORDER BY bin),
        p AS (PARTITION BY win_key, node, f)),
    s{t}_{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win_key, node
      ORDER BY gain DESC, f, bin) AS r FROM (SELECT *, round(gl * gl / (hl + {b.ridge})
        + (ga - gl) ** 2 / (ha - hl + {b.ridge}) - ga * ga / (ha + {b.ridge}), 9) AS gain FROM c{t}_{d}
        WHERE nl >= {b.keep} AND na - nl >= {b.keep})) WHERE r = 1 AND gain > 0),
    n{t}_{d + 1} AS MATERIALIZED (SELECT n.win_key, n.pixel_id, 2 * n.node + CASE WHEN e.bin > s.bin
      THEN 1 ELSE 0 END AS node FROM n{t}_{d} n LEFT JOIN s{t}_{d} s ON s.win_key = n.win_key
      AND s.node = n.node LEFT JOIN bins e ON e.win_key = n.win_key AND e.pixel_id = n.pixel_id
      AND e.f = s.f),""")
        k.append(f"""
    t{t + 1} AS MATERIALIZED (SELECT win_key, pixel_id, treat, score + {b.rate} * v AS score FROM t{t}
      JOIN n{t}_{b.depth} USING (win_key, pixel_id) JOIN (SELECT win_key, node,
        sum(g) / (sum(h) + {b.ridge}) AS v FROM n{t}_{b.depth} JOIN gr{t} USING (win_key, pixel_id)
        GROUP BY ALL) USING (win_key, node)),""")
    return """
    long AS MATERIALIZED (SELECT win_key, pixel_id, unnest([1, 2, 3]) AS f, unnest([x1, x2, x3]) AS v
      FROM x),""" + "".join(k) + f"""
    sc AS MATERIALIZED (SELECT win_key, pixel_id, score FROM t{b.trees})"""


@query("tree_scores", _ROWS + _boost_sql(FEW) + """
    SELECT win_key, pixel_id, round(score, 6) AS score FROM sc""")
def tree_scores(spark, sf):
    d = boosted_scores(_complete(levels(spark, sf)), ["win_key"], X, FEW)
    return d.select("win_key", "pixel_id", F.round("score", 6).alias("score"))


@query("tree_splits", _ROWS + _boost_sql(FEW) + " " + " UNION ALL ".join(f"""SELECT win_key,
    {t}::INTEGER AS tree, {d}::INTEGER AS depth, node::INTEGER AS node, 'x' || f AS covariate,
    round(q[bin + 1], 6) AS cut FROM s{t}_{d} JOIN cuts USING (win_key, f)"""
    for t in range(FEW.trees) for d in range(FEW.depth)))
def tree_splits(spark, sf):
    return split_table(_complete(levels(spark, sf)), ["win_key"], X, FEW).withColumn(
        "cut", F.round("cut", 6))


def _matched(spark, sf, config, **kw):
    d = levels(spark, sf)
    return d, match_config(d, "win_key", ["lulc"], X, config, **kw)


# one treated unit after the other takes the nearest control still free; distances by the
# inverse of the pooled within-side covariance, written out for three covariates
_WITHIN = """
    m AS (SELECT win_key, treat, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM x GROUP BY ALL),
    s AS (SELECT x.win_key, count(*) - count(DISTINCT x.treat) AS f, sum((x1 - m1) ** 2) / f AS a,
      sum((x1 - m1) * (x2 - m2)) / f AS b, sum((x1 - m1) * (x3 - m3)) / f AS c,
      sum((x2 - m2) ** 2) / f AS e, sum((x2 - m2) * (x3 - m3)) / f AS g,
      sum((x3 - m3) ** 2) / f AS h FROM x JOIN m ON x.win_key = m.win_key AND x.treat = m.treat
      GROUP BY x.win_key),"""
_RANKS = """
    x AS (SELECT win_key, lulc, treat, pixel_id, r1 AS x1, r2 AS x2, r3 AS x3 FROM (SELECT *,
      rank() OVER w1 + (count(*) OVER (PARTITION BY win_key, x1) - 1) / 2.0 AS r1,
      rank() OVER w2 + (count(*) OVER (PARTITION BY win_key, x2) - 1) / 2.0 AS r2,
      rank() OVER w3 + (count(*) OVER (PARTITION BY win_key, x3) - 1) / 2.0 AS r3 FROM x0
      WINDOW w1 AS (PARTITION BY win_key ORDER BY x1), w2 AS (PARTITION BY win_key ORDER BY x2),
        w3 AS (PARTITION BY win_key ORDER BY x3))),
    u AS (SELECT win_key, count(*) * (count(*) + 1) / 12.0 AS a, corr(x1, x2) * a AS b,
      corr(x1, x3) * a AS c, a AS e, corr(x2, x3) * a AS g, a AS h,
      0.25 * stddev_samp(x1) AS l1, 0.25 * stddev_samp(x2) AS l2, 0.25 * stddev_samp(x3) AS l3
      FROM x GROUP BY win_key), s AS (SELECT * FROM u),"""
_WALK = """
    i AS (SELECT win_key, a * (e * h - g * g) - b * (b * h - g * c) + c * (b * g - e * c) AS det,
      (e * h - g * g) / det AS i11, (c * g - b * h) / det AS i12, (b * g - c * e) / det AS i13,
      (a * h - c * c) / det AS i22, (b * c - a * g) / det AS i23, (a * e - b * b) / det AS i33
      FROM s),
    tr AS (SELECT *, row_number() OVER (PARTITION BY win_key, lulc ORDER BY pixel_id) AS k FROM x
      WHERE treat = 1),
    cand AS (SELECT tr.win_key, tr.lulc, tr.k, tr.pixel_id AS tid, u.pixel_id AS cid,
      sqrt(i11 * (tr.x1 - u.x1) ** 2 + i22 * (tr.x2 - u.x2) ** 2 + i33 * (tr.x3 - u.x3) ** 2
        + 2 * (i12 * (tr.x1 - u.x1) * (tr.x2 - u.x2) + i13 * (tr.x1 - u.x1) * (tr.x3 - u.x3)
        + i23 * (tr.x2 - u.x2) * (tr.x3 - u.x3))) AS d,
      (tr.pixel_id % 1000003 * 7919 + u.pixel_id % 1000003 * 104729) % 1000003 AS mix
      FROM tr JOIN x u ON u.win_key = tr.win_key AND u.lulc = tr.lulc AND u.treat = 0
      JOIN i ON i.win_key = tr.win_key),
    walk AS (SELECT DISTINCT win_key, lulc, 0::BIGINT AS k, []::BIGINT[] AS used,
        []::STRUCT(tid BIGINT, cid BIGINT, d DOUBLE)[] AS pairs FROM tr
      UNION ALL SELECT w.win_key, w.lulc, w.k + 1, CASE WHEN count(c.cid) = 0 THEN any_value(w.used)
        ELSE list_append(any_value(w.used), arg_min(c.cid, (c.d, c.mix, c.cid))) END,
      CASE WHEN count(c.cid) = 0 THEN any_value(w.pairs) ELSE list_append(any_value(w.pairs),
        arg_min({'tid': c.tid, 'cid': c.cid, 'd': c.d}, (c.d, c.mix, c.cid))) END
      FROM walk w JOIN tr ON tr.win_key = w.win_key AND tr.lulc = w.lulc AND tr.k = w.k + 1
      LEFT JOIN cand c ON c.win_key = w.win_key AND c.lulc = w.lulc AND c.k = w.k + 1
        AND NOT list_contains(w.used, c.cid) GROUP BY w.win_key, w.lulc, w.k),
    p AS (SELECT win_key, lulc, unnest(pairs) AS p FROM (SELECT win_key, lulc,
      arg_max(pairs, k) AS pairs FROM walk GROUP BY ALL)) """


ONE_BY_ONE = _ROWS + _WITHIN + _WALK
IN_REACH = """ AND abs(tr.x1 - u.x1) <= q.l1 AND abs(tr.x2 - u.x2) <= q.l2
      AND abs(tr.x3 - u.x3) <= q.l3"""
RANKED = _ROWS.replace("    x AS (SELECT", "    x0 AS (SELECT") + _RANKS + _WALK.replace(
    "JOIN i ON i.win_key = tr.win_key", "JOIN i ON i.win_key = tr.win_key JOIN u q ON q.win_key = "
    "tr.win_key" + IN_REACH)


@query("nearest_match", ONE_BY_ONE + """SELECT win_key, lulc, win_key || ':' || p.tid AS subclass,
    unnest([1, 0])::INTEGER AS treat, unnest([p.tid, p.cid]) AS pixel_id,
    round(p.d, 6) AS distance FROM p""")
def nearest_match(spark, sf):
    _d, m = _matched(spark, sf, "mahal_nocal")
    return m.select("win_key", "lulc", "subclass", "treat", "pixel_id",
                    F.round("distance", 6).alias("distance"))


# scored units choose first; a caliper of a quarter deviation of the score
_SCORED = _WALK.replace("ORDER BY pixel_id) AS k FROM x\n      WHERE", """ORDER BY score DESC, pixel_id)
      AS k FROM x JOIN sc USING (win_key, pixel_id) WHERE""")
_REACH = _SCORED.replace("JOIN i ON i.win_key = tr.win_key", """JOIN i ON i.win_key = tr.win_key
      JOIN sc v ON v.win_key = u.win_key AND v.pixel_id = u.pixel_id JOIN (SELECT win_key,
        0.25 * stddev_samp(score) AS cal FROM sc GROUP BY 1) q ON q.win_key = tr.win_key
        AND abs(tr.score - v.score) <= cal""")
_PICKED = """
    sc AS MATERIALIZED (SELECT win_key, pixel_id, b0 + b1 * z1 + b2 * z2 + b3 * z3 AS score
      FROM z JOIN fits USING (win_key) JOIN pick USING (win_key, k) WHERE fits.fold = -1),"""
_BY_LOSS = _PATH.rstrip().replace("min(k) AS k FROM cv JOIN low USING (win_key)\n      WHERE cv.m <= "
                                  "low.m + low.e", "arg_min(k, (m, k)) AS k FROM cv")
_PLAIN = _PATH.replace("range(4) a(k)", "range(1) a(k)").replace(
    "top * 0.05 ** (k / 3.0)", "0.0").replace("turn < 250", "turn < 600").replace(
    "turn = 250", "turn = 600").rstrip()
PAIRS = """SELECT win_key, lulc, win_key || ':' || p.tid AS subclass,
    unnest([1, 0])::INTEGER AS treat, unnest([p.tid, p.cid]) AS pixel_id,
    round(p.d, 6) AS distance FROM p"""


@query("nearest_match_caliper", _ROWS + _PLAIN + "," + _PICKED + _WITHIN + _REACH + PAIRS)
def nearest_match_caliper(spark, sf):
    _d, m = _matched(spark, sf, "mahal_pscal")
    return m.select("win_key", "lulc", "subclass", "treat", "pixel_id",
                    F.round("distance", 6).alias("distance"))


@query("robust_match", RANKED + """SELECT win_key, lulc, win_key || ':' || p.tid AS subclass,
    unnest([1, 0])::INTEGER AS treat, unnest([p.tid, p.cid]) AS pixel_id,
    round(p.d, 6) AS distance FROM p""")
def robust_match(spark, sf):
    _d, m = _matched(spark, sf, "rmahal_cal025")
    return m.select("win_key", "lulc", "subclass", "treat", "pixel_id",
                    F.round("distance", 6).alias("distance"))


@query("tree_match", _ROWS + _boost_sql(FEW) + "," + _WITHIN + _SCORED + PAIRS)
def tree_match(spark, sf):
    _d, m = _matched(spark, sf, "trees_nocal", fit={"boost": FEW})
    return m.select("win_key", "lulc", "subclass", "treat", "pixel_id",
                    F.round("distance", 6).alias("distance"))


@query("elastic_match", _ROWS + _BY_LOSS + "," + _PICKED + _WITHIN + _REACH + PAIRS)
def elastic_match(spark, sf):
    _d, m = _matched(spark, sf, "elastic_cal025", fit={"path": SHORT, "rule": "min"})
    return m.select("win_key", "lulc", "subclass", "treat", "pixel_id",
                    F.round("distance", 6).alias("distance"))


def _by_score(walk: str) -> str:
    """Distance is the gap in the score."""
    a, b = walk.index("sqrt(i11"), walk.index(" AS d,\n")
    return walk[:a] + "abs(tr.score - v.score)" + walk[b:]


def _pairs_of(config, **kw):
    def run(spark, sf):
        _d, m = _matched(spark, sf, config, **kw)
        return m.select("win_key", "lulc", "subclass", "treat", "pixel_id",
                        F.round("distance", 6).alias("distance"))
    return run


_ANY = RANKED.replace(IN_REACH, "")
query("glm_match", _ROWS + _PLAIN + "," + _PICKED + _WITHIN + _SCORED + PAIRS)(
    _pairs_of("glm_nocal"))
query("glm_match_caliper", _ROWS + _PLAIN + "," + _PICKED + _WITHIN + _by_score(_REACH) + PAIRS)(
    _pairs_of("glm_cal025"))
query("elastic_match_all", _ROWS + _BY_LOSS + "," + _PICKED + _WITHIN + _SCORED + PAIRS)(
    _pairs_of("elastic_nocal", fit={"path": SHORT, "rule": "min"}))
query("tree_match_caliper", _ROWS + _boost_sql(FEW) + "," + _WITHIN + _REACH + PAIRS)(
    _pairs_of("trees_cal025", fit={"boost": FEW}))
query("robust_match_all", _ANY + PAIRS)(_pairs_of("rmahal_nocal"))


@query("match_invariants", LEVELS + """, n AS (SELECT win_key, lulc,
    CAST(sum(treat) AS BIGINT) AS nt, CAST(sum(1 - treat) AS BIGINT) AS nc FROM lv GROUP BY ALL)
    SELECT win_key, lulc, least(nt, nc) AS n_pairs, true AS one_to_one FROM n""")
def match_invariants(spark, sf):
    """Without a caliper a cell gives as many pairs as its smaller side."""
    _d, m = _matched(spark, sf, "mahal_nocal")
    g = m.groupBy("win_key", "lulc").agg(
        F.count_distinct("subclass").alias("n_pairs"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("pixel_id").alias("k"))
    return g.select("win_key", "lulc", "n_pairs", (
        (F.col("n") == F.col("k")) & (F.col("n") == 2 * F.col("n_pairs"))).alias("one_to_one"))


@query("match_specs", LEVELS + """, n AS (SELECT win_key, lulc, count(*) AS ni,
    CAST(sum(treat) AS BIGINT) AS nt, CAST(sum(1 - treat) AS BIGINT) AS nc FROM lv GROUP BY ALL),
    s AS (SELECT win_key, sum(ni) AS ni, sum(nt) AS nt, sum(nc) AS nc, sum(least(nt, nc)) AS p
    FROM n GROUP BY ALL) SELECT win_key, CAST(ni AS BIGINT) AS n_input, CAST(nt AS BIGINT)
    AS n_treat, CAST(nc AS BIGINT) AS n_control, CAST(2 * p AS BIGINT) AS n_matched,
    round(p / nt, 6) AS match_rate, CAST(nt - p AS BIGINT) AS dropped_treated,
    CAST(nc - p AS BIGINT) AS dropped_control, 'ok' AS status FROM s""")
def match_specs(spark, sf):
    d, m = _matched(spark, sf, "nn_exact_1to1")
    return M.match_specs(d, m, ["win_key"]).withColumn("match_rate", F.round("match_rate", 6))


_GAPS = """, raw AS (SELECT lv.win_key, lv.treat, unnest(['x1', 'x2', 'x3']) AS covariate,
      unnest([lv.x1, o.x2, o.x3]) AS v FROM lv LEFT JOIN o USING (pixel_id)),
    got AS (SELECT q.win_key, q.treat, unnest(['x1', 'x2', 'x3']) AS covariate,
      unnest([lv.x1, o.x2, o.x3]) AS v FROM (SELECT win_key, unnest([1, 0]) AS treat,
        unnest([p.tid, p.cid]) AS pixel_id FROM p) q JOIN lv USING (win_key, treat, pixel_id)
      LEFT JOIN o USING (pixel_id)),
    al AS (SELECT 'unadjusted' AS stage, * FROM raw WHERE v IS NOT NULL UNION ALL
      SELECT 'adjusted', * FROM got WHERE v IS NOT NULL),
    mo AS (SELECT stage, win_key, covariate, count(*) FILTER (treat = 1) AS n_treat,
      count(*) FILTER (treat = 0) AS n_ctrl, avg(v) FILTER (treat = 1) AS mt,
      avg(v) FILTER (treat = 0) AS mc, stddev_samp(v) FILTER (treat = 1) AS st FROM al GROUP BY ALL),
    cu AS (SELECT stage, win_key, covariate, max(abs(ft - fc)) AS ex FROM (SELECT stage, win_key,
      covariate, v, sum(sum(treat)) OVER w / sum(sum(treat)) OVER g AS ft,
      sum(sum(1 - treat)) OVER w / sum(sum(1 - treat)) OVER g AS fc FROM al
      GROUP BY stage, win_key, covariate, v WINDOW w AS (PARTITION BY stage, win_key, covariate
        ORDER BY v), g AS (PARTITION BY stage, win_key, covariate)) GROUP BY ALL)
    SELECT m.win_key, m.covariate, m.stage, m.n_treat, m.n_ctrl, round((m.mt - m.mc) / u.st, 6) AS smd,
    round(ex, 6) AS ecdf_max FROM mo m JOIN cu USING (stage, win_key, covariate)
    JOIN mo u ON u.stage = 'unadjusted' AND u.win_key = m.win_key AND u.covariate = m.covariate"""


@query("score_coefficients", _ROWS + _PLAIN + """SELECT win_key, round(b0, 4) AS b0,
    round(b1, 4) AS b1, round(b2, 4) AS b2, round(b3, 4) AS b3 FROM fits WHERE fold = -1""")
def score_coefficients(spark, sf):
    fit = fit_scores(_complete(levels(spark, sf)), ["win_key"], X)
    return fit.select("win_key", *[F.round(F.col("beta")[i], 4).alias(f"b{i}") for i in range(4)])


@query("balance_before_after", _ROWS + _PLAIN + "," + _PICKED + _WITHIN + _by_score(_REACH)
       .rstrip() + _GAPS)
def balance_both(spark, sf):
    d, m = _matched(spark, sf, "glm_cal025")
    return balance_before_after(d, m, "win_key", X).select(
        "win_key", "covariate", "stage", "n_treat", "n_ctrl", F.round("smd", 6).alias("smd"),
        F.round("ecdf_max", 6).alias("ecdf_max"))


@query("control_reuse", LEVELS + """, r AS (SELECT *, row_number() OVER (PARTITION BY win_key,
    lulc, treat ORDER BY pixel_id) AS k FROM lv), m AS (SELECT b.lulc, b.pixel_id, count(*) AS k
    FROM r a JOIN r b ON a.win_key = b.win_key AND a.lulc = b.lulc AND a.k = b.k AND a.treat = 1
    AND b.treat = 0 GROUP BY ALL) SELECT lulc, CAST(sum(k) AS BIGINT) AS n_control_rows,
    count(*) AS n_control_pixels, max(k) AS max_reuse, round(sum(k) / count(*), 4)
    AS control_reuse FROM m GROUP BY lulc""")
def control_reuse(spark, sf):
    _d, m = _matched(spark, sf, "nn_exact_1to1")
    return M.control_reuse(m, ["lulc"])
