"""Covariate balance, pooled moments, and ranking of matching configurations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.core import finite, null_safe_join, ordered_cumulative


def long_covariates(df: DataFrame, by: Sequence[str],
                    covariates: Sequence[str]) -> DataFrame:
    """(by, treat, covariate, value), rows multiplied by the covariates."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in covariates)
    return df.selectExpr(
        *by, "treat",
        f"stack({len(covariates)}, {pairs}) AS (covariate, value)").where(
        finite(F.col("value")))


def moments(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, means and deviations of both sides per covariate."""
    t, v = F.col("treat") == 1, F.col("value")

    def side(c: Column, s: str) -> list[Column]:
        x = F.when(c, v)
        return [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"mean_{s}"),
                F.stddev_samp(x).alias(f"sd_{s}")]

    return long.groupBy(*by, "covariate").agg(*side(t, "treat"), *side(~t, "ctrl"))


def ecdf_distance(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and largest gap of the two empirical distributions.

    The grid is every distinct value of either side, unweighted. Running counts
    are exact for samples of any size.
    """
    keys = [*by, "covariate"]
    c = ordered_cumulative(long, keys, "value", {
        "t": (F.col("treat") == 1).cast("long"),
        "c": (F.col("treat") == 0).cast("long")})
    gap = F.abs((F.col("t_before") + F.col("t")) / F.col("t_all")
                - (F.col("c_before") + F.col("c")) / F.col("c_all"))
    return c.where((F.col("t_all") > 0) & (F.col("c_all") > 0)).groupBy(*keys).agg(
        F.avg(gap).alias("ecdf_mean"), F.max(gap).alias("ecdf_max"))


def balance_table(df: DataFrame, by: Sequence[str], covariates: Sequence[str],
                  stage: str, denominators: DataFrame | None = None) -> DataFrame:
    """Standardised difference, variance ratio and distribution gaps.

    ``denominators`` (by, covariate, denom) carries the unadjusted treated
    deviation to the adjusted stage, so both stages share one scale.
    """
    by = list(by)
    keys = [*by, "covariate"]
    long = long_covariates(df, by, covariates)
    m = null_safe_join(moments(long, by), ecdf_distance(long, by), keys, "left")
    if denominators is None:
        m = m.withColumn("denom", F.col("sd_treat"))
    else:
        m = null_safe_join(m, denominators, keys, "left")
    vt, vc = F.col("sd_treat") ** 2, F.col("sd_ctrl") ** 2
    return m.select(
        *keys, F.lit(stage).alias("stage"), "n_treat", "n_ctrl", "mean_treat",
        "mean_ctrl", "sd_treat", "sd_ctrl",
        F.when(F.col("denom") > 0, (F.col("mean_treat") - F.col("mean_ctrl"))
               / F.col("denom")).alias("smd"),
        F.when(vc > 0, vt / vc).alias("vr"), "ecdf_mean", "ecdf_max")


def pool_moments(df: DataFrame, by: Sequence[str], n: str, mean: str, sd: str,
                 out: str) -> DataFrame:
    """Exact mean and deviation over levels from their summaries.

    The between-level spread is taken about the pooled mean, in two passes over
    the level table.
    """
    by = list(by)
    ok = (F.col(n) > 0) & F.col(mean).isNotNull()
    d = df.where(ok).select(*by, F.col(n).cast("double").alias("n"),
                            F.col(mean).alias("m"),
                            F.coalesce(F.col(sd), F.lit(0.0)).alias("s"))
    mu = d.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"),
                            F.sum("n").alias("big_n"))
    j = null_safe_join(d, mu, by)
    ss = F.sum((F.col("n") - 1) * F.col("s") ** 2
               + F.col("n") * (F.col("m") - F.col("mu")) ** 2)
    big = F.max("big_n")
    return j.groupBy(*by).agg(
        big.alias(f"n_{out}"), F.max("mu").alias(f"mean_{out}"),
        F.when(big > 1, F.sqrt(ss / (big - 1))).alias(f"sd_{out}"))


def weighted_mean(x: Column, w: Column) -> Column:
    ok = x.isNotNull() & ~F.isnan(x) & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def pool_balance(bal: DataFrame, by: Sequence[str]) -> DataFrame:
    """Balance rows pooled over levels, with the worst level named."""
    by = list(by)
    t = pool_moments(bal, by, "n_treat", "mean_treat", "sd_treat", "treat")
    c = pool_moments(bal, by, "n_ctrl", "mean_ctrl", "sd_ctrl", "ctrl")
    w = F.col("n_treat").cast("double")
    s = bal.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_levels"),
        weighted_mean(F.col("ecdf_mean"), w).alias("ecdf_mean_wavg"),
        weighted_mean(F.col("ecdf_max"), w).alias("ecdf_max_wavg"),
        F.max("ecdf_max").alias("ecdf_max_worst"),
        F.max_by("win_key", F.struct("ecdf_max", "win_key")).alias("worst_level"),
        F.max_by("n_treat", F.struct("ecdf_max", "win_key"))
        .alias("worst_level_pairs"))
    return null_safe_join(null_safe_join(s, t, by, "left"), c, by, "left")


def covariate_summary(bal: DataFrame, keys: Sequence[str] = ("pairing", "arm"),
                      ) -> DataFrame:
    """Pooled balance before and after, on the pooled unadjusted scale."""
    keys = list(keys)
    un = (bal.where("stage = 'unadjusted'").drop("config")
          .dropDuplicates([*keys, "win_key", "covariate"]))
    ad = bal.where("stage = 'adjusted'")
    pu = pool_balance(un, [*keys, "covariate"])
    pa = pool_balance(ad, [*keys, "config", "covariate"])
    denom = pu.select(*keys, "covariate", F.col("sd_treat").alias("denom"))

    def finish(d: DataFrame, stage: str) -> DataFrame:
        j = d.join(denom, [*keys, "covariate"], "left")
        return j.withColumn("stage", F.lit(stage)).withColumn(
            "smd", F.when(F.col("denom") > 0, (
                F.col("mean_treat") - F.col("mean_ctrl")) / F.col("denom"))
        ).withColumn("vr", F.when(F.col("sd_ctrl") > 0, (
            F.col("sd_treat") / F.col("sd_ctrl")) ** 2)).drop("denom")

    return finish(pu, "unadjusted").withColumn("config", F.lit("(before)")).unionByName(
        finish(pa, "adjusted"))


def level_ledger(specs: DataFrame, keys: Sequence[str] = ("pairing", "arm"),
                 ) -> DataFrame:
    """One row per level: its treated and control counts and runs."""
    return specs.groupBy(*keys, "win_key").agg(
        F.min("cohort_year").alias("cohort_year"),
        F.max("n_treat").alias("n_treat_level"),
        F.max("n_control").alias("n_ctrl_level"),
        F.count_distinct("config").alias("n_configs_run"),
        F.count_distinct("n_treat").alias("n_distinct_treat"))


def coverage(specs: DataFrame, keys: Sequence[str] = ("pairing", "arm"),
             ) -> DataFrame:
    """Levels done, failed and absent per configuration, fixed denominator."""
    keys = list(keys)
    den = level_ledger(specs, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_levels_total"),
        F.sum("n_treat_level").alias("n_treat_matchable"),
        F.sum((F.col("n_treat_level") <= 2).cast("long"))
        .alias("n_levels_singleton"))
    ok = F.col("status") == "ok"
    kind = F.when(~ok, F.regexp_replace("status", r"^failed:\s*", ""))
    c = specs.groupBy(*keys, "config").agg(
        F.sum(ok.cast("long")).alias("n_levels_ok"),
        F.sum((~ok).cast("long")).alias("n_levels_failed"),
        F.coalesce(F.sum(F.when(~ok, F.col("n_treat"))), F.lit(0))
        .alias("n_treat_failed"),
        F.array_join(F.array_sort(F.collect_set(kind)), " | ").alias("fail_reasons"),
        (F.sum(F.when(ok, F.col("n_matched"))) / 2).alias("n_matched_pairs"))
    j = c.join(den, keys)
    absent = F.col("n_levels_total") - F.col("n_levels_ok") - F.col("n_levels_failed")
    return j.withColumn("n_levels_absent", absent).withColumn(
        "run_complete", absent == 0).withColumn(
        "match_rate", F.when(F.col("n_treat_matchable") > 0,
                             F.coalesce("n_matched_pairs", F.lit(0.0))
                             / F.col("n_treat_matchable")))


def rank_configs(cov: DataFrame, summary: DataFrame, gate: Mapping,
                 keys: Sequence[str] = ("pairing", "arm")) -> DataFrame:
    """Gate on retention, decide on balance; rank, suggestion, trade flag.

    The result is advice: choosing stays with the caller. Each (pairing, arm)
    holds one row per configuration.
    """
    keys = list(keys)
    a = F.abs("smd")
    b = summary.where("stage = 'adjusted'").groupBy(*keys, "config").agg(
        F.count(F.lit(1)).alias("n_cov"), F.max(a).alias("max_abs_smd"),
        F.avg(a).alias("mean_abs_smd"),
        F.coalesce(F.sum((a > gate["smd_max"]).cast("long")), F.lit(0))
        .alias("n_smd_over"),
        F.min("vr").alias("vr_min"), F.max("vr").alias("vr_max"),
        F.coalesce(F.sum(((F.col("vr") < gate["vr_low"])
                          | (F.col("vr") > gate["vr_high"])).cast("long")),
                   F.lit(0)).alias("n_vr_outside"),
        F.max("ecdf_max_worst").alias("ecdf_max_worst"))
    d = cov.where("run_complete").join(b, [*keys, "config"], "left")
    whole = Window.partitionBy(*keys)
    ceil = F.max(F.when(F.col("config") == gate["ceiling_config"],
                        F.col("match_rate"))).over(whole)
    d = d.withColumn("ceiling_rate", F.coalesce(ceil, F.max("match_rate").over(whole)))
    d = d.withColumn("retention_ratio", F.when(
        F.col("ceiling_rate") > 0, F.col("match_rate") / F.col("ceiling_rate")))
    meets = F.coalesce(F.col("retention_ratio") >= gate["retention_min"], F.lit(False))
    passes = F.coalesce((F.col("n_smd_over") == 0) & (F.col("n_vr_outside") == 0),
                        F.lit(False))
    d = (d.withColumn("meets_floor", meets).withColumn("passes_balance", passes)
         .withColumn("eligible", meets & passes))
    order = Window.partitionBy(*keys).orderBy(
        F.col("eligible").desc(), F.col("meets_floor").desc(),
        F.when(F.col("eligible"), F.col("mean_abs_smd"))
        .otherwise(F.col("max_abs_smd")).asc_nulls_last(), "config")
    d = d.withColumn("rank", F.row_number().over(order))
    best = F.max(F.when(F.col("eligible"), F.struct(
        "retention_ratio", "config", "mean_abs_smd"))).over(whole)
    d = d.withColumn("__alt", best).withColumn("suggested", F.col("rank") == 1)
    pick = F.col("suggested") & F.col("eligible")
    d = d.withColumn("retention_cost", F.when(
        pick, F.col("__alt.retention_ratio") - F.col("retention_ratio")))
    d = d.withColumn("balance_gain", F.when(
        pick, F.col("__alt.mean_abs_smd") - F.col("mean_abs_smd")))
    return d.withColumn("alt_config", F.col("__alt.config")).withColumn(
        "trade_flag", F.coalesce((F.col("retention_cost") > 0.02)
                                 & (F.col("balance_gain") < 0.005),
                                 F.lit(False))).drop("__alt")


def shared_covariates(summary: DataFrame) -> DataFrame:
    """Arms compared on the covariates all arms have."""
    ad = summary.where("stage = 'adjusted'")
    arms = ad.agg(F.count_distinct("arm").alias("__k"))
    per = ad.groupBy("covariate").agg(F.count_distinct("arm").alias("__a"))
    flag = per.crossJoin(arms).select(  # one row on the right
        "covariate", (F.col("__a") == F.col("__k")).alias("__shared"))
    j = ad.join(flag, "covariate")
    a, sh = F.abs("smd"), F.col("__shared")
    return j.groupBy("pairing", "arm", "config").agg(
        F.max(F.when(sh, a)).alias("max_smd_shared"),
        F.avg(F.when(sh, a)).alias("mean_smd_shared"),
        F.max(F.when(~sh, a)).alias("max_smd_added"),
        F.array_join(F.array_sort(F.collect_set(F.when(~sh, F.col("covariate")))),
                     ", ").alias("added_cov"))


def feasibility(df: DataFrame, pairing: Sequence[str],
                cell: Sequence[str]) -> DataFrame:
    """Largest number of one-to-one pairs the exact cells allow."""
    whole = F.lit(True)
    for c in cell:
        whole = whole & F.col(c).isNotNull()
    t = (F.col("treat") == 1).cast("long")
    n = df.where(whole).groupBy(*pairing, *cell).agg(
        F.sum(t).alias("nt"), F.sum(1 - t).alias("nc"))
    mp = F.sum(F.least("nt", "nc"))
    nt, nc = F.sum("nt"), F.sum("nc")
    return n.groupBy(*pairing).agg(
        nt.alias("n_treat"), nc.alias("n_control"),
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(((F.col("nt") > 0) & (F.col("nc") > 0)).cast("long"))
        .alias("cells_with_both"), mp.alias("max_pairs"),
        F.round(100.0 * mp / F.greatest(nt, F.lit(1)), 1)
        .alias("pct_treat_matchable"),
        F.when(nc < nt, "control").otherwise("treatment").alias("binding_side"))
