"""Group-time effects and their aggregates as cell means.

Both estimators have no covariates and compare with never-treated units, so a
fit is a table of cohort x year means. That table has (analysis cells x cohorts
x years) rows whatever the size of the panel; everything after the first
aggregation works on it. Standard errors need one more pass over the panel: a
row's residual times the coefficient its cell mean has in the target, summed
within its pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stats import Z975, two_sided_p
from panelspark.operators.core import exact_quantiles, null_safe_join, small_side
from panelspark.session import cut_lineage

G, T, Y = "gvar", "year", "y"


def cell_means(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and mean outcome per (cell, cohort, year); cohort 0 is the control.

    The table is written once here: effects read it four times, and without
    the copy each read would be another pass over the panel.
    """
    return small_side(panel.groupBy(*by, G, T).agg(
        F.count(F.lit(1)).alias("n"), F.avg(Y).alias("ybar")))


def group_time(means: DataFrame, by: Sequence[str], base: str = "varying",
               always_treated: str = "drop") -> DataFrame:
    """Effect of each cohort and year against its base year.

    ``varying``: the year before for years before treatment, the last untreated
    year after. ``fixed``: the last untreated year throughout. Cohorts without the last
    untreated year in the data (always treated) have no such effect and are absent;
    ``level`` gives them their level difference to the controls instead, without a base
    year.
    """
    by = list(by)
    treated = means.where(F.col(G) > 0).select(
        *by, G, T, F.col("n").alias("n_gt"), F.col("ybar").alias("y_gt"))
    last = F.col(G) - 1
    b = F.when(F.col(T) < F.col(G), F.col(T) - 1).otherwise(last) \
        if base == "varying" else last
    d = treated.withColumn("base_year", b.cast("int"))
    gb = means.where(F.col(G) > 0).select(
        *by, G, F.col(T).alias("base_year"), F.col("ybar").alias("y_gb"),
        F.col("n").alias("n_gb"))
    c = means.where(F.col(G) == 0)
    ct = c.select(*by, T, F.col("ybar").alias("y_0t"))
    cb = c.select(*by, F.col(T).alias("base_year"), F.col("ybar").alias("y_0b"))
    d = null_safe_join(null_safe_join(d, gb, [*by, G, "base_year"]), ct, [*by, T])
    d = null_safe_join(d, cb, [*by, "base_year"])
    if base == "fixed":
        d = d.where(F.col(T) != F.col("base_year"))
    out = d.select(
        *by, G, T, (F.col(T) - F.col(G)).alias("e"), "base_year", "n_gt", "n_gb",
        ((F.col("y_gt") - F.col("y_gb")) - (F.col("y_0t") - F.col("y_0b")))
        .alias("att"))
    if always_treated == "drop":
        return out
    if always_treated != "level":
        raise ValueError(f"no such reading: {always_treated}")
    dated = means.where(F.col(G) > 0).where(F.col(T) == last).select(
        *by, G, F.lit(True).alias("__dated"))
    never = null_safe_join(treated, dated, [*by, G], "left").where(F.col("__dated").isNull())
    return out.unionByName(null_safe_join(never, ct, [*by, T]).select(
        *by, G, T, (F.col(T) - F.col(G)).alias("e"), F.lit(None).cast("int").alias("base_year"),
        "n_gt", F.lit(None).cast("long").alias("n_gb"),
        (F.col("y_gt") - F.col("y_0t")).alias("att")))


def always_treated_levels(means: DataFrame, by: Sequence[str],
                          first_year: int) -> DataFrame:
    """Level difference of cohorts without a base year, labelled apart."""
    by = list(by)
    t = means.where((F.col(G) > 0) & (F.col(G) <= first_year))
    c = means.where(F.col(G) == 0).select(*by, T, F.col("ybar").alias("y0"))
    return null_safe_join(t, c, [*by, T]).select(
        *by, G, T, F.lit("level").alias("kind"),
        (F.col("ybar") - F.col("y0")).alias("level_difference"))


def target_weights(att: DataFrame, by: Sequence[str], kind: str,
                   weight: str = "n_gt") -> DataFrame:
    """Normalised weight of every effect in the targets of an aggregation.

    ``event`` by time since treatment, ``calendar`` by year after treatment,
    ``simple`` all effects after treatment.
    """
    by = list(by)
    if kind == "event":
        d = att.withColumn("time", F.col("e"))
    elif kind == "calendar":
        d = att.where(F.col("e") >= 0).withColumn("time", F.col(T))
    elif kind == "simple":
        d = att.where(F.col("e") >= 0).withColumn("time", F.lit(0))
    else:
        raise ValueError(kind)
    tot = d.groupBy(*by, "time").agg(F.sum(weight).alias("__w"))
    return null_safe_join(d, tot, [*by, "time"]).withColumn(
        "w", F.col(weight) / F.col("__w")).drop("__w")


def aggregate(weighted: DataFrame, by: Sequence[str],
              target: Sequence[str] = ("time",)) -> DataFrame:
    """Weighted mean effect per target, with the cohorts behind it."""
    return weighted.groupBy(*by, *target).agg(
        F.sum(F.col("w") * F.col("att")).alias("estimate"),
        F.count(F.lit(1)).alias("n_effects"),
        F.count_distinct(G).alias("n_cohorts"))


def overall_row(agg: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """Pooled row: mean of the post-treatment targets."""
    d = agg.where(F.col("time") >= 0) if kind == "event" else agg
    return d.groupBy(*by).agg(F.avg("estimate").alias("estimate"),
                              F.count(F.lit(1)).alias("n_targets"))


def _coefficients(weighted: DataFrame, by: Sequence[str],
                  target: Sequence[str]) -> DataFrame:
    """Coefficient of each cell mean in each target (four per effect, two without a base)."""
    w = F.col("w")
    def term(g: Column, t: str, c: Column) -> Column:
        return F.struct(g.cast("int").alias("g"), F.col(t).cast("int").alias("t"),
                        c.alias("c"))

    g, zero = F.col(G), F.lit(0)
    terms = F.array(term(g, T, w), term(g, "base_year", -w), term(zero, T, -w),
                    term(zero, "base_year", w))
    x = weighted.select(*by, *target, F.explode(terms).alias("k")).where("k.t IS NOT NULL")
    return x.groupBy(*by, *target, F.col("k.g").alias(G), F.col("k.t").alias(T)).agg(
        F.sum("k.c").alias("coef"))


def pair_scores(panel: DataFrame, means: DataFrame, weighted: DataFrame,
                by: Sequence[str], cluster: str = "pair_id",
                unit: str = "unit_id", random_weights: bool = False,
                target: Sequence[str] = ("time",)) -> DataFrame:
    """(cell, target, pair, score): what each pair adds to an estimate's error.

    The coefficient table is counted before it is broadcast. Partial sums are
    formed before the shuffle, so a pair with very many rows stays cheap. With
    ``random_weights`` the sampling of cohort sizes counts too.
    """
    by = list(by)
    n = means.select(*by, G, T, F.col("n").alias("__n"), "ybar")
    key = [*by, *target]
    coef = small_side(null_safe_join(_coefficients(weighted, by, target), n, [*by, G, T]))
    rows = panel.select(*by, G, T, Y, cluster, unit)
    s = null_safe_join(rows, coef, [*by, G, T]).groupBy(*key, cluster).agg(
        F.sum(F.col("coef") / F.col("__n") * (F.col(Y) - F.col("ybar")))
        .alias("score"))
    if not random_weights:
        return s
    est = aggregate(weighted, by, target).select(*key, F.col("estimate").alias("__th"))
    tot = weighted.groupBy(*key).agg(F.sum("n_gt").alias("__k"))
    part = small_side(null_safe_join(null_safe_join(weighted, est, key), tot, key).groupBy(
        *key, G).agg(F.sum(
            (F.col("att") - F.col("__th")) / F.col("__k")).alias("__wif")))
    who = panel.where(F.col(G) > 0).select(*by, G, cluster, unit).distinct()
    extra = null_safe_join(who, part, [*by, G]).select(*key, cluster, F.col("__wif").alias("score"))
    return s.unionByName(extra).groupBy(*key, cluster).agg(
        F.sum("score").alias("score"))


def clustered_se(scores: DataFrame, by: Sequence[str],
                 target: Sequence[str] = ("time",)) -> DataFrame:
    """Pair-clustered standard error per target, without small-sample factors."""
    return scores.groupBy(*by, *target).agg(
        F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("std_error"),
        F.count(F.lit(1)).alias("n_clusters"))


def _pm_one(cluster: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """+-1 per (cluster, draw): bits of a mixed integer of cluster and draw."""
    with np.errstate(over="ignore"):
        z = (cluster.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
             + np.arange(draws, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
             + np.uint64(seed))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return 1.0 - 2.0 * (z & np.uint64(1)).astype(np.float64)


def bootstrap_draws(scores: DataFrame, by: Sequence[str], draws: int, seed: int,
                    cluster: str = "pair_id") -> DataFrame:
    """(cell, target, draw, value): signed sums of the pair scores.

    Signs depend only on (pair, draw), so a pair has one sign in all targets
    and a recomputed task repeats itself. Each task adds up its share in one table of
    targets by draws, whose size the data do not change, and emits its rows.
    """
    keys = [*by, "time"]
    table = cut_lineage(scores.select(*keys).distinct().withColumn(
        "__n", F.monotonically_increasing_id()))
    order = {r[0]: i for i, r in enumerate(table.select("__n").collect())}  # one per target
    rows = null_safe_join(scores, small_side(table), keys)

    def partial(batches):
        acc = np.zeros((len(order), draws))
        for b in batches:
            code = np.array([order[n] for n in b.column(0).to_pylist()], np.int64)
            pair, val = b.column(1).to_numpy(), b.column(2).to_numpy()
            for at in range(0, len(code), 1024):
                part = slice(at, at + 1024)
                sign = _pm_one(pair[part], draws, seed)
                for k in np.unique(code[part]):
                    mine = code[part] == k
                    acc[k] += val[part][mine] @ sign[mine]
        on = np.flatnonzero(acc.any(axis=1))
        back = np.array(list(order), np.int64)
        for k in on:
            yield pa.record_batch({"__n": np.full(draws, back[k]), "part": acc[k],
                                   "draw": np.arange(draws, dtype=np.int32)})

    parts = rows.select("__n", F.col(cluster).cast("long"), "score").mapInArrow(
        partial, "__n long, part double, draw int").groupBy("__n", "draw").agg(
        F.sum("part").alias("value"))
    return table.join(parts, "__n").drop("__n")


def simultaneous_bands(draws: DataFrame, by: Sequence[str],
                       level: float = 0.95) -> DataFrame:
    """Spread per target from the draws, and the cell's critical value."""
    by = list(by)
    q = exact_quantiles(draws, [*by, "time"], "value", {"q75": .75, "q25": .25}, 1)
    width = 2 * 0.6744897501960817  # fixed value: normal interquartile range
    sig = q.select(*by, "time", ((F.col("q75") - F.col("q25")) / width)
                   .alias("std_error"))
    t = null_safe_join(draws, sig, [*by, "time"]).where(F.col("std_error") > 0).groupBy(
        *by, "draw").agg(F.max(F.abs(F.col("value") / F.col("std_error"))).alias("t"))
    crit = exact_quantiles(t, by, "t", {"crit_val": level}, 1)
    if not by:
        return sig.crossJoin(crit)  # one row
    return null_safe_join(sig, crit, by, "left")


def tidy(est: DataFrame, crit: Column | None = None) -> DataFrame:
    """Interval, statistic and two-sided p from estimate and standard error."""
    cv = F.lit(Z975) if crit is None else F.coalesce(crit, F.lit(Z975))
    se, b = F.col("std_error"), F.col("estimate")
    out = est.withColumn("crit_val", cv).withColumn(
        "conf_low", b - F.col("crit_val") * se).withColumn(
        "conf_high", b + F.col("crit_val") * se).withColumn(
        "statistic", F.when(se > 0, b / se))
    return out.withColumn("p_value", two_sided_p("statistic"))


POOLED = ("event", "calendar")  # aggregations with a pooled row


def _pooled_targets() -> Column:
    """Targets that the pooled row of their aggregation averages."""
    return (F.col("aggregation") == "calendar") | (
        (F.col("aggregation") == "event") & (F.col("time") >= 0))


def pooled_rows(est: DataFrame, scores: DataFrame, by: Sequence[str],
                cluster: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """Pooled row of each event and calendar aggregation, and its pair scores; time is null.

    The mean of the targets (event times from zero on, all calendar years). A mean of
    estimates has the mean of their scores, so its error needs no other pass.
    """
    cell = [*by, "aggregation"]
    part = est.where(_pooled_targets()).groupBy(*cell).agg(
        F.avg("estimate").alias("estimate"), F.count(F.lit(1)).alias("n_effects"))
    none = F.lit(None)
    rows = part.select(*cell, none.cast("int").alias("time"), "estimate", "n_effects",
                       none.cast("long").alias("n_cohorts"))
    s = null_safe_join(scores.where(_pooled_targets()),
                       part.select(*cell, F.col("n_effects").alias("__k")), cell)
    s = s.groupBy(*cell, cluster).agg(
        (F.sum("score") / F.first("__k")).alias("score")).withColumn("time", none.cast("int"))
    return rows, s


def estimate(panel: DataFrame, by: Sequence[str], estimator: str,
             kind: str | Sequence[str], cluster: str = "pair_id", draws: int = 0,
             seed: int = 1, pooled: bool = False, always_treated: str = "drop") -> DataFrame:
    """Targets of one estimator with clustered errors, every cell in one job.

    Several kinds share the cell means, one coefficient table and one pass for the
    pair scores. With ``draws`` the intervals are simultaneous over the targets of a
    cell and kind, from that many signed sums of the scores. ``pooled`` adds the mean
    over an aggregation's targets, with its error, as the row whose time is null.
    ``always_treated="level"`` lets cohorts treated in every year enter the calendar
    series of the fixed-base estimator by their level difference to the controls.
    """
    kinds = [kind] if isinstance(kind, str) else list(kind)
    by, target = list(by), ["aggregation", "time"]
    base = "varying" if estimator == "attgt" else "fixed"
    if always_treated != "drop" and base == "varying":
        raise ValueError("the varying-base estimator has no effect without a base year")
    means = cell_means(panel, by)
    att = group_time(means, by, base)
    level = group_time(means, by, base, always_treated) if always_treated != "drop" else att
    w = reduce(DataFrame.unionByName, [
        target_weights(level if k == "calendar" else att, by, k)
        .withColumn("aggregation", F.lit(k)) for k in kinds])
    s = pair_scores(panel, means, w, by, cluster, random_weights=estimator == "attgt",
                    target=target)
    if draws or pooled:
        s = cut_lineage(s)
    est, every = aggregate(w, by, target), s
    if pooled:
        rows, more = pooled_rows(est, s, by, cluster)
        est, every = est.unionByName(rows), s.unionByName(more)
    est = null_safe_join(est, clustered_se(every, by, target), [*by, *target], "left")
    crit = None
    if draws:
        cell = [*by, "aggregation"]
        bands = simultaneous_bands(bootstrap_draws(s, cell, draws, seed, cluster), cell)
        est = null_safe_join(est, bands.select(*cell, "time", F.col("crit_val").alias("__crit")),
                             [*cell, "time"], "left")
        crit = F.col("__crit")
    return tidy(est, crit).drop("__crit").withColumn("estimator", F.lit(estimator))


def pretrend_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Event times before treatment: how many, how many off zero, largest."""
    pre = rows.where(F.col("time") < 0)
    off = (F.col("conf_low") > 0) | (F.col("conf_high") < 0)
    return pre.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pre"),
        F.coalesce(F.sum(off.cast("long")), F.lit(0)).alias("n_pre_sig"),
        F.max(F.abs("estimate")).alias("max_abs_pre"))


def cell_status(panel: DataFrame, by: Sequence[str], min_treated: int,
                unit: str = "unit_id", expected: DataFrame | None = None) -> DataFrame:
    """ok or the reason a cell is skipped, from counts of its units.

    A cell all of whose cohorts lie after its last year has no viable cohort.

    ``expected`` lists the cells of the run grid; those without a row in the panel
    get their row here too.
    """
    t = F.col(G) > 0
    c = panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.when(t, F.col(unit))).alias("n_treated"),
        F.count_distinct(F.when(F.col(G) == 0, F.col(unit))).alias("n_never"),
        F.coalesce(F.min(F.when(t, F.col(G))) <= F.max(T), F.lit(True)).alias("__viable"))
    if expected is not None:
        c = null_safe_join(expected.select(*by).distinct(), c, list(by), "left").fillna(
            0, ["n_rows", "n_treated", "n_never"])
    reason = (F.when(F.col("n_rows") == 0, "no_rows")
              .when(F.col("n_treated") == 0, "no_treated")
              .when(~F.col("__viable"), "no_viable_cohort")
              .when(F.col("n_never") == 0, "no_never")
              .when(F.col("n_treated") < min_treated, "below_floor"))
    return c.withColumn("status", F.when(reason.isNull(), "ok").otherwise("skipped")
                        ).withColumn("reason", reason).drop("__viable")
