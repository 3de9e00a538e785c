"""Event-time support, caps on result windows, and result rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import back_transform, lookup
from panelspark.operators.core import (null_safe_join, ordered_cumulative, require,
                                       registry, small_side)


def event_support(units: DataFrame, by: Sequence[str], windows: DataFrame,
                  low: int, high: int, gvar: str = "gvar") -> DataFrame:
    """Units and cohorts inside the outcome window at each event time.

    Treated units are counted per cohort first; event times then multiply
    cohort rows, not units. Every cell has a row for every event time.
    ``windows`` has the keys it shares with ``by`` plus outcome, year_first and
    year_last.
    """
    by = list(by)
    shared = [c for c in by if c in windows.columns]
    extra = [c for c in windows.columns if c not in shared]
    coh = units.where(F.col(gvar) > 0).groupBy(*by, gvar).agg(
        F.count(F.lit(1)).alias("__n"))
    if shared:
        d = coh.join(windows, shared)
    else:
        d = coh.join(small_side(windows, 10_000), F.lit(True))
    d = d.withColumn("event_time", F.explode(F.sequence(F.lit(low), F.lit(high))))
    ok = (F.col(gvar) + F.col("event_time")).between(
        F.col("year_first"), F.col("year_last"))
    out = d.groupBy(*by, *extra, "event_time").agg(
        F.sum("__n").alias("n_treated"),
        F.coalesce(F.sum(F.when(ok, F.col("__n"))), F.lit(0)).alias("n_units"),
        F.count(F.when(ok, F.lit(1))).alias("n_cohorts"),
        F.min(F.when(ok, F.col(gvar))).alias("cohort_first"),
        F.max(F.when(ok, F.col(gvar))).alias("cohort_last"))
    return retention(out, [*by, *extra])


def retention(sup: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Directional running maximum, share and retention. Cells hold one row
    per event time, so the windows are short."""
    e, n = F.col("event_time"), F.col("n_units")
    up = Window.partitionBy(*cell, e >= 0).orderBy(e).rowsBetween(
        Window.unboundedPreceding, 0)
    down = Window.partitionBy(*cell, e >= 0).orderBy(e.desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*cell)
    d = sup.withColumn("n_units_den", F.when(e >= 0, F.max(n).over(up))
                       .otherwise(F.max(n).over(down)))
    d = d.withColumn("n_units_0", F.max(F.when(e == 0, n)).over(whole))
    d = d.withColumn("n_units_ref", F.max(n).over(whole))
    d = d.withColumn("e_ref", F.min(F.when(n == F.col("n_units_ref"), e)).over(whole))
    return d.withColumn("share_units", F.round(n / F.col("n_treated"), 4)).withColumn(
        "share_at_0", F.round(F.col("n_units_0") / F.col("n_treated"), 4)).withColumn(
        "retention", F.when(F.col("n_units_den") > 0,
                            F.round(n / F.col("n_units_den"), 4)))


def half_life(sup: DataFrame, cell: Sequence[str]) -> DataFrame:
    """First event time after treatment with retention below one half."""
    e = F.col("event_time")
    post = sup.where(e >= 0)
    return post.groupBy(*cell).agg(
        F.max("n_treated").alias("n_treated"), F.max("share_at_0").alias("share_at_0"),
        F.coalesce(F.min(F.when(F.col("retention") < 0.5, e)), F.max(e))
        .alias("half_gone_at"))


def support_caps(rows: DataFrame, cell: Sequence[str], n_min: int,
                 cohorts_min: int | Column, retention_min: float | Column,
                 width_reference: int = 5,
                 width_factor: float | Column = 2.0) -> DataFrame:
    """Window of each cell: the run of event times from treatment outward in
    which units, cohorts and retention all hold. It never reopens.

    ``rows`` has one row per (cell, event_time) with the support columns and
    ci_width. The same run with interval width in place of retention is the
    sensitivity cap; e = 0 is exempt from it. Cells are short, and every step
    is an aggregate or a window over one cell.
    """
    cell = list(cell)
    e = F.col("event_time")
    ref = rows.where(e.between(0, width_reference) & F.col("ci_width").isNotNull()).groupBy(
        *cell).agg(F.median("ci_width").alias("ci_ref"))
    d = null_safe_join(rows, ref, cell, "left")
    f = F.lit(False)
    ok_n = F.col("n_units") >= n_min
    ok_k = F.col("n_cohorts") >= cohorts_min
    ok_r = F.coalesce(F.col("retention") >= retention_min, f)
    wide = F.col("ci_ref").isNull() | (F.col("ci_ref") <= 0)
    ok_c = (F.when(e == 0, True).when(wide, True)
            .otherwise(F.coalesce(F.col("ci_width") <= F.lit(width_factor)
                                  * F.col("ci_ref"), f)))
    d = (d.withColumn("ok_n", ok_n).withColumn("ok_k", ok_k)
         .withColumn("ok_r", ok_r).withColumn("ok_c", ok_c))
    # previous observed event time, so a cap is always an observed one
    wf = Window.partitionBy(*cell, e >= 0).orderBy(e)
    wb = Window.partitionBy(*cell, e >= 0).orderBy(e.desc())
    d = d.withColumn("__prev", F.lag(e).over(wf)).withColumn(
        "__next", F.lag(e).over(wb))
    gate = F.col("ok_n") & F.col("ok_k") & F.col("ok_r")
    sens = F.col("ok_n") & F.col("ok_k") & F.col("ok_c")
    post, pre = e >= 0, e < 0

    def first_fail(ok: Column, names: Sequence[tuple[str, str]]) -> Column:
        label = F.array_join(F.filter(F.array(*[
            F.when(~F.col(c), F.lit(n)) for n, c in names]),
            lambda x: x.isNotNull()), "+")
        return F.min(F.when(post & ~ok, F.struct(
            e.alias("e"), F.col("__prev").alias("cap"), label.alias("bind"))))

    gn = [("n_units", "ok_n"), ("n_cohorts", "ok_k"), ("retention", "ok_r")]
    sn = [("n_units", "ok_n"), ("n_cohorts", "ok_k"), ("ci_width", "ok_c")]
    a = d.groupBy(*cell).agg(
        first_fail(gate, gn).alias("g"), first_fail(sens, sn).alias("s"),
        F.max(F.when(post, e)).alias("__last"),
        F.min(F.when(pre, e)).alias("__first"),
        F.max(F.when(pre & ~gate, F.struct(e.alias("e"), F.col("__next").alias("cap"))))
        .alias("p"), F.max("ci_ref").alias("ci_ref"))

    def cap(s: str) -> Column:
        return F.when(F.col(s).isNull(), F.col("__last")).otherwise(F.col(f"{s}.cap"))

    def bind(s: str) -> Column:
        return (F.when(F.col(s).isNull() & F.col("__last").isNotNull(), "end_of_data")
                .when(F.col(f"{s}.cap").isNotNull(), F.col(f"{s}.bind")))

    return a.select(
        *cell, cap("g").alias("cap"), bind("g").alias("bind"),
        F.when(F.col("p").isNull(), F.col("__first")).otherwise(F.col("p.cap"))
        .alias("cap_lo"),
        cap("s").alias("cap_ci"), bind("s").alias("bind_ci"),
        F.round("ci_ref", 4).alias("ci_ref"))


def shared_caps(caps: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One window per cell over its estimators: the smaller cap on each side."""
    w = Window.partitionBy(*cell)
    return (caps.withColumn("cap_use", F.min("cap").over(w))
            .withColumn("cap_lo_use", F.max("cap_lo").over(w))
            .withColumn("cap_ci_use", F.min("cap_ci").over(w)))


def cap_sweep(rows: DataFrame, cell: Sequence[str], floor: str,
              values: Sequence[float], n_min: int, cohorts_min: int,
              retention_min: float, width_factor: float = 2.0) -> DataFrame:
    """Caps under each value of one floor, all values in one job."""
    grid = registry(rows.sparkSession, ["setting"], [(float(v),) for v in values])
    d = rows.crossJoin(grid)
    s = F.col("setting")
    return support_caps(
        d, [*cell, "setting"], n_min,
        s if floor == "cohorts" else cohorts_min,
        s if floor == "retention" else retention_min,
        width_factor=s if floor == "width" else width_factor)


def sweep_summary(sweep: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Cells, capped cells and range of the caps per setting."""
    return sweep.groupBy("setting", *by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(value).alias("n_capped"),
        F.min(value).alias("cap_min"), F.median(value).alias("cap_med"),
        F.max(value).alias("cap_max"),
        F.sum(F.coalesce(F.col("bind").contains("n_cohorts"), F.lit(False))
              .cast("long")).alias("n_bind_cohorts"))


def finish_results(est: DataFrame, manifest: DataFrame,
                   columns: Sequence[str], arms: Mapping[str, str]) -> DataFrame:
    """Estimates with arm, manifest context, back-transform and error ratio."""
    from panelspark.operators.lookups import prefixed_join

    d = est.withColumn("arm", lookup(F.col("pairing"), dict(arms)))
    d = prefixed_join(d, manifest, ["estimator", "run_id"], columns, "match_")
    tf = F.col("transform")
    d = d.withColumn("scale", F.when(tf == "log1p", "proportion").otherwise("native"))
    for c in ("estimate", "conf_low", "conf_high"):
        d = d.withColumn(f"{c}_bt", back_transform(F.col(c), tf))
    return se_ratio(d, ["estimator", "run_id", "aggregation"])


def se_ratio(d: DataFrame, run: Sequence[str]) -> DataFrame:
    """Error relative to the row before it in the run; runs are short."""
    w = Window.partitionBy(*run).orderBy(F.col("time").asc_nulls_last())
    prev = F.lag("std_error").over(w)
    ok = (prev > 0) & (F.col("time_type") != "overall")
    return d.withColumn("se_ratio_prev", F.when(ok, F.col("std_error") / prev))


def collapse_flags(d: DataFrame, floor: float = 0.5) -> DataFrame:
    """Rows whose error falls below half of the one before."""
    return d.where(F.col("se_ratio_prev") < floor)


def figure_rows(results: DataFrame, spec: DataFrame, wanted: DataFrame,
                zones: Sequence[str]) -> DataFrame:
    """Rows each figure draws, one per estimate, with the figures listed.

    ``spec``: figure, estimator, pairing, aggregation, ecoregions (statewide,
    eco, all), strata (stratified, pooled). ``wanted``: outcome, block,
    fig_transform. Both are registries.
    """
    j = results.join(spec, ["estimator", "pairing", "aggregation"]).join(
        wanted, "outcome")
    z = F.col("ecoregion")
    known = z.isin(list(zones)) if zones else F.lit(False)
    zone_ok = (F.when(F.col("ecoregions") == "statewide", z == "")
               .when(F.col("ecoregions") == "eco", known)
               .otherwise((z == "") | known))
    strat_ok = F.when(F.col("strata") == "stratified", F.col("stratum") != "") \
        .otherwise(F.col("stratum") == "")
    j = j.where(zone_ok & strat_ok)
    keys = ["estimator", "pairing", "outcome", "transform", "stratum",
            "ecoregion", "aggregation", "time"]
    rest = [c for c in results.columns if c not in keys] + ["block", "fig_transform"]
    out = j.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("figure")), "; ").alias("figures"),
        *[F.min(c).alias(c) for c in rest])
    return display_scale(out)


def display_scale(d: DataFrame) -> DataFrame:
    """Percent for log rows, native for the others; width on that scale."""
    log = F.col("transform") == "log1p"
    for name, base in (("value", "estimate"), ("lo", "conf_low"), ("hi", "conf_high")):
        d = d.withColumn(name, F.when(log, F.col(f"{base}_bt") * 100)
                         .otherwise(F.col(base)))
    d = d.withColumn("unit", F.when(log, "percent").when(
        F.col("block") == "stock", "gC m-2").otherwise("gC m-2 yr-1"))
    drawn = ((F.col("transform") == F.col("fig_transform"))
             & F.col("value").isNotNull() & F.col("lo").isNotNull()
             & F.col("hi").isNotNull())
    return d.withColumn("fig_row", F.coalesce(drawn, F.lit(False))).withColumn(
        "ci_width", F.col("hi") - F.col("lo"))


def apply_windows(rows: DataFrame, caps: DataFrame, cell: Sequence[str],
                  calendar: DataFrame, pretrend_floor: int) -> DataFrame:
    """Keep rows inside their window: calendar bounds, or event caps.

    A cell without supported time before treatment starts at zero.
    """
    lim = caps.groupBy(*cell).agg(F.min("cap_use").alias("cap_use"),
                                  F.max("cap_lo_use").alias("cap_lo_use"))
    j = rows.join(lim, list(cell), "left").join(calendar, "outcome", "left")
    lo = F.when(F.col("cap_lo_use").isNull(), 0).otherwise(
        F.greatest("cap_lo_use", F.lit(pretrend_floor)))
    t = F.col("time")
    keep = F.when(F.col("aggregation") == "calendar",
                  t.between(F.col("cal_lo"), F.col("cal_hi"))).otherwise(
        F.col("cap_use").isNotNull() & (t >= lo) & (t <= F.col("cap_use")))
    return j.where(F.coalesce(keep, F.lit(False)))


def window_diff(auto: DataFrame, used: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Cells whose applied window differs from the rule, or is missing."""
    a = auto.groupBy(*cell).agg(F.min("cap_use").alias("cap_auto"))
    u = used.groupBy(*cell).agg(F.min("cap_use").alias("cap_used"))
    j = a.join(u, list(cell), "left")
    both = F.col("cap_auto").isNotNull() & F.col("cap_used").isNotNull()
    return j.withColumn("state", F.when(
        both & (F.col("cap_auto") != F.col("cap_used")), "changed").when(
        F.col("cap_auto").isNotNull() & F.col("cap_used").isNull(), "unlisted")
        .otherwise("same"))


def wide_by(df: DataFrame, keys: Sequence[str], column: str,
            levels: Sequence[str], value: str) -> DataFrame:
    """Long to wide over known levels; the job fails on a level that is not among them."""
    known = F.col(column).isNull() | ~F.col(column).isin(list(levels))
    df = require(df, known, f"a level of {column} is not in the list")
    return df.groupBy(*keys).pivot(column, list(levels)).agg(F.min(value))


def number_runs(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers, one row each, for groups of any size.

    The island of a number is the number less its position among the distinct
    numbers, and positions come from bucketed running counts.
    """
    keys = list(keys)
    c = ordered_cumulative(df.select(*keys, number).distinct(), keys, number,
                           {"__one": F.lit(1)}, True)
    return c.withColumn("__i", F.col(number) - F.col("__one_before")).groupBy(*keys, "__i").agg(
        F.min(number).alias("run_first"), F.max(number).alias("run_last"),
        F.count(F.lit(1)).alias("n")).drop("__i")


def number_ranges(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of a report as text such as ``1-3,7``; meant for short lists."""
    a, b = F.col("run_first"), F.col("run_last")
    text = F.when(a == b, a.cast("string")).otherwise(
        F.concat_ws("-", a.cast("string"), b.cast("string")))
    rows = F.array_sort(F.collect_list(F.struct(a.alias("a"), text.alias("t"))))
    return runs.groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda r: r["t"]), ",").alias("ranges"),
        F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_numbers"))


def completeness_by(expected: DataFrame, done: DataFrame, keys: Sequence[str],
                    by: Sequence[str]) -> DataFrame:
    """Done, missing and percent done of the expected runs per group."""
    d = done.select(*keys).distinct().withColumn("__d", F.lit(1))
    j = expected.join(d, list(keys), "left")
    n, k = F.count(F.lit(1)), F.count("__d")
    return j.groupBy(*by).agg(n.alias("n_runs"), k.alias("n_done"),
                              (n - k).alias("n_missing"),
                              F.round(100.0 * k / n, 2).alias("pct_done"))


def run_state(expected: DataFrame, results: DataFrame,
              keys: Sequence[str]) -> DataFrame:
    """State of every expected run: done, skipped or error with its reason."""
    r = results.groupBy(*keys).agg(
        F.sum(F.col("estimate").isNotNull().cast("long")).alias("n_estimates"),
        F.max("status").alias("status"), F.max("message").alias("message"))
    j = expected.join(r, list(keys), "left")
    state = (F.when(F.col("n_estimates") > 0, "done")
             .when(F.col("status") == "skipped", "skipped")
             .when(F.col("status") == "error", "error").otherwise("missing"))
    return j.withColumn("state", state)
