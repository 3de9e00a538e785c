"""Detections against recorded events: windows, lags, thresholds, tests.

Detections are first reduced to one row per (cell, year); a cell then carries
its short history (at most one entry per year) to its events in one equi-join,
and windows and lags are expressions over that history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import seeded_order
from panelspark.functions.stats import binomial_greater_p
from panelspark.operators.core import (exact_quantiles, null_safe_join,
                                       ordered_cumulative, pct, registry)


def detection_history(det: DataFrame) -> DataFrame:
    """(pixel_id, history): one struct per detected year."""
    yearly = det.groupBy("pixel_id", "year").agg(
        F.max("treefrac_loss").alias("tf"), F.max("agb_loss").alias("ab"))
    return yearly.groupBy("pixel_id").agg(
        F.collect_list(F.struct("year", "tf", "ab")).alias("history"))


def within(history: Column, year: Column, low: int, high: int) -> Column:
    """History entries whose lag from the event lies in [low, high]."""
    return F.filter(history, lambda d: (d["year"] - year).between(low, high))


def attach_loss(events: DataFrame, history: DataFrame, low: int, high: int,
                year: str = "event_year") -> DataFrame:
    """Largest loss inside the window; no detection is a loss of zero."""
    j = events.join(history, "pixel_id", "left")
    hit = within(F.col("history"), F.col(year), low, high)
    tf = F.array_max(F.transform(hit, lambda d: d["tf"]))
    ab = F.array_max(F.transform(hit, lambda d: d["ab"]))
    return (j.withColumn("treefrac_loss",
                         F.greatest(F.coalesce(tf, F.lit(0.0)), F.lit(0.0)))
            .withColumn("agb_loss", ab).drop("history"))


def detected_near(events: DataFrame, history: DataFrame, window: Column,
                  year: str = "event_year") -> DataFrame:
    """Interval join: a detection within +-window years, and the cell's total."""
    j = events.join(history, "pixel_id", "left")
    near = F.exists("history", lambda d: F.abs(d["year"] - F.col(year)) <= window)
    return (j.withColumn("detect_at_event", F.coalesce(near, F.lit(False)))
            .withColumn("n_detect", F.coalesce(F.size("history"), F.lit(0)))
            .drop("history"))


def coverage(det: DataFrame, w: int) -> DataFrame:
    """Years each detection covers, without repeats."""
    yearly = det.select("pixel_id", "year").distinct()
    return yearly.select("pixel_id", F.explode(F.sequence(
        F.col("year") - w, F.col("year") + w)).alias("year")).distinct()


def two_part_summary(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Detection rate, and loss quantiles over all and over detected events."""
    by = list(by)
    base = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("detected").cast("long")).alias("n_detected"),
        F.avg("treefrac_loss").alias("__mean"))
    on = F.coalesce(F.col("detected"), F.lit(False))
    lossq = exact_quantiles(events, by, "treefrac_loss", {
        "loss_p95": .95, "loss_p99": .99, "det_loss_p25": (.25, on),
        "det_loss_p50": (.5, on), "det_loss_p75": (.75, on)})
    agb = exact_quantiles(events.where("detected"), by, "agb_loss", {"det_agb_p50": .5})
    out = base
    for q in (lossq, agb):
        out = null_safe_join(out, q, by, "left")
    return out.select(
        *by, "n_events", "n_detected",
        F.round(100.0 * F.col("n_detected") / F.col("n_events"), 2)
        .alias("detect_rate"),
        F.round("__mean", 5).alias("loss_mean"),
        *[F.round(c, 4).alias(c) for c in (
            "loss_p95", "loss_p99", "det_loss_p25", "det_loss_p50",
            "det_loss_p75")],
        F.round("det_agb_p50", 3).alias("det_agb_p50"))


def monotonicity(summary: DataFrame, group: str, level: str,
                 values: Sequence[str], min_n: int = 0) -> DataFrame:
    """Whether each value rises strictly along the ordered levels of a group.

    One level alone is not monotone; a null difference leaves the test unknown.
    """
    w = Window.partitionBy(group).orderBy(level)
    d = summary.where(F.col("n_events") >= min_n)
    for v in values:
        d = d.withColumn(f"__up_{v}", F.when(
            F.row_number().over(w) == 1, F.lit(True))
            .otherwise(F.col(v) > F.lag(v).over(w)))
    n = F.count(F.lit(1))
    aggs = []
    for v in values:
        up = F.col(f"__up_{v}")
        any_false = F.max((~F.coalesce(up, F.lit(True))).cast("int")) == 1
        any_null = F.max(up.isNull().cast("int")) == 1
        aggs.append(F.when(n <= 1, False).when(any_false, False)
                    .when(any_null, None).otherwise(True).alias(f"{v}_monotone"))
    return d.groupBy(group).agg(n.alias("n_levels"), *aggs)


def lag_sweep(events: DataFrame, history: DataFrame, by: Sequence[str],
              lags: Sequence[int], threshold: float) -> DataFrame:
    """Detection rate at every lag: one join, one aggregation."""
    j = events.join(history, "pixel_id", "left")

    def hit(lag: int) -> Column:
        return F.coalesce(F.exists("history", lambda d: (
            (d["year"] == F.col("event_year") + lag) & (d["tf"] > threshold))),
            F.lit(False))

    agg = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.sum(hit(k).cast("long")).alias(f"__l{i}") for i, k in enumerate(lags)])
    pairs = ", ".join(f"{k}, `__l{i}`" for i, k in enumerate(lags))
    return agg.selectExpr(
        *by, "n_events",
        f"stack({len(lags)}, {pairs}) AS (lag, __n)").select(
        *by, "lag", "n_events",
        F.round(100.0 * F.col("__n") / F.col("n_events"), 2).alias("detect_rate"))


def peak_lag(sweep: DataFrame, by: Sequence[str], low: int, high: int) -> DataFrame:
    """Lag of the highest rate (the first of equals), and edge warning."""
    best = sweep.groupBy(*by).agg(
        F.max(F.struct("detect_rate", (-F.col("lag")).alias("neg"))).alias("b"),
        F.max("n_events").alias("n_events"),
        F.max(F.when(F.col("lag") == 0, F.col("detect_rate")))
        .alias("rate_at_zero"))
    peak = -F.col("b.neg")
    return best.select(*by, "n_events", peak.alias("peak_lag"),
                       F.col("b.detect_rate").alias("peak_rate"), "rate_at_zero",
                       peak.isin(low, high).alias("at_window_edge"))


def cumulative_detection(events: DataFrame, history: DataFrame,
                         by: Sequence[str], widest: int,
                         threshold: float) -> DataFrame:
    """Share detected within +-w years as w grows from zero."""
    j = events.join(history, "pixel_id", "left")
    dist = F.array_min(F.transform(
        F.filter("history", lambda d: d["tf"] > threshold),
        lambda d: F.abs(d["year"] - F.col("event_year"))))
    agg = j.withColumn("__d", dist).groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.coalesce(F.sum((F.col("__d") <= w).cast("long")), F.lit(0))
          .alias(f"__w{w}") for w in range(widest + 1)])
    pairs = ", ".join(f"{w}, `__w{w}`" for w in range(widest + 1))
    return agg.selectExpr(
        *by, "__n", f"stack({widest + 1}, {pairs}) AS (half_width, __k)").select(
        *by, "half_width",
        F.round(100.0 * F.col("__k") / F.col("__n"), 2).alias("cum_detect_rate"))


def separation(events: DataFrame, level: str, value: str,
               contrasts: Sequence[tuple[str, str]],
               strata: Sequence[str] = ()) -> DataFrame:
    """Cliff's delta of two levels, with tie share, over groups of any size.

    The rank sum follows from running counts at each distinct value, so neither
    side is sampled or collected.
    """
    spark = events.sparkSession
    strata = list(strata)
    con = registry(spark, ["contrast", level, "side"], [
        row for hi, lo in contrasts
        for row in ((f"{hi} vs {lo}", hi, 1), (f"{hi} vs {lo}", lo, 0))])
    d = events.select(*strata, level, value).join(con, level)
    keys = [*strata, "contrast"]
    c = ordered_cumulative(d, keys, value, {
        "hi": F.col("side"), "lo": 1 - F.col("side")})
    u = F.sum(F.col("hi") * (F.col("lo_before") + F.col("lo") / 2.0))
    out = c.groupBy(*keys).agg(
        F.max("hi_all").alias("n_hi"), F.max("lo_all").alias("n_lo"),
        F.sum(F.when(F.col(value) == 0, F.col("hi") + F.col("lo")).otherwise(0))
        .alias("__zero"), u.alias("__u"))
    both = F.col("n_hi").cast("double") * F.col("n_lo")
    return out.select(
        *keys, "n_hi", "n_lo",
        F.round(F.col("__zero") / (F.col("n_hi") + F.col("n_lo")), 3)
        .alias("tie_frac"),
        F.when(both > 0, F.round(2 * F.col("__u") / both - 1, 3)).alias("delta"))


def separation_table(events: DataFrame, level: str, value: str,
                     contrasts: Sequence[tuple[str, str]], stratum: str, threshold: float,
                     detected: Column) -> DataFrame:
    """Separation of the levels over each stratum and all of them (``pooled``).

    Beside the delta of all events that of the detected ones, with the counts it rests
    on, and the difference of the shares above ``threshold`` in percent points. The
    events are copied twice at most, then counted per distinct value.
    """
    d = events.where(F.col(value).isNotNull()).select(
        F.explode(F.array_distinct(F.array(F.lit("pooled"), F.col(stratum).cast("string"))))
        .alias("stratum"), level, value, F.coalesce(detected, F.lit(False)).alias("__det"))
    key = ["stratum", "contrast"]
    every = separation(d, level, value, contrasts, ["stratum"]).withColumnRenamed(
        "delta", "delta_uncond")
    det = separation(d.where("__det"), level, value, contrasts, ["stratum"]).select(
        *key, F.col("n_hi").alias("n_det_hi"), F.col("n_lo").alias("n_det_lo"),
        F.col("delta").alias("delta_detected"))
    rate = d.groupBy("stratum", level).agg(
        F.avg((F.col(value) > threshold).cast("double")).alias("__r"))
    con = registry(events.sparkSession, ["contrast", "__hi", "__lo"],
                   [(f"{hi} vs {lo}", hi, lo) for hi, lo in contrasts])
    hi = rate.select("stratum", F.col(level).alias("__hi"), F.col("__r").alias("__rh"))
    lo = rate.select("stratum", F.col(level).alias("__lo"), F.col("__r").alias("__rl"))
    out = (null_safe_join(every, det, key, "left").join(con, "contrast"))
    out = null_safe_join(out, hi, ["stratum", "__hi"], "left")
    out = null_safe_join(out, lo, ["stratum", "__lo"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *key, "n_hi", "n_lo", F.coalesce("n_det_hi", zero).alias("n_det_hi"),
        F.coalesce("n_det_lo", zero).alias("n_det_lo"),
        F.round(100 * (F.col("__rh") - F.col("__rl")), 2).alias("detect_rate_diff_pp"),
        "tie_frac", "delta_uncond", "delta_detected")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation, ties averaged.

    Rows are first reduced to counts per (x, y); ranks are looked up per
    distinct value and weighted.
    """
    keys = list(keys)
    xy = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *keys, F.col(x).cast("double").alias("__x"),
        F.col(y).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__w"))

    def ranks(col: str, name: str) -> DataFrame:
        c = ordered_cumulative(xy, keys, col, {"n": F.col("__w")})
        return c.select(*keys, col, (F.col("n_before") + (F.col("n") + 1) / 2.0)
                        .alias(name))

    j = null_safe_join(xy, ranks("__x", "rx"), [*keys, "__x"])
    j = null_safe_join(j, ranks("__y", "ry"), [*keys, "__y"])
    w, a, b = F.col("__w"), F.col("rx"), F.col("ry")
    s = j.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"),
        F.sum(w * a * b).alias("sab"))
    n = F.col("n").cast("double")
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    return s.select(*keys, "n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))
                    .alias("rho"))


def ratio_outliers(detail: DataFrame, overall: DataFrame, level: str,
                   value: str, low: float = 0.5, high: float = 2.0,
                   min_n: int = 0) -> DataFrame:
    """Rows whose value is far from that of their whole class."""
    c = overall.select(level, F.col(value).alias("class_value"))
    j = detail.where(F.col("n_events") >= min_n).join(c, level, "left")
    r = F.round(F.col(value) / F.greatest("class_value", F.lit(1e-6)), 2)
    return j.withColumn("ratio_to_class", r).where((r < low) | (r > high))


# -- threshold derivation -----------------------------------------------------

def reference_cells(grid: DataFrame, burned: DataFrame,
                    recorded: DataFrame) -> DataFrame:
    """Cells without any fire and without any record."""
    return (grid.select("pixel_id")
            .join(burned.select("pixel_id").distinct(), "pixel_id", "left_anti")
            .join(recorded.select("pixel_id").distinct(), "pixel_id", "left_anti"))


def one_year_each(values: DataFrame, seed: int) -> DataFrame:
    """One randomly drawn year per cell, the same under any partitioning."""
    order = seeded_order(F.concat_ws("-", "pixel_id", "year"), seed)
    return values.groupBy("pixel_id").agg(
        F.min(F.struct(order.alias("o"), F.col("value").alias("value")))
        .alias("r")).select("pixel_id", "r.value")


def threshold_roc(reference: DataFrame, positives: DataFrame,
                  grid: Sequence[float]) -> DataFrame:
    """Sensitivity, specificity and their sum less one at each threshold.

    One pass over each side: a counted condition per grid point.
    """
    def rates(df: DataFrame, above: bool, name: str) -> DataFrame:
        v = F.col("value")
        aggs = [F.avg(((v > t) if above else (v <= t)).cast("double"))
                .alias(f"t{i}") for i, t in enumerate(grid)]
        pairs = ", ".join(f"CAST({t!r} AS DOUBLE), t{i}" for i, t in enumerate(grid))
        return df.where(v.isNotNull()).agg(*aggs).selectExpr(
            f"stack({len(grid)}, {pairs}) AS (threshold, {name})")

    s = rates(positives, True, "sensitivity")
    p = rates(reference, False, "specificity")
    return s.join(p, "threshold").withColumn(
        "youden", F.col("sensitivity") + F.col("specificity") - 1)


def choose_threshold(roc: DataFrame, noise_p99: DataFrame) -> DataFrame:
    """Best threshold (lowest of equals) and the smaller of it and the p99."""
    best = roc.agg(F.max(F.struct("youden", (-F.col("threshold")).alias("neg")))
                   .alias("b")).select((-F.col("b.neg")).alias("youden_t"))
    return best.crossJoin(noise_p99.select("p99")).select(  # one row each
        "youden_t", "p99", F.least("youden_t", "p99").alias("primary"))


def retention_at(values: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Share of cells whose yearly maximum stays at or below each threshold."""
    top = values.groupBy("pixel_id").agg(F.max("value").alias("m"))
    aggs = [F.avg((F.col("m") <= t).cast("double")).alias(f"t{i}")
            for i, t in enumerate(grid)]
    pairs = ", ".join(f"CAST({t!r} AS DOUBLE), t{i}" for i, t in enumerate(grid))
    return top.where(F.col("m").isNotNull()).agg(*aggs).selectExpr(
        f"stack({len(grid)}, {pairs}) AS (threshold, r)").select(
        "threshold", F.round(100 * F.col("r"), 3).alias("retention_pct"))


# -- test of records assumed harmless -------------------------------------------

def harmless_rates(records: DataFrame, clean_cells: DataFrame,
                   zones: DataFrame, det: DataFrame, window: int) -> DataFrame:
    """Observed against expected detection rate per activity.

    ``records`` (pixel_id, event_year, activity) are harmless records on cells
    that carry nothing else; ``clean_cells`` carry nothing at all. The expected
    rate of a record is the clean cells' rate in its zone and year: zero where none of
    them was hit, unknown (and the record left out) where the zone or the year has no
    hit at all.
    """
    cov = coverage(det, window).withColumn("__hit", F.lit(1))
    ref = clean_cells.select("pixel_id").distinct().join(zones, "pixel_id")
    ref_n = ref.where(F.col("zone").isNotNull()).groupBy("zone").agg(
        F.count(F.lit(1)).alias("__d"))
    ref_hit = ref.join(cov, "pixel_id").groupBy("zone", "year").agg(
        F.count(F.lit(1)).alias("__h"))
    ref_hit = ref_hit.withColumnRenamed("year", "event_year")
    known = ref_n.join(ref_hit.select("zone").distinct(), "zone")
    years = ref_hit.where(F.col("zone").isNotNull()).select("event_year").distinct()
    a = records.where(F.col("event_year").isNotNull()).join(zones, "pixel_id")
    a = a.where(F.col("zone").isNotNull())
    a = a.join(cov.withColumnRenamed("year", "event_year"),
               ["pixel_id", "event_year"], "left")
    a = (a.join(known, "zone").join(years, "event_year")
         .join(ref_hit, ["zone", "event_year"], "left")
         .withColumn("__exp", F.coalesce("__h", F.lit(0)) / F.col("__d")))
    n = F.count(F.lit(1))
    return a.groupBy("activity").agg(
        n.alias("n_records"), F.count_distinct("pixel_id").alias("n_pixels"),
        F.count("__hit").alias("n_hit"),
        F.avg("__exp").alias("exp_rate")).withColumn(
        "obs_rate", F.col("n_hit") / F.col("n_records"))


def harmless_decision(rates: DataFrame, ratio_min: float = 2.0,
                      pixels_min: int = 100, p_max: float = 0.001) -> DataFrame:
    """One-sided exact test and decision per activity."""
    ratio = F.when(F.col("exp_rate") > 0, F.col("obs_rate") / F.col("exp_rate"))
    out = rates.withColumn("ratio", ratio).withColumn(
        "p_value", binomial_greater_p("n_hit", "n_records", "exp_rate"))
    hit = ((F.col("ratio") >= ratio_min) & (F.col("n_pixels") >= pixels_min)
           & (F.col("p_value") < p_max))
    return out.withColumn("decision", F.when(
        F.coalesce(hit, F.lit(False)), "disturbing").otherwise("non_disturbing"))
