"""Data-quality jobs. Each is one or a few aggregations over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import lookup, near, seeded_order
from panelspark.operators.core import exact_quantiles, null_safe_join, pct, registry


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))


def value_profile(values: DataFrame, by: Sequence[str],
                  value: str = "value") -> DataFrame:
    """Rows, share null, zero and negative, and q01, median, q99 per group."""
    by = list(by)
    v, n = F.col(value), F.count(F.lit(1))
    base = values.groupBy(*by).agg(
        n.alias("n"), F.round(100.0 * _sum(v.isNull()) / n, 3).alias("pct_null"),
        F.round(100.0 * _sum(v == 0) / n, 3).alias("pct_zero"),
        F.round(100.0 * _sum(v < 0) / n, 3).alias("pct_negative"))
    q = exact_quantiles(values, by, value, {"q01": .01, "median": .5, "q99": .99})
    return null_safe_join(base, q, by, "left")


def id_integrity(shard: DataFrame, grid: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Duplicates, ids outside the grid and grid ids missing, one row."""
    s = shard.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    g = grid.select(key).distinct().withColumn("__g", F.lit(1))
    j = s.join(g, key, "full")
    return j.agg(_sum(F.col("__n").isNotNull()).alias("n_ids"),
                 _sum(F.col("__n") > 1).alias("n_duplicated"),
                 _sum(F.col("__n").isNotNull() & F.col("__g").isNull()).alias("n_outside"),
                 _sum(F.col("__n").isNull()).alias("n_absent"))


def layer_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson and Spearman correlation and ratio of medians of two layers."""
    from panelspark.operators.detect import spearman

    j = a.select(*keys, F.col("value").alias("va")).join(
        b.select(*keys, F.col("value").alias("vb")), list(keys))
    j = j.where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    base = j.agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("pearson"))
    ma = exact_quantiles(j, [], "va", {"median_a": .5})
    mb = exact_quantiles(j, [], "vb", {"median_b": .5})
    s = spearman(j, "va", "vb").select("rho")
    return base.crossJoin(ma).crossJoin(mb).crossJoin(s).select(  # one row each
        "n", "pearson", F.col("rho").alias("spearman"), "median_a", "median_b",
        (F.col("median_a") / F.col("median_b")).alias("median_ratio"))


def static_zero_mask(values: DataFrame) -> DataFrame:
    """Whether the same cells are zero in every year of a layer."""
    y = values.agg(F.count_distinct("year").alias("n_years"))
    c = values.groupBy("pixel_id").agg(_sum(F.col("value") == 0).alias("z"))
    return c.crossJoin(y).agg(  # one row on the right
        _sum(F.col("z") > 0).alias("n_ever_zero"),
        _sum(F.col("z") == F.col("n_years")).alias("n_always_zero")).withColumn(
        "static", F.col("n_ever_zero") == F.col("n_always_zero"))


def out_of_bounds(values: DataFrame, bounds: Mapping[str, tuple[float, float]],
                  layer: str = "layer", value: str = "value") -> DataFrame:
    """Values outside physical bounds per layer."""
    lo = lookup(F.col(layer), {k: float(b[0]) for k, b in bounds.items()})
    hi = lookup(F.col(layer), {k: float(b[1]) for k, b in bounds.items()})
    v = F.col(value)
    return values.groupBy(layer).agg(
        F.count(v).alias("n"), _sum(v < lo).alias("n_below"),
        _sum(v > hi).alias("n_above"), F.min(v).alias("value_min"),
        F.max(v).alias("value_max"))


def zone_codes(df: DataFrame, zone: str, width: int, small: int = 100) -> DataFrame:
    """Codes of the wrong width, with spaces, not all digits, or with few cells."""
    n = df.groupBy(zone).agg(F.count(F.lit(1)).alias("n"))
    z = F.col(zone)
    return n.agg(F.count(F.lit(1)).alias("n_codes"),
                 _sum(z.isNull()).alias("n_null"),
                 _sum(F.length(z) != width).alias("n_bad_width"),
                 _sum(z.rlike(r"\s")).alias("n_spaces"),
                 _sum(~z.rlike(r"^[0-9]+$")).alias("n_not_digits"),
                 _sum(F.col("n") < small).alias("n_small"))


def record_profile(records: DataFrame, by: Sequence[str] = ("source_layer",),
                   ) -> DataFrame:
    """Rows, cells, rows per cell, years, undated and repeated cells per layer."""
    by = list(by)
    per = records.groupBy(*by, "pixel_id").agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct("event_year").alias("ky"))
    a = per.groupBy(*by).agg(
        F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_pixels"),
        F.round(F.sum("k") / F.count(F.lit(1)), 4).alias("rows_per_pixel"),
        F.max("k").alias("max_rows"), _sum(F.col("ky") > 1).alias("n_multi_year"))
    b = records.groupBy(*by).agg(
        F.min("event_year").alias("year_first"), F.max("event_year").alias("year_last"),
        _sum(F.col("event_year").isNull()).alias("n_undated"))
    return null_safe_join(a, b, by)


def units_ratio(values: DataFrame, reference: str, layer: str = "layer",
                gate: float = 2.5) -> DataFrame:
    """Median of each product against the reference, flagged beyond a factor."""
    m = exact_quantiles(values.where(F.col("value") > 0), [layer], "value", {"median": .5})
    r = m.where(F.col(layer) == reference).select(F.col("median").alias("__ref"))
    ratio = F.col("median") / F.col("__ref")
    return m.crossJoin(r).select(  # one row on the right
        layer, "median", ratio.alias("ratio"),
        ((ratio <= gate) & (ratio >= 1 / gate)).alias("ok"))


def sentinel_scan(values: DataFrame, by: Sequence[str], limits: Sequence[float],
                  value: str = "value") -> DataFrame:
    """Values sitting on a type limit, per group and limit."""
    v = F.col(value).cast("double")
    agg = values.groupBy(*by).agg(
        F.count(v).alias("n"), *[_sum(near(v, float(t))).alias(f"__l{i}")
                                 for i, t in enumerate(limits)])
    pairs = ", ".join(f"CAST({float(t)!r} AS DOUBLE), `__l{i}`" for i, t in enumerate(limits))
    return agg.selectExpr(*by, "n", f"stack({len(limits)}, {pairs}) AS (type_limit, n_hit)")


def late_degradation(records: DataFrame, failed: Column, exposed: Column,
                     year: str = "year") -> DataFrame:
    """Failure rate by year and its enrichment among exposed rows."""
    f, x = F.coalesce(failed, F.lit(False)), F.coalesce(exposed, F.lit(False))
    n = F.count(F.lit(1))
    a = records.groupBy(year).agg(
        n.alias("n"), _sum(f).alias("n_failed"), _sum(x).alias("n_exposed"),
        _sum(f & x).alias("n_failed_exposed"))
    rate = F.col("n_failed") / F.col("n")
    rx = F.when(F.col("n_exposed") > 0, F.col("n_failed_exposed") / F.col("n_exposed"))
    return a.select("*", F.round(100 * rate, 3).alias("pct_failed"),
                    F.when(rate > 0, F.round(rx / rate, 3)).alias("enrichment"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, mean, deviation and range per numeric column."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, v)")
    n = F.count(F.lit(1))
    return long.groupBy("column_name").agg(
        n.alias("n"), _sum(F.col("v").isNull()).alias("n_missing"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"))


def assertions(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """PASS/FAIL table: rows violating each condition. One pass for all checks."""
    names = list(checks)
    agg = df.agg(*[_sum(~F.coalesce(c, F.lit(False))).alias(f"__c{i}")
                   for i, c in enumerate(checks.values())])
    pairs = ", ".join(f"'{n}', `__c{i}`" for i, n in enumerate(names))
    return agg.selectExpr(f"stack({len(names)}, {pairs}) AS (check_name, n_bad)").withColumn(
        "ok", F.col("n_bad") == 0)


def group_table_checks(c=F.col) -> dict[str, Column]:
    """Conditions every row of a group table must meet."""
    treated = c("analysis_group").rlike("^[FT]")
    return {
        "id_present": c("pixel_id").isNotNull(),
        "status_known": c("status_code").isin("TR", "P", "PO", "PUB", "NGO", "UN", "NP"),
        "group_implies_role": c("analysis_group").isNull()
        | c("eligibility").isin("treatment", "control"),
        "treated_has_cohort": c("analysis_group").isNull() | ~treated
        | c("cohort_year").isNotNull(),
        "treated_has_one_event": c("analysis_group").isNull() | ~treated
        | (c("n_effective") == 1),
        "treated_detected": c("analysis_group").isNull() | ~treated
        | c("detect_at_event"),
        "control_without_event": ~F.coalesce(
            c("analysis_group").isin("UP", "UNP"), F.lit(False))
        | ((c("n_effective") == 0) & (c("n_detect") == 0) & c("cohort_year").isNull()),
        "offset_has_start": ~F.coalesce(
            c("analysis_group").isin("OP", "ONP"), F.lit(False))
        | (c("cohort_year") == c("offset_start")),
        "suffix_matches_status": c("analysis_group").isNull()
        | (c("analysis_group").rlike("NP$") == (c("status_code") == "NP")),
        "chain_in_code": c("class_code").startswith(F.coalesce(c("event_chain"), F.lit("U"))),
        "counts_add_up": F.coalesce(c("n_thin"), F.lit(0)) + F.coalesce(c("n_fire"), F.lit(0))
        == F.coalesce(c("n_events"), F.lit(0)),
        "years_in_order": c("first_event_year").isNull()
        | (c("first_event_year") <= c("last_event_year")),
    }


def declared_checks(first: int, last: int, rules: Sequence[str], groups: Mapping[str, tuple],
                    c=F.col) -> dict[str, Column]:
    """Conditions of a group table against its registries; ``groups`` gives arm, role and
    stratum of each group."""
    g, e, y = c("analysis_group"), c("eligibility"), c("cohort_year")
    assigned, role = g.isNotNull(), e.isin("treatment", "control")
    arm = lookup(g, {k: v[0] for k, v in groups.items()})
    stratum = lookup(g, {k: v[2] or "" for k, v in groups.items()})
    timed = assigned & c("arm").isin("fire", "thin", "offset")
    protected = assigned & (c("status_code") == "P") & c("arm").isin("fire", "thin")

    def if_(a: Column, b: Column) -> Column:
        return ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))

    return {
        "class_complete": c("class_code").isNotNull(),
        "status_complete": c("status_code").isNotNull(),
        "eligibility_complete": e.isNotNull(),
        "group_declared": if_(assigned, g.isin(list(groups))),
        "eligibility_declared": if_(e.isNotNull(), e.isin(
            [*rules, "treatment", "control", "unassigned"])),
        "assigned_has_role": if_(assigned, role),
        "role_has_group": if_(role, assigned),
        "none_falls_through": if_(e.isNotNull(), e != "unassigned"),
        "group_and_arm": if_(assigned, c("arm") == arm),
        "group_and_stratum": if_(assigned, F.coalesce(c("stratum"), F.lit("")) == stratum),
        "cohort_present": if_(timed, y.isNotNull()),
        "cohort_absent": if_(assigned & c("arm").isin("pa", "control"), y.isNull()),
        "cohort_in_window": if_(timed & y.isNotNull(), y.between(first, last)),
        "undisturbed_without_event": if_(g.isin("UP", "UNP", "OP", "ONP"),
                                         c("n_effective") == 0),
        "protected_before_cohort": if_(protected & c("pa_est_year").isNotNull(),
                                       c("pa_est_year") <= y),
    }


def source_checks(groups: DataFrame, grid: DataFrame, events: DataFrame,
                  detections: DataFrame, tribal: Sequence[str], first: int) -> DataFrame:
    """The group table against the grid, the event frame and the detections.

    Every source becomes flags on one row per cell; cells that the table lacks are counted
    by the grid check and left out of the others.
    """
    arm = F.col("arm")
    src = events.groupBy("pixel_id").agg(
        F.max(arm == "thin").alias("thin"), F.max(arm == "fire").alias("fire"),
        F.max((arm == "offset") & F.col("event_year").isNotNull()).alias("off"),
        F.max((arm == "tribal") | ((arm == "own") & F.coalesce(
            F.col("class_value").isin(list(tribal)), F.lit(False)))).alias("tr"))
    det = detections.select("pixel_id").distinct().withColumn("det", F.lit(True))
    g = groups.groupBy("pixel_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("lulc").alias("g_lulc"),
        F.max(F.col("n_thin") > 0).alias("g_thin"), F.max(F.col("n_fire") > 0).alias("g_fire"),
        F.max("undated_thin").alias("g_und"), F.max(F.col("n_events") > 0).alias("g_ev"),
        F.max(F.col("offset_start").isNotNull()).alias("g_off"),
        F.max(F.coalesce(F.col("status_code") == "TR", F.lit(False))).alias("g_tr"),
        F.max(F.col("n_detect") > 0).alias("g_det"), _sum(
            (F.col("analysis_group") == "UP") & (F.col("pa_est_year") < first)).alias("early"))
    j = (grid.select("pixel_id", F.col("lulc").alias("lulc0")).join(g, "pixel_id", "full")
         .join(src, "pixel_id", "left").join(det, "pixel_id", "left"))
    there = F.col("n").isNotNull()

    def on(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    here = {
        "lulc_as_grid": ~F.col("g_lulc").eqNullSafe(F.col("lulc0")),
        "thin_present": on("thin") & ~(on("g_thin") | on("g_und") | on("g_fire")),
        "fire_present": on("fire") & ~on("g_fire"),
        "none_invented": on("g_ev") & ~(on("thin") | on("fire")),
        "offset_set": on("off") != on("g_off"), "tribal_set": on("tr") != on("g_tr"),
        "detected_set": on("det") != on("g_det")}
    n = F.coalesce(F.col("n"), F.lit(0))
    in_grid = F.col("lulc0").isNotNull()
    rows = {
        "row_count": F.abs(F.sum(n) - _sum(in_grid)), "id_unique": F.sum(F.greatest(n - 1, F.lit(0))),
        "id_set": _sum(in_grid != there), **{k: _sum(there & v) for k, v in here.items()},
        "keeps_early_protection": (F.coalesce(F.sum("early"), F.lit(0)) == 0).cast("long")}
    agg = j.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in rows.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in rows)
    return agg.selectExpr(f"stack({len(rows)}, {pairs}) AS (check_name, n_bad)").withColumn(
        "ok", F.col("n_bad") == 0)


def pair_structure(units: DataFrame, stratum: str, pair: str = "pair_id",
                   cell: str = "pixel_id") -> DataFrame:
    """Pairs must hold one treated and one control row with one stratum and one cohort.

    Minima and maxima per pair tell a split value; cells treated twice are counted by
    their surplus rows. Both tables combine before the shuffle.
    """
    t = F.col("treat") == 1
    s, g = F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.when(F.col("gvar") > 0, F.col("gvar"))
    p = units.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), _sum(t).alias("t"),
                                (F.min(s) != F.max(s)).alias("s"), (F.min(g) != F.max(g)).alias("g"))
    rows = {"pairs_not_two": _sum(F.col("n") != 2), "pairs_not_one_treated": _sum(F.col("t") != 1),
            "pairs_split_stratum": _sum(F.col("s")),
            "pairs_split_gvar": _sum(F.coalesce(F.col("g"), F.lit(False)))}
    agg = p.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in rows.items()])
    twice = units.where(t).groupBy(cell).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_treated_cells"))
    names = [*rows, "duplicate_treated_cells"]
    pairs = ", ".join(f"'{k}', `{k}`" for k in names)
    return agg.crossJoin(twice).selectExpr(  # one row on both sides
        f"stack({len(names)}, {pairs}) AS (check_name, n_bad)").withColumn("ok", F.col("n_bad") == 0)


def panel_verifier(units: DataFrame, matched: DataFrame, panel: DataFrame, first: int, last: int,
                   log: bool = True, unit: str = "unit_id", cell: str = "pixel_id") -> DataFrame:
    """Units against the matched rows they come from, and the panel against its units.

    ``matched`` (pair_id, cell, treat, gvar) carries the cohort recomputed from its source;
    null cohorts are compared as such. Every check counts its offenders: rows of either
    side without the other, repeated ids, cohorts that differ, panel rows of no unit, out
    of the window, repeated or without a value, values a logarithm cannot take, years of
    the window that nobody has, units without a row, treated units whose cohort lies after
    the last year observed.
    """
    key = ["pair_id", cell, "treat"]
    a = units.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("gvar").alias("__g"),
                                F.max("gvar").alias("__h"))
    b = matched.groupBy(*key).agg(F.count(F.lit(1)).alias("__m"), F.min("gvar").alias("__w"))
    both = null_safe_join(a, b, key, "left")
    differ = F.col("__m").isNotNull() & ~(F.col("__g").eqNullSafe(F.col("__w"))
                                          & F.col("__h").eqNullSafe(F.col("__w")))
    there = null_safe_join(b, a.select(*key, "__n"), key, "left")
    year, value = F.col("year"), F.col("value")
    by_year = panel.groupBy(unit, "year").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(value.isNull().cast("long")).alias("__null"),
        F.sum((value < 0).cast("long")).alias("__neg"))
    by_unit = by_year.groupBy(unit).agg(
        F.sum("__n").alias("__rows"), F.sum(F.col("__n") - 1).alias("__twice"),
        F.sum("__null").alias("__null"), F.sum("__neg").alias("__neg"),
        F.sum(F.when(~year.between(first, last), F.col("__n")).otherwise(0)).alias("__out"))
    ids = units.groupBy(unit).agg(F.count(F.lit(1)).alias("__k"),
                                  F.max(F.when(F.col("treat") == 1, F.col("gvar"))).alias("__c"))
    ends = panel.agg(F.max("year").alias("__last"))
    u = null_safe_join(ids, by_unit, [unit], "left").crossJoin(ends)  # one row
    p = null_safe_join(by_unit, ids.select(unit, "__k"), [unit], "left")
    span = units.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    gone = span.join(panel.select("year").distinct(), "year", "left_anti")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    parts = [
        (both, {"unit_not_matched": total(F.when(F.col("__m").isNull(), F.col("__n")).otherwise(0)),
                "cohort_differs": total(F.when(differ, F.col("__n")).otherwise(0))}),
        (there, {"matched_not_unit": total(F.when(F.col("__n").isNull(), F.col("__m")).otherwise(0))}),
        (u, {"unit_id_repeated": total(F.col("__k") - 1),
             "unit_without_rows": total(F.col("__rows").isNull().cast("long")),
             "cohort_not_viable": total((F.coalesce("__c", F.lit(0)) > F.col("__last")).cast("long"))}),
        (p, {"row_of_no_unit": total(F.when(F.col("__k").isNull(), F.col("__rows")).otherwise(0)),
             "row_repeated": total(F.col("__twice")), "row_without_value": total(F.col("__null")),
             "row_out_of_window": total(F.col("__out")),
             "value_without_log": total(F.col("__neg")) if log else F.lit(0).cast("long")}),
        (gone, {"year_absent": F.count(F.lit(1))})]
    out = None
    for frame, checks in parts:
        pairs = ", ".join(f"'{k}', `{k}`" for k in checks)
        one = frame.agg(*[v.alias(k) for k, v in checks.items()]).selectExpr(
            f"stack({len(checks)}, {pairs}) AS (check_name, n_bad)")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.col("n_bad") == 0)


def unit_checks(first: int, last: int, c=F.col) -> dict[str, Column]:
    """Conditions every unit row must meet."""
    t = c("treat") == 1
    return {
        "treat_binary": c("treat").isin(0, 1),
        "control_gvar_zero": t | (c("gvar") == 0),
        "treated_gvar_positive": ~t | (c("gvar") > 0),
        "treated_gvar_in_range": ~t | c("gvar").between(first, last),
        "pair_present": c("pair_id").isNotNull(),
    }


def key_profile(records: DataFrame, table: str, crosswalk: DataFrame,
                key: str = "key_value") -> DataFrame:
    """Records and distinct activities by how the crosswalk resolved them."""
    from panelspark.functions.text import normalise_or_missing
    from panelspark.operators.lookups import crosswalk_join

    n = records.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    j = crosswalk_join(n, table, crosswalk, key)
    return j.groupBy(F.coalesce("origin", F.lit("unresolved")).alias("resolved_by")).agg(
        F.sum("__n").alias("n_records"),
        F.count_distinct(normalise_or_missing(F.col(key))).alias("n_keys"))


def field_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing, blank and distinct values per text field."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    v = F.col("v")
    # one row per distinct value first, so a common value is one row
    n = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (field, v)").groupBy(
        "field", "v").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy("field").agg(
        F.sum("k").alias("n"), F.sum(F.when(v.isNull(), F.col("k")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.trim(v) == "", F.col("k")).otherwise(0)).alias("n_blank"),
        F.count(v).alias("n_distinct"))


def join_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     unit: str, share: float, seed: int) -> DataFrame:
    """Rows a join will give, extrapolated from a seeded share of the units.

    Units are sampled whole by digest, so every partitioning draws the same.
    """
    digits = F.conv(F.substring(seeded_order(F.col(unit), seed), 1, 8), 16, 10).cast("long")
    s = left.where(digits < int(share * 2 ** 32))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    j = s.join(r, list(keys), "left")
    m = F.coalesce("__m", F.lit(0))
    a = j.agg(F.count(F.lit(1)).alias("n_sampled"), F.sum(m).alias("n_joined"),
              F.max(m).alias("max_fanout"), _sum(m > 0).alias("n_hit"))
    tot = left.agg(F.count(F.lit(1)).alias("n_total"))
    return a.crossJoin(tot).withColumn(  # one row each
        "n_estimated", F.round(F.col("n_joined") * F.col("n_total")
                               / F.col("n_sampled")).cast("long"))


def lookup_audit(records: DataFrame, key: str, table: DataFrame, table_key: str,
                 cohort: str) -> DataFrame:
    """Ids matched and unmatched on both sides, rows left without a cohort."""
    from panelspark.functions.text import fold_key

    a = records.groupBy(fold_key(F.col(key)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table.groupBy(fold_key(F.col(table_key)).alias("k")).agg(
        F.min(cohort).alias("c"), F.count(F.lit(1)).alias("m"))
    j = a.join(b, "k", "full")
    n, m = F.col("n"), F.col("m")
    return j.agg(_sum(n.isNotNull()).alias("n_ids"),
                 _sum(n.isNotNull() & m.isNotNull()).alias("n_matched"),
                 _sum(n.isNotNull() & m.isNull()).alias("n_unmatched"),
                 _sum(n.isNull()).alias("n_unused"),
                 F.coalesce(F.sum(F.when(F.col("c").isNull(), n)), F.lit(0))
                 .alias("n_rows_without_cohort"))


def screen_audit(det: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of cells never detected and agreement of the secondary layer."""
    per = det.groupBy("pixel_id").agg(F.count(F.lit(1)).alias("k"))
    n = cells.select("pixel_id").distinct()
    a = n.join(per, "pixel_id", "left").agg(
        F.count(F.lit(1)).alias("n_cells"), _sum(F.col("k").isNull()).alias("n_never"))
    b = det.agg(F.count(F.lit(1)).alias("n_detections"),
                _sum(F.col("agb_loss") > 0).alias("n_agreeing"))
    return a.crossJoin(b).withColumn(  # one row each
        "pct_never", pct(F.col("n_never"), F.col("n_cells"), 3)).withColumn(
        "pct_agreeing", pct(F.col("n_agreeing"), F.col("n_detections"), 3))


def exclusion_accounting(entries: DataFrame) -> DataFrame:
    """Cells removed for repeated events, by reason, and their union.

    Sets are flags on one row per cell, so overlaps cost nothing.
    """
    c = entries.groupBy("pixel_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("arm_id") == 1).cast("long")).alias("nt"),
        F.sum((F.col("arm_id") == 2).cast("long")).alias("nf"))
    multi_t, multi_f = F.col("nt") > 1, F.col("nf") > 1
    both = (F.col("nt") > 0) & (F.col("nf") > 0)
    return c.agg(F.count(F.lit(1)).alias("n_cells"), _sum(multi_t).alias("n_multi_thin"),
                 _sum(multi_f).alias("n_multi_fire"), _sum(both).alias("n_both_arms"),
                 _sum(multi_t & multi_f).alias("n_multi_in_both"),
                 _sum(multi_t | multi_f | both).alias("n_union"))


def exclusion_table(events: DataFrame, grid: DataFrame, eligible: Sequence[str],
                    unclassified: Sequence[str]) -> DataFrame:
    """The ten exclusion quantities with their shares of the grid and of the arm.

    Distinct events are distinct years of a cell, a missing year being one of them, so two
    polygons of one entry count once. Everything is a flag on one row per cell; the grid
    enters as a count.
    """
    thin = F.col("arm") == "thin"
    odd = thin & ~F.coalesce(F.col("class_value").isin(list(eligible)), F.lit(False))
    unc = ~thin & F.coalesce(F.col("class_value").isin(list(unclassified)), F.lit(False))
    e = events.where(F.col("arm").isin("thin", "fire")).groupBy(
        "pixel_id", "arm", "event_year").agg(F.max(odd).alias("odd"), F.max(unc).alias("unc"))
    c = e.groupBy("pixel_id").agg(
        _sum(thin).alias("nt"), _sum(~thin).alias("nf"),
        F.max(thin & F.col("event_year").isNull()).alias("undated"), F.max("odd").alias("odd"),
        F.max("unc").alias("unc"))
    t, f, mt, mf = (F.col("nt") > 0, F.col("nf") > 0, F.col("nt") > 1, F.col("nf") > 1)
    sets = [("any_thin", t), ("any_fire", f), ("multi_thin", mt), ("multi_fire", mf),
            ("both_arms", t & f), ("undated_thin", F.col("undated")),
            ("ineligible_thin", F.col("odd")), ("unclassified_fire", F.col("unc") & ~mf),
            ("single_event_only", mt | mf | (t & f))]
    n = c.agg(*[_sum(v).alias(k) for k, v in sets], F.count(F.lit(1)).alias("either")).crossJoin(
        grid.agg(F.count(F.lit(1)).alias("grid")))  # one row on both sides
    arm = {"multi_thin": "any_thin", "multi_fire": "any_fire", "both_arms": "either"}
    rows = [F.struct(F.lit(k).alias("quantity"), F.coalesce(k, F.lit(0)).cast("long").alias("n"),
                     F.round(100.0 * F.col(k) / F.col("grid"), 3).alias("pct_of_grid"),
                     (F.round(100.0 * F.col(k) / F.col(arm[k]), 2) if k in arm
                      else F.lit(None).cast("double")).alias("pct_of_arm"))
            for k in ["grid", *[k for k, _ in sets]]]
    return n.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def reburn(entries: DataFrame) -> DataFrame:
    """Cells burned again, by the severity of their first fire."""
    f = entries.where(F.col("arm_id") == 2).groupBy("pixel_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.min(F.struct("event_year", "token")).alias("f"))
    again = (F.col("k") > 1).cast("long")
    return f.groupBy(F.col("f.token").alias("first_token")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(again).alias("n_reburned"),
        F.round(100.0 * F.sum(again) / F.count(F.lit(1)), 2).alias("pct_reburned"))


def pool_composition(cells: DataFrame, zones: DataFrame,
                     controls: Sequence[str]) -> DataFrame:
    """Where the control pool lies: cells and shares per group and zone."""
    from panelspark.operators.ledger import share_in_group

    d = cells.where(F.col("analysis_group").isin(list(controls))).join(
        zones, "pixel_id", "left")
    return share_in_group(d, ["analysis_group"], "zone")


def source_reconcile(groups: DataFrame, events: DataFrame) -> DataFrame:
    """Cells with events against cells the group table says have events."""
    from panelspark.operators.lookups import set_equal

    return set_equal(groups.where(F.col("n_events") > 0), events, "pixel_id")


def bounds_registry(spark, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return registry(spark, ["layer", "lo", "hi"], [
        (k, float(a), float(b)) for k, (a, b) in bounds.items()])
