"""Cohort windows, sampling, scores, distances and one-to-one matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.functions.numeric import seeded_order
from panelspark.operators.core import (average_ranks, first_k_per_group,
                                       null_safe_join, ordered_cumulative,
                                       small_side)
from panelspark.operators.search import match_rounds
from panelspark.session import cut_lineage

BUCKET = 64                # sampled controls in a leaf of a large cell's tree
SMALL_PAIRS = 4_000_000    # treated x controls up to which a cell is one task
SMALL_ROWS = 200_000


# -- windows ----------------------------------------------------------------------

def window_bounds(year: Column, arm: Column, protection: Column,
                  baseline: tuple[int, int] = P.BASELINE_YEARS,
                  first: int = P.STUDY_YEARS[0], n: int = P.WINDOW_YEARS,
                  shortest: int = P.WINDOW_MIN,
                  drop: Mapping[str, int] = P.EVENT_DROP) -> Column:
    """Struct (start, end) of the years before treatment, null when unusable.

    Protection by establishment year: five years before it, the years the
    panel has when that is at least three, else the baseline. Other arms: the
    five years before the event without the dropped ones, cut at the first
    study year, null when fewer than three remain.
    """
    from panelspark.functions.numeric import lookup

    lo, hi = baseline

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    base = span(F.lit(lo), F.lit(hi))
    pa = (F.when(year.isNull() | (year <= lo), base)
          .when(year > hi + 1, span(year - n, year - 1))
          .when(year - lo < shortest, base)
          .otherwise(span(F.lit(lo), year - 1)))
    end = year - 1 - F.coalesce(lookup(arm, dict(drop)), F.lit(0))
    start = F.greatest(year - n, F.lit(first))
    ev = F.when(end - start + 1 >= shortest, span(start, end))
    return F.when(protection, pa).otherwise(ev)


def window_key(window: Column) -> Column:
    return F.concat_ws("_", window["start"].cast("string"),
                       window["end"].cast("string"))


def pretreatment_mean(units: DataFrame, values: DataFrame, name: str,
                      shortest: int = P.WINDOW_MIN) -> DataFrame:
    """Mean of a yearly layer over each (cell, window); null below the minimum.

    Windows are reduced to distinct (cell, start, end) before the join.
    """
    w = units.select("pixel_id", "win_start", "win_end").distinct()
    j = w.join(values.select("pixel_id", "year", "value"), "pixel_id", "left")
    ok = F.col("year").between(F.col("win_start"), F.col("win_end"))
    v = F.when(ok, F.col("value").cast("double"))
    return j.groupBy("pixel_id", "win_start", "win_end").agg(
        F.when(F.count(v) >= shortest, F.avg(v)).alias(name))


def cap_groups(df: DataFrame, group: Sequence[str], key: str, cap: int,
               seed: int) -> DataFrame:
    """At most ``cap`` rows per group, drawn by a seeded digest of the id."""
    d = df.withColumn("__digest", seeded_order(F.col(key), seed))
    return first_k_per_group(d, group, "__digest", key, cap).drop("__digest")


def cohort_levels(treated: DataFrame, controls: DataFrame, cell: Sequence[str],
                  level: str = "win_key", floor: int | None = None) -> DataFrame:
    """Treated rows of every level with the controls of their exact cells.

    A control joins each level that has a treated unit in its cell. With
    ``floor``, a control counts only once protected: establishment (unknown is
    the floor) at or before the level's cohort year.
    """
    cell = list(cell)
    years = [level, "win_end"]
    pool = treated.select(*years, *cell).distinct()
    c = controls.join(pool, cell)
    if floor is not None:
        est = F.coalesce(F.col("pa_est_year"), F.lit(floor))
        c = c.where(est <= F.col("win_end") + 1)
    return treated.withColumn("treat", F.lit(1)).unionByName(
        c.withColumn("treat", F.lit(0)), allowMissingColumns=True)


def level_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    t = (F.col("treat") == 1).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_input"), F.sum(t).alias("n_treat"),
        F.sum(1 - t).alias("n_control"))


# -- scores -----------------------------------------------------------------------

def linear_score(df: DataFrame, fit: DataFrame, by: Sequence[str],
                 covariates: Sequence[str], out: str = "score") -> DataFrame:
    """Linear predictor of each row under its level's coefficients."""
    j = null_safe_join(df, fit, list(by))
    eta = F.col("beta")[0]
    for i, c in enumerate(covariates):
        sd = F.col("sd")[i]
        eta = eta + F.col("beta")[i + 1] * F.when(
            sd > 0, (F.col(c).cast("double") - F.col("mu")[i]) / sd).otherwise(0.0)
    return j.withColumn(out, eta).drop("mu", "sd", "beta", "converged", "separated")


def score_spread(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                 factor: float = P.CALIPER_SD) -> DataFrame:
    """Caliper widths: a factor times the level's deviation of each column."""
    return df.groupBy(*by).agg(*[
        (factor * F.stddev_samp(c)).alias(f"caliper_{c}") for c in columns])


# -- distances ----------------------------------------------------------------------

def whitening(df: DataFrame, by: Sequence[str], covariates: Sequence[str],
              robust: bool = False) -> DataFrame:
    """Matrix per level that turns Mahalanobis into Euclidean distance.

    One aggregation of cross products per level; the p x p inverses run in an
    Arrow batch over the level table. Pooled within-side covariance, or for
    ``robust`` the covariance of ranks rescaled to untied ranks.
    """
    by, p = list(by), len(covariates)
    x = [F.col(c).cast("double") for c in covariates]
    tri = [(i, j) for i in range(p) for j in range(i, p)]
    side = [] if robust else ["treat"]
    base = df.groupBy(*by).agg(F.array(*[F.avg(c) for c in x]).alias("__mu"))
    d = null_safe_join(df, small_side(base), by)
    c = [x[i] - F.col("__mu")[i] for i in range(p)]
    s = d.groupBy(*by, *side).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(v) for v in c]).alias("s1"),
        F.array(*[F.sum(c[i] * c[j]) for i, j in tri]).alias("s2"))
    packed = s.groupBy(*by).agg(F.collect_list(F.struct("n", "s1", "s2")).alias("m"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in df.select(*by).schema)

    def invert(batches):
        for pdf in batches:
            ws = []
            for m in pdf["m"]:
                total, dof = np.zeros((p, p)), 0.0
                for r in m:
                    n, s1 = float(r["n"]), np.array(r["s1"], dtype=float)
                    q = np.zeros((p, p))
                    for v, (i, j) in zip(r["s2"], tri):
                        q[i, j] = q[j, i] = v
                    total += q - np.outer(s1, s1) / n
                    dof += n - 1
                cov = total / max(dof, 1.0)
                if robust:
                    n = float(m[0]["n"])
                    untied = n * (n + 1) / 12.0
                    sd = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
                    k = np.where(np.diag(cov) > 0, np.sqrt(untied) / sd, 0.0)
                    cov = cov * np.outer(k, k)
                vals, vecs = np.linalg.eigh(cov)
                keep = vals > max(vals.max(), 0) * 1e-12
                # widest axis first: it prunes the search best
                order = np.argsort(-vals[keep])
                w = (vecs[:, keep] / np.sqrt(vals[keep])).T[order]
                full = np.zeros((p, p))
                full[:w.shape[0]] = w
                ws.append(full.reshape(-1).tolist())
            out = pdf[by].copy()
            out["whiten"] = ws
            yield out

    return packed.mapInPandas(invert, schema + ", whiten ARRAY<DOUBLE>")


def add_coords(df: DataFrame, white: DataFrame, by: Sequence[str],
               covariates: Sequence[str]) -> DataFrame:
    """Whitened coordinates as an array column."""
    p = len(covariates)
    j = null_safe_join(df, small_side(white), list(by))
    x = [F.col(c).cast("double") for c in covariates]

    def axis(i: int) -> Column:
        out = F.lit(0.0)
        for k in range(p):
            out = out + F.col("whiten")[i * p + k] * x[k]
        return out

    return j.withColumn("coords", F.array(*[axis(i) for i in range(p)])).drop("whiten")


def rank_columns(df: DataFrame, by: Sequence[str],
                 covariates: Sequence[str]) -> DataFrame:
    """Average ranks within the level in place of the covariates."""
    base = df.withColumns({f"__val_{c}": F.col(c).cast("double") + F.lit(0.0)
                           for c in covariates})
    out = base
    for c in covariates:
        r = average_ranks(base, by, f"__val_{c}").select(
            *by, f"__val_{c}", F.col("rank").alias(f"__rank_{c}"))
        out = null_safe_join(out, r, [*by, f"__val_{c}"])
    return out.select(*[F.col(f"__rank_{c}").alias(c) if c in covariates else F.col(c)
                        for c in df.columns])


# -- matching -------------------------------------------------------------------------

def rank_match(df: DataFrame, cell: Sequence[str], key: str = "pixel_id") -> DataFrame:
    """Exact-only ablation: k-th treated with k-th control of each cell.

    Positions come from bucketed running counts, so a cell of any size works.
    """
    cell = list(cell)

    k = df.withColumn("__id", F.col(key).cast("long"))
    c = ordered_cumulative(k, cell, "__id", {
        "__nt": F.col("treat").cast("long"), "__nc": 1 - F.col("treat").cast("long")}, True)
    t = c.where("__nt > 0").select(*cell, F.col("__nt_before").alias("__pos"),
                                   F.col("__id").alias("treated_id"))
    u = c.where("__nc > 0").select(*cell, F.col("__nc_before").alias("__pos"),
                                   F.col("__id").alias("control_id"))
    return null_safe_join(t, u, [*cell, "__pos"]).drop("__pos")


def _greedy(tid, tprio, tx, ts, tv, cid, cx, cs, cv, cal, vcal):
    """One cell, one task: treated in priority order take the nearest free."""
    m = 1_000_003
    free = np.ones(len(cid), dtype=bool)
    rows = []
    for i in np.lexsort((tid, tprio)):
        d2 = np.zeros(len(cx))
        for k in range(cx.shape[1]):  # axis by axis, the order in which the rounds add up
            gap = cx[:, k] - tx[i, k]
            d2 += gap * gap
        d = np.sqrt(d2)
        ok = free.copy()
        if cal is not None:
            ok &= np.abs(cs - ts[i]) <= cal
        if vcal is not None:
            ok &= (np.abs(cv - tv[i]) <= vcal).all(axis=1)
        if not ok.any():
            continue
        best = np.flatnonzero(ok & (d == d[ok].min()))
        spread = (tid[i] % m * 7919 + cid[best] % m * 104_729) % m
        j = best[np.lexsort((cid[best], spread))[0]]
        free[j] = False
        rows.append((tid[i], cid[j], float(d[j])))
    return rows


def nearest_match(df: DataFrame, cell: Sequence[str], key: str = "pixel_id",
                  coords: str = "coords", priority: str | None = None,
                  score: str | None = None, caliper: str | None = None,
                  limits: Mapping[str, str] | None = None,
                  small_pairs: int = SMALL_PAIRS,
                  small_rows: int = SMALL_ROWS, report: dict | None = None) -> DataFrame:
    """Nearest one-to-one match without replacement inside exact cells.

    Treated units choose in order of ``priority`` (largest first, then id); each
    takes the nearest control still free. ``caliper`` names the column with the
    largest allowed gap in ``score``; ``limits`` maps covariates to the columns
    with theirs. Cells that lack a side fall out first, by a semi join.

    A cell within the counted limits is matched in one task. A larger cell is
    matched in rounds of proposals over the whole cluster: every unmatched
    treated unit proposes to the nearest control not held by a better one, and
    a control keeps its best proposer. That ends in the same matching as the
    one-by-one order, since controls share one priority; ties in distance are
    spread by a fixed mix of the two ids. A search goes through a tree of boxes, which
    bound the distance, the score and the limited covariates; ``report`` receives the
    number of pairs of large cells that were ``compared``.
    """
    cell = list(cell)
    limits = dict(limits or {})
    prio = -F.col(priority) if priority else F.lit(0.0)
    keep = df.select(
        *cell, F.col("treat").cast("int").alias("treat"),
        F.col(key).cast("long").alias("id"), F.col(coords).alias("x"),
        prio.cast("double").alias("prio"),
        (F.col(score) if score else F.lit(0.0)).cast("double").alias("s"),
        (F.col(caliper) if caliper else F.lit(None)).cast("double").alias("cal"),
        F.array(*[F.col(c).cast("double") for c in limits]).cast("array<double>")
        .alias("v"),
        F.array(*[F.col(c).cast("double") for c in limits.values()])
        .cast("array<double>").alias("vcal"))
    t = F.sum("treat")
    sizes = keep.groupBy(*cell).agg(
        t.alias("nt"), (F.count(F.lit(1)) - t).alias("nc")).where(
        "nt > 0 AND nc > 0").withColumn(
        "large", (F.col("nt").cast("double") * F.col("nc") > small_pairs)
        | (F.col("nt") + F.col("nc") > small_rows))
    sizes = cut_lineage(sizes)
    rows = null_safe_join(keep, sizes.select(*cell, "large"), cell)
    out_schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cell).schema
    ) + ", treated_id BIGINT, control_id BIGINT, distance DOUBLE"
    has_cal, has_lim = caliper is not None, bool(limits)

    def one_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["treat"] == 1], pdf[pdf["treat"] == 0]

        def mat(s):
            return np.array(s.tolist(), dtype=float).reshape(len(s), -1)

        got = _greedy(
            a["id"].to_numpy(), a["prio"].to_numpy(), mat(a["x"]),
            a["s"].to_numpy(), mat(a["v"]), b["id"].to_numpy(), mat(b["x"]),
            b["s"].to_numpy(), mat(b["v"]),
            float(pdf["cal"].iloc[0]) if has_cal else None,
            np.array(pdf["vcal"].iloc[0], dtype=float) if has_lim else None)
        out = pd.DataFrame(got, columns=["treated_id", "control_id", "distance"])
        for i, c in enumerate(cell):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    small = rows.where(~F.col("large")).drop("large").groupBy(*cell).applyInPandas(
        one_cell, out_schema)
    if sizes.where("large").isEmpty():
        return small
    # a struct matches null exact columns
    one = rows.where("large").withColumn("__cell", F.struct(*cell)).drop("large", *cell)
    names = cut_lineage(one.select("__cell").distinct().withColumn(
        "n", F.monotonically_increasing_id()))
    big = match_rounds(one.join(small_side(names), "__cell").drop("__cell"), has_cal, has_lim,
                       BUCKET, report)
    return small.unionByName(names.join(big, "n").select(
        "__cell.*", F.col("tid").alias("treated_id"), F.col("cid").alias("control_id"),
        F.col("dist").alias("distance")))


def matched_rows(df: DataFrame, pairs: DataFrame, cell: Sequence[str],
                 level: str, key: str = "pixel_id") -> DataFrame:
    """Both members of every pair with subclass, weight and distance."""
    cell = list(cell)
    sub = F.concat_ws(":", F.col(level).cast("string"), F.col("treated_id").cast("string"))
    p = pairs.withColumn("subclass", sub)
    long = p.select(*cell, "subclass", "distance", F.explode(F.array(
        F.struct(F.lit(1).alias("treat"), F.col("treated_id").alias(key)),
        F.struct(F.lit(0).alias("treat"), F.col("control_id").alias(key)))).alias("m")
    ).select(*cell, "subclass", "distance", "m.treat", f"m.{key}")
    return null_safe_join(df, long, [*cell, "treat", key]).withColumn("weights", F.lit(1.0))


def match_specs(df: DataFrame, matched: DataFrame, by: Sequence[str],
                flags: DataFrame | None = None) -> DataFrame:
    """Counts, dropped per side, rate and status per level and configuration.

    ``flags`` (by, converged, separated) come from the score: a level whose fit has no
    optimum to report is ``failed``, with the reason, and has no matched rows to count.
    """
    by = list(by)
    m = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.sum((F.col("treat") == 1).cast("long")).alias("mt"))
    j = null_safe_join(level_sizes(df, by), m, by, "left")
    why = F.lit(None).cast("string")
    if flags is not None:
        j = null_safe_join(j, flags, by, "left")
        why = F.when(F.col("separated"), "failed: sides are separated").when(
            ~F.col("converged"), "failed: no convergence")
    nm, mt = F.coalesce("n_matched", F.lit(0)), F.coalesce("mt", F.lit(0))
    none = (F.col("n_treat") == 0) | (F.col("n_control") == 0)
    ran = ~none & why.isNull()
    return j.select(
        *by, "n_input", "n_treat", "n_control", F.when(ran, nm).alias("n_matched"),
        F.when(ran & (F.col("n_treat") > 0), nm / 2.0 / F.col("n_treat")).alias("match_rate"),
        F.when(ran, F.col("n_treat") - mt).alias("dropped_treated"),
        F.when(ran, F.col("n_control") - (nm - mt)).alias("dropped_control"),
        F.when(none, "no units").otherwise(F.coalesce(why, F.lit("ok"))).alias("status"))


def control_reuse(matched: DataFrame, by: Sequence[str],
                  key: str = "pixel_id") -> DataFrame:
    """How often a control serves in several levels."""
    c = matched.where("treat = 0").groupBy(*by, key).agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy(*by).agg(
        F.sum("k").alias("n_control_rows"), F.count(F.lit(1)).alias("n_control_pixels"),
        F.max("k").alias("max_reuse")).withColumn(
        "control_reuse", F.round(F.col("n_control_rows") / F.col("n_control_pixels"), 4))

