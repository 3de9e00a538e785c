"""Treated and control rows to matched pairs and balance, for any configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators import matching as M
from panelspark.operators.balance import balance_table
from panelspark.operators.cleaning import complete_cases
from panelspark.operators.core import null_safe_join, small_side
from panelspark.operators.penalty import Path, chosen_fit, fit_scores
from panelspark.operators.trees import Boost, boosted_scores
from panelspark.session import cut_lineage


def fitted_score(df: DataFrame, level: str, covariates: Sequence[str], kind: str,
                 lam: float | None = None, key: str = "pixel_id", path: Path = Path(),
                 rule: str = "1se") -> DataFrame:
    """Coefficients and flags of the logistic or elastic-net score of every level.

    The elastic net takes the penalty that cross-validation chooses per level, unless
    ``lam`` states one for all.
    """
    if kind == "glm":
        return fit_scores(df, [level], covariates)
    if lam is None:
        return chosen_fit(df, [level], covariates, key, path, rule)
    return fit_scores(df, [level], covariates, path.alpha, lam)


def match_config(df: DataFrame, level: str, cell: Sequence[str],
                 covariates: Sequence[str], config: str,
                 caliper_sd: float = P.CALIPER_SD, fit: Mapping | None = None,
                 **sizes) -> DataFrame:
    """Matched rows of one configuration, all levels in one job.

    ``df`` holds the rows of every level (``treat``, exact columns, covariates). ``fit``
    goes to the score (penalty path and rule, shape of the trees). Levels whose fit has
    no optimum are left out; ``match_with_specs`` says which.
    """
    return _match(df, level, cell, covariates, config, caliper_sd, fit, sizes)[0]


def match_with_specs(df: DataFrame, level: str, cell: Sequence[str],
                     covariates: Sequence[str], config: str,
                     caliper_sd: float = P.CALIPER_SD, fit: Mapping | None = None,
                     **sizes) -> tuple[DataFrame, DataFrame]:
    """Matched rows, and per level their counts and status: ok, no units or failed."""
    matched, flags = _match(df, level, cell, covariates, config, caliper_sd, fit, sizes)
    whole = complete_cases(df, [*cell, *covariates])
    specs = M.match_specs(whole, matched, [level], flags).withColumn("config", F.lit(config))
    return matched, specs


def _match(df, level, cell, covariates, config, caliper_sd, fit, sizes):
    score, distance, caliper = P.CONFIGS[config]
    keys, flags = [level, *cell], None
    d = complete_cases(df, [*cell, *covariates])
    if distance == "rank":
        pairs = M.rank_match(d, keys).withColumn("distance", F.lit(0.0))
        rows = M.matched_rows(d, pairs, keys, level)
        return rows.withColumn("config", F.lit(config)), None
    # read many times from here on: written once to the shared folder
    d = base = cut_lineage(d)
    if score == "trees":
        d = boosted_scores(d, [level], covariates, **(fit or {}))
    elif score:
        made = fitted_score(d, level, covariates, score, **(fit or {}))
        flags = cut_lineage(made.select(level, "converged", "separated"))
        sound = made.where(F.col("converged") & ~F.col("separated"))
        d = M.linear_score(d, sound, [level], covariates)
    opts: dict = {"priority": "score" if score else None}
    if distance == "score":
        d = d.withColumn("coords", F.array("score"))
    elif distance == "robust":
        r = cut_lineage(M.rank_columns(d, [level], covariates))
        d = M.add_coords(r, M.whitening(r, [level], covariates, True), [level], covariates)
    else:
        d = M.add_coords(d, M.whitening(d, [level], covariates), [level], covariates)
    if caliper:
        cols = ["score"] if score else list(covariates)
        width = M.score_spread(d, [level], cols, caliper_sd)
        d = null_safe_join(d, small_side(width), [level])
        if score:
            opts.update(score="score", caliper="caliper_score")
        else:
            opts.update(limits={c: f"caliper_{c}" for c in cols})
    pairs = M.nearest_match(cut_lineage(d), keys, **opts, **sizes)
    rows = M.matched_rows(base, pairs, keys, level)
    return rows.withColumn("config", F.lit(config)), flags


def balance_before_after(df: DataFrame, matched: DataFrame, level: str,
                         covariates: Sequence[str]) -> DataFrame:
    """Unadjusted rows once per level, adjusted rows on the same scale."""
    un = balance_table(df, [level], covariates, "unadjusted")
    den = un.select(level, "covariate", F.col("sd_treat").alias("denom"))
    return un.unionByName(balance_table(matched, [level], covariates, "adjusted", den))
