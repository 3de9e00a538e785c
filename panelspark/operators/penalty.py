"""Elastic-net treatment scores along a path of penalties, chosen by cross-validation.

Fits are keyed by (level, penalty, held-out fold), a last fold -1 holding nothing out.
All of them advance together: a round is one pass over the rows, in which a task adds up
the weighted cross products of every open fit for its rows, and one coordinate descent on
the summed quadratics. The first descent goes down the path and starts each penalty from
the one before; later rounds start from the fit itself. Fits that stand still are left
out of the next pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.functions.numeric import seeded_order
from panelspark.operators.core import null_safe_join, small_side
from panelspark.session import cut_lineage

LIMIT = 30.0        # coefficients end here; a level that reaches it is separated
ABOVE = 1.000001    # so that the first penalty leaves no coefficient but for rounding
SLICE = 8192        # rows taken together in a task
MAX_FITS = 500_000  # fits that the driver holds: levels x penalties x (folds + 1)


@dataclass(frozen=True)
class Path:
    """How the path is laid out: ``lam_max`` * ``ratio`` ** (k / (steps - 1))."""

    steps: int = 20
    ratio: float = 1e-3
    alpha: float = 0.5
    folds: int = 5
    seed: int = P.SEED
    rounds: int = 25
    tol: float = 1e-8


def level_table(df: DataFrame, by: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """Number, size, means, deviations and treatment covariances of every level."""
    x, t = [F.col(c).cast("double") for c in covariates], F.col("treat").cast("double")
    sd = [F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in x]
    st = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("share"),
        F.array(*[F.avg(c) for c in x]).alias("mu"), F.array(*sd).alias("sd"),
        F.array(*[F.when(s > 0, F.abs(F.covar_pop(c, t)) / s).otherwise(0.0)
                  for c, s in zip(x, sd)]).alias("__pull"))
    st = st.withColumn("pull", F.array_max("__pull")).drop("__pull")
    return cut_lineage(st.withColumn("__lev", F.monotonically_increasing_id()))


def scaled_rows(df: DataFrame, levels: DataFrame, by: Sequence[str], covariates: Sequence[str],
                key: str | None, path: Path) -> DataFrame:
    """(lev, fold, y, z): rows on the scale of their level, fold by a digest of the id.

    Rows that lack a covariate are left out.
    """
    df, fold = df.dropna(subset=[*covariates, "treat"]), F.lit(0)
    if path.folds:
        digest = seeded_order(F.col(key), path.seed)
        fold = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(path.folds))
    j = null_safe_join(df, small_side(levels.select(*by, "__lev", "mu", "sd")), list(by))
    z = [F.when(F.col("sd")[i] > 0, (F.col(c).cast("double") - F.col("mu")[i]) / F.col("sd")[i])
         .otherwise(0.0) for i, c in enumerate(covariates)]
    return cut_lineage(j.select("__lev", fold.cast("int").alias("fold"),
                                F.col("treat").cast("double").alias("y"),
                                F.array(F.lit(1.0), *z).alias("z")))


def _by_level(batches):
    """(level, fold, y, z) of slices of the batches, each of one level."""
    for b in batches:
        if not b.num_rows:
            continue
        lev, fold, y = (b.column(i).to_numpy() for i in range(3))
        z = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
        order = np.argsort(lev, kind="stable")
        cuts = np.flatnonzero(np.diff(lev[order])) + 1
        for part in np.split(order, cuts):
            for at in range(0, len(part), SLICE):
                i = part[at:at + SLICE]
                yield int(lev[i[0]]), fold[i], y[i], z[i]


def _sigmoid(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums per level of the arrays ``s``, element by element and map-side first."""
    rows = (parts.select("__lev", F.posexplode("s")).groupBy("__lev", "pos")
            .agg(F.sum("col").alias("v")).toArrow())  # bounded by fits x covariates^2
    lev, pos, v = (rows.column(c).to_numpy() for c in ("__lev", "pos", "v"))
    out = {}
    for k in np.unique(lev):
        mine = lev == k
        out[int(k)] = np.zeros(int(mine.sum()))
        out[int(k)][pos[mine]] = v[mine]
    return out


def _cross_products(rows: DataFrame, fits: dict[int, tuple[np.ndarray, np.ndarray]]
                    ) -> dict[int, np.ndarray]:
    """Per level, for its fits (beta, held-out fold): score sums, then weighted products."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for lev, fold, y, z in _by_level(batches):
            if lev not in sent.value:
                continue
            beta, held = sent.value[lev]
            mu = _sigmoid(z @ beta.T)
            used = fold[:, None] != held[None, :]
            i, j = np.triu_indices(z.shape[1])
            s = np.concatenate(((z.T @ ((y[:, None] - mu) * used)).ravel(),
                                ((z[:, i] * z[:, j]).T @ (mu * (1 - mu) * used)).ravel(),
                                used.sum(axis=0)))
            total[lev] = total.get(lev, 0.0) + s
        for lev, s in total.items():
            yield pa.record_batch({"__lev": pa.array([lev], pa.int64()),
                                   "s": pa.array([s], pa.list_(pa.float64()))})

    got = _added(rows.mapInArrow(run, "__lev long, s array<double>"))
    sent.destroy()
    return got


def descend(h: np.ndarray, target: np.ndarray, start: np.ndarray, n: np.ndarray,
            lam: np.ndarray, alpha: float) -> np.ndarray:
    """Coordinate descent on b'hb/2 - target'b + n lam (alpha |b| + (1 - alpha) b^2 / 2).

    Problems are rows and advance together; the first coefficient is free. ``n`` scales
    the penalty to sums over rows.
    """
    b = start.copy()
    diagonal = np.einsum("mjj->mj", h)
    for _ in range(5000):
        old = b.copy()
        for j in range(b.shape[1]):
            r = target[:, j] - np.einsum("mk,mk->m", h[:, j], b) + diagonal[:, j] * b[:, j]
            if j:
                r = np.sign(r) * np.maximum(np.abs(r) - n * lam * alpha, 0.0)
            den = diagonal[:, j] + (n * lam * (1 - alpha) if j else 0.0)
            b[:, j] = np.where(den > 0, r / np.where(den > 0, den, 1.0), 0.0)
        if np.abs(b - old).max(initial=0.0) < 1e-11:
            break
    return b


def _next_fits(sums: np.ndarray, beta: np.ndarray, lam: np.ndarray, alpha: float,
               order: list[np.ndarray] | None) -> np.ndarray:
    """Minima of the quadratics at ``beta``; ``order`` lists fits step by step of the path."""
    m, p = beta.shape
    g = sums[:m * p].reshape(p, m).T
    i, j = np.triu_indices(p)
    h = np.zeros((m, p, p))
    h[:, i, j] = h[:, j, i] = sums[m * p:m * (p + len(i))].reshape(len(i), m).T
    n = sums[m * (p + len(i)):]
    target = np.einsum("mjk,mk->mj", h, beta) + g
    if not lam.any():
        new = beta + np.einsum("mjk,mk->mj", np.linalg.pinv(h, hermitian=True), g)
    elif order is None:
        new = descend(h, target, beta, n, lam, alpha)
    else:
        new, start = beta.copy(), None
        for step in order:  # down the path, from the solution of the penalty before
            first = beta[step] if start is None else start
            start = new[step] = descend(h[step], target[step], first, n[step], lam[step], alpha)
    return np.clip(new, -LIMIT, LIMIT)


def fit_path(rows: DataFrame, levels: list, p: int, path: Path,
             lam: float | None = None) -> list[dict]:
    """One dict per fit: lev, k, lam, fold, beta, converged.

    ``lam`` sets the penalty in place of the path's; without one a step is Newton's.
    """
    held = np.arange(-1, path.folds)
    fits, lams = {}, {}
    k = np.repeat(np.arange(path.steps), len(held))
    if len(levels) * len(k) > MAX_FITS:
        raise ValueError(f"{len(levels)} levels x {len(k)} fits; {MAX_FITS} at most")
    for r in levels:
        top = max(ABOVE * r["pull"] / max(path.alpha, 1e-3), 1e-12)
        lams[r["__lev"]] = (top * path.ratio ** (k / max(path.steps - 1, 1)) if lam is None
                            else np.full(len(k), float(lam)))
        share = min(max(r["share"], 1e-6), 1 - 1e-6)
        beta = np.zeros((len(k), p + 1))
        beta[:, 0] = np.log(share / (1 - share))
        fits[r["__lev"]] = beta
    fold = np.tile(held, path.steps)
    steps = [np.flatnonzero(k == s) for s in range(path.steps)]
    live = {lev: np.ones(len(k), bool) for lev in fits}
    for turn in range(path.rounds):
        ask = {lev: (fits[lev][on], fold[on]) for lev, on in live.items() if on.any()}
        if not ask:
            break
        sums = _cross_products(rows, ask)
        for lev, (beta, _) in ask.items():
            on = np.flatnonzero(live[lev])
            new = _next_fits(sums[lev], beta, lams[lev][on], path.alpha, None if turn else steps)
            live[lev][on] = np.abs(new - beta).max(axis=1) >= path.tol
            fits[lev][on] = new
    return [{"__lev": lev, "k": int(k[i]), "lam": float(lams[lev][i]), "fold": int(fold[i]),
             "beta": fits[lev][i].tolist(), "converged": not bool(live[lev][i])}
            for lev in fits for i in range(len(k))]


def held_out_loss(rows: DataFrame, fits: list[dict], path: Path) -> DataFrame:
    """(lev, k, fold, n_held, log_loss): log loss of each fit on the fold it has not seen."""
    table: dict[int, np.ndarray] = {}
    for f in fits:
        if f["fold"] >= 0:
            b = table.setdefault(f["__lev"], np.zeros((path.folds, path.steps, len(f["beta"]))))
            b[f["fold"], f["k"]] = f["beta"]
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for lev, fold, y, z in _by_level(batches):
            for f in np.unique(fold):
                mine = fold == f
                eta = z[mine] @ sent.value[lev][f].T
                loss = np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0) - y[mine, None] * eta
                s = np.append(loss.sum(axis=0), mine.sum())
                total[lev, int(f)] = total.get((lev, int(f)), 0.0) + s
        for (lev, f), s in total.items():
            steps = len(s) - 1
            yield pa.record_batch({
                "__lev": np.full(steps, lev, np.int64), "fold": np.full(steps, f, np.int32),
                "k": np.arange(steps, dtype=np.int32), "n": np.full(steps, int(s[-1]), np.int64),
                "loss": s[:-1]})

    part = rows.mapInArrow(run, "__lev long, fold int, k int, n long, loss double")
    return part.groupBy("__lev", "k", "fold").agg(
        F.sum("n").alias("n_held"), (F.sum("loss") / F.sum("n")).alias("log_loss"))


def fit_scores(df: DataFrame, by: Sequence[str], covariates: Sequence[str], alpha: float = 0.0,
               lam: float = 0.0, rounds: int = 25, tol: float = 1e-8) -> DataFrame:
    """(by, mu, sd, beta, converged, separated): logistic coefficients of every level.

    One pass over the rows per round for all levels that still move. Covariates are
    standardised within the level; with ``lam`` the penalty is elastic net and the
    intercept is free. ``converged`` is false where the last step was above ``tol``,
    ``separated`` true where a coefficient stands at the limit of 30: such a level has no
    likelihood optimum to report.
    """
    by, spark = list(by), df.sparkSession
    path = Path(steps=1, alpha=alpha, folds=0, rounds=rounds, tol=tol)
    table = level_table(df, by, covariates)
    levels = table.select("__lev", "share", "pull").collect()
    fits = fit_path(scaled_rows(df, table, by, covariates, None, path), levels,
                    len(covariates), path, lam)
    made = spark.createDataFrame(pa.table({
        "__lev": pa.array([f["__lev"] for f in fits], pa.int64()),
        "beta": pa.array([f["beta"] for f in fits], pa.list_(pa.float64())),
        "converged": pa.array([f["converged"] for f in fits], pa.bool_())}))
    return cut_lineage(table.select(*by, "__lev", "mu", "sd").join(made, "__lev").drop("__lev")
                       .withColumn("separated", _at_limit()))


def _at_limit():
    return F.exists("beta", lambda b: F.abs(b) >= LIMIT)


def penalty_path(df: DataFrame, by: Sequence[str], covariates: Sequence[str], key: str,
                 path: Path = Path()) -> DataFrame:
    """Every fit of the path: (by, k, lam, fold, beta, converged, mu, sd, n_held, log_loss).

    Fold -1 holds the fit on all rows; the others carry the log loss on the rows of their
    fold (a digest of ``key``), null for a fold without rows. Covariates are standardised
    within the level, null covariates must be gone. Penalties fall from the smallest that
    leaves only the intercept. Levels are a small table: their number times penalties and
    folds is limited, and checked.
    """
    by, spark = list(by), df.sparkSession
    table = level_table(df, by, covariates)
    levels = table.select("__lev", "share", "pull").collect()
    rows = scaled_rows(df, table, by, covariates, key, path)
    fits = fit_path(rows, levels, len(covariates), path)
    made = spark.createDataFrame(pa.table({
        "__lev": pa.array([f["__lev"] for f in fits], pa.int64()),
        "k": pa.array([f["k"] for f in fits], pa.int32()),
        "lam": pa.array([f["lam"] for f in fits], pa.float64()),
        "fold": pa.array([f["fold"] for f in fits], pa.int32()),
        "beta": pa.array([f["beta"] for f in fits], pa.list_(pa.float64())),
        "converged": pa.array([f["converged"] for f in fits], pa.bool_())}))
    loss = held_out_loss(rows, fits, path)
    j = made.join(loss, ["__lev", "k", "fold"], "left")
    return cut_lineage(table.select(*by, "__lev", "mu", "sd").join(j, "__lev").drop("__lev"))


def choose_penalty(path: DataFrame, by: Sequence[str], rule: str = "1se") -> DataFrame:
    """(by, k, lam, log_loss, loss_error): the penalty of every level.

    ``min`` takes the smallest mean held-out loss (ties: the larger penalty), ``1se`` the
    largest penalty within one standard error of it, over folds.
    """
    if rule not in ("min", "1se"):
        raise ValueError(f"no such rule: {rule}")
    by = list(by)
    held = path.where("fold >= 0 AND n_held > 0")
    mean = F.sum(F.col("n_held") * F.col("log_loss")) / F.sum("n_held")
    square = F.sum(F.col("n_held") * F.col("log_loss") ** 2) / F.sum("n_held")
    each = held.groupBy(*by, "k", "lam").agg(
        mean.alias("log_loss"),
        F.when(F.count(F.lit(1)) > 1, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))
                                             / (F.count(F.lit(1)) - 1)))
        .otherwise(0.0).alias("loss_error"))
    best = each.groupBy(*by).agg(F.min(F.struct("log_loss", "k", "loss_error")).alias("__b"))
    reach = F.col("__b.log_loss") + (F.col("__b.loss_error") if rule == "1se" else F.lit(0.0))
    ok = null_safe_join(each, best.select(*by, reach.alias("__reach"), "__b"), by)
    ok = ok.where(F.col("log_loss") <= F.col("__reach") if rule == "1se"
                  else F.col("k") == F.col("__b.k"))
    return ok.groupBy(*by).agg(F.min(F.struct("k", "lam", "log_loss", "loss_error")).alias("__c")
                               ).select(*by, "__c.*")


def chosen_fit(df: DataFrame, by: Sequence[str], covariates: Sequence[str], key: str,
               path: Path = Path(), rule: str = "1se") -> DataFrame:
    """Coefficients on all rows at the chosen penalty, as ``fit_scores`` returns them."""
    by = list(by)
    made = penalty_path(df, by, covariates, key, path)
    pick = choose_penalty(made, by, rule).select(*by, "k")
    whole = null_safe_join(made.where("fold = -1"), pick, [*by, "k"])
    return whole.select(*by, "mu", "sd", "beta", "converged", _at_limit().alias("separated"))

