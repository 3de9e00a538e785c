"""Penalty paths and boosted trees against brute force."""

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import matching as M
from panelspark.operators import penalty as L
from panelspark.operators import trees as T
from panelspark.plans.match import match_with_specs


def make(seed, n=900):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=list("abcd"))
    pdf["d"] = 1.0  # no variance
    pdf["b"] = pdf.b * 30 + pdf.a
    eta = pdf.a - 0.02 * pdf.b - 1
    pdf["treat"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    pdf["pixel_id"] = np.arange(n)
    pdf["lev"] = np.where(rng.random(n) < .75, "big", None)  # a null level is a level
    pdf["cell"] = "x"
    return pdf


def test_path_meets_the_optimality_conditions(spark):
    path = L.Path(steps=6, ratio=0.01, folds=3)
    pdf = make(1)
    got = L.penalty_path(spark.createDataFrame(pdf), ["lev"], list("abcd"), "pixel_id", path).toPandas()
    assert len(got) == 2 * 6 * 4 and got.converged.all()
    import hashlib
    fold = np.array([int(hashlib.md5(f"{path.seed}:{i}".encode()).hexdigest()[:8], 16) % 3 for i in pdf.pixel_id])
    for r in got.itertuples():
        mine = pdf.lev.isna() if r.lev is None else pdf.lev == r.lev
        x, y, f = pdf.loc[mine, list("abcd")].to_numpy(), pdf.treat[mine].to_numpy(), fold[mine]
        sd = x.std(axis=0)
        z = np.column_stack([np.ones(len(x)), np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)])
        b, train = np.array(r.beta), f != r.fold
        score = z[train].T @ (y[train] - 1 / (1 + np.exp(-z[train] @ b))) / train.sum()
        assert abs(score[0]) < 1e-7
        pull = score[1:] - r.lam * 0.5 * b[1:]
        on = b[1:] != 0
        assert np.allclose(pull[on], r.lam * 0.5 * np.sign(b[1:][on]), atol=1e-7)
        assert (np.abs(pull[~on]) <= r.lam * 0.5 + 1e-7).all()
        if r.fold >= 0:
            eta = z[~train] @ b
            loss = np.logaddexp(0, eta) - y[~train] * eta
            assert r.n_held == (~train).sum() and r.log_loss == pytest.approx(loss.mean())
    first = got[got.k == 0]
    assert all(np.all(np.array(b)[1:] == 0) for b in first[first.fold == -1].beta)
    picks = {rule: L.choose_penalty(spark.createDataFrame(got), ["lev"], rule).toPandas() for rule in ("min", "1se")}
    held = got[got.fold >= 0].assign(w=lambda d: d.n_held * d.log_loss)
    for lev, g in held.groupby(held.lev.fillna("-")):
        mean = g.groupby("k").w.sum() / g.groupby("k").n_held.sum()
        at = {k: v[v.lev.fillna("-") == lev].iloc[0] for k, v in picks.items()}
        assert at["min"].k == mean.idxmin() and at["min"].log_loss == pytest.approx(mean.min())
        assert at["1se"].k == mean[mean <= mean.min() + at["min"].loss_error].index.min()


def test_chosen_fit_is_the_fit_at_that_penalty(spark):
    path = L.Path(steps=5, folds=3)
    df = spark.createDataFrame(make(2))
    got = L.chosen_fit(df, ["lev"], list("ab"), "pixel_id", path).toPandas()
    whole = L.penalty_path(df, ["lev"], list("ab"), "pixel_id", path)
    pick = {r.lev: r.lam for r in L.choose_penalty(whole, ["lev"]).collect()}
    for r in got.itertuples():
        plain = L.fit_scores(df, ["lev"], list("ab"), path.alpha, pick[r.lev]).collect()
        mine = next(x for x in plain if x.lev == r.lev)
        assert np.allclose(r.beta, mine.beta, atol=1e-6)


def test_rows_without_a_covariate_are_left_out(spark):
    pdf = make(5, 300)
    whole = L.fit_scores(spark.createDataFrame(pdf), ["lev"], ["a", "b"]).collect()
    holes = spark.createDataFrame(pdf).union(spark.createDataFrame(
        [(None, 1.0, 0.0, 1.0, 1, 900 + i, "big", "x") for i in range(9)], spark.createDataFrame(pdf).schema))
    got = L.fit_scores(holes, ["lev"], ["a"], alpha=0.5, lam=0.01).collect()
    assert len(whole) == len(got) == 2 and all(np.isfinite(r.beta).all() and r.converged for r in got)


def test_separated_level_fails_and_the_others_match(spark):
    pdf = make(3, 400)
    pdf.loc[pdf.lev.isna(), "a"] = pdf.treat * 10.0 + pdf.b * 1e-4
    pdf["lev"] = pdf.lev.fillna("apart")
    alone = pdf.head(20).assign(lev="alone", treat=1, pixel_id=np.arange(1000, 1020))
    df = spark.createDataFrame(pd.concat([pdf, alone]))
    matched, specs = match_with_specs(df, "lev", ["cell"], ["a", "b"], "glm_nocal")
    by = {r.lev: r for r in specs.collect()}
    assert by["big"].status == "ok" and by["big"].n_matched == 2 * by["big"].n_treat
    assert by["apart"].status.startswith("failed") and by["apart"].n_matched is None
    assert by["alone"].status == "no units" and by["alone"].n_control == 0
    assert {r.lev for r in matched.select("lev").distinct().collect()} == {"big"}


def brute_tree(bins, g, h, boost, depth):
    """Leaf value of every row by plain recursion."""
    if depth:
        best, at = 0.0, None
        for f in range(bins.shape[1]):
            for b in range(boost.bins):
                left = bins[:, f] <= b
                if min(left.sum(), (~left).sum()) < boost.keep:
                    continue
                worth = [g[m].sum() ** 2 / (h[m].sum() + boost.ridge) for m in (left, ~left, left | True)]
                gain = round(worth[0] + worth[1] - worth[2], 9)
                if gain > best:
                    best, at = gain, left
        if at is not None:
            out = np.empty(len(g))
            for m in (at, ~at):
                out[m] = brute_tree(bins[m], g[m], h[m], boost, depth - 1)
            return out
    return np.full(len(g), g.sum() / (h.sum() + boost.ridge))


@pytest.mark.parametrize("boost", [T.Boost(trees=3, depth=3, bins=8, rate=0.5), T.Boost(trees=1, depth=1, bins=4)])
def test_trees_equal_plain_recursion(spark, monkeypatch, boost):
    pdf = make(4)
    pdf.loc[::17, "c"] = np.nan
    pdf["c"] = pdf.c.round(0)
    passes = []
    real = T._histograms
    monkeypatch.setattr(T, "_histograms", lambda *a: passes.append(1) or real(*a))
    df = spark.createDataFrame(pdf.astype({"c": object}).where(pdf.notna(), None), schema=(
        "a double, b double, c double, d double, treat long, pixel_id long, lev string, cell string"))
    got = T.boosted_scores(df, ["lev"], list("abcd"), boost).toPandas().set_index("pixel_id").score
    assert len(passes) == boost.trees * boost.depth  # one job per depth for all levels
    for lev, rows in pdf.groupby(pdf.lev.fillna("-")):
        cols = []
        for c in "abcd":
            v = np.sort(rows[c].dropna())
            cut = np.unique([v[max(int(np.ceil(len(v) * i / boost.bins - 1e-9)) - 1, 0)] for i in range(1, boost.bins)])
            cols.append(np.where(rows[c].isna(), 0, np.searchsorted(cut, rows[c], "left")))
        bins, y = np.column_stack(cols), rows.treat.to_numpy()
        score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        for _ in range(boost.trees):
            mu = 1 / (1 + np.exp(-score))
            score = score + boost.rate * brute_tree(bins, y - mu, mu * (1 - mu), boost, boost.depth)
        assert np.allclose(got.loc[rows.pixel_id], score)
