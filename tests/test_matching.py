import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.operators import balance, matching as M, search
from panelspark.operators.penalty import fit_scores
from panelspark.plans.match import match_config
from panelspark.session import UNKNOWN_SIZE, cut_lineage


def make(rng, n=400, cells=2):
    cell = np.where(rng.random(n) < .8, "hot", "cold") if cells == 2 else "hot"
    return pd.DataFrame({"pixel_id": np.arange(n), "cell": cell, "lev": "w",
                         "treat": (rng.random(n) < .3).astype(int),
                         "a": rng.normal(size=n), "b": rng.normal(size=n)})


def brute(pdf, cal=None):
    out = {}
    for _, p in pdf.groupby("cell"):
        t, c = p[p.treat == 1].sort_values(["s", "pixel_id"], ascending=[False, True]), p[p.treat == 0]
        free = dict(zip(c.pixel_id, c[["a", "b", "s"]].to_numpy()))
        for r in t.itertuples():
            best = min(((np.hypot(x[0] - r.a, x[1] - r.b), k) for k, x in free.items()
                        if cal is None or abs(x[2] - r.s) <= cal), default=None)
            if best:
                out[r.pixel_id] = best[1]
                free.pop(best[1])
    return out


@pytest.mark.parametrize("small_pairs,cal", [(10**9, None), (0, None), (10**9, .5), (0, .5)])
def test_nearest_match_equals_one_by_one(spark, monkeypatch, small_pairs, cal):
    monkeypatch.setattr(M, "BUCKET", 8)
    pdf = make(np.random.default_rng(3))
    pdf["s"] = pdf.a * .5 + pdf.b
    df = spark.createDataFrame(pdf).withColumn("coords", F.array("a", "b")).withColumn(
        "cal", F.lit(cal).cast("double"))
    got = M.nearest_match(df, ["cell"], priority="s", small_pairs=small_pairs,
                          **({"score": "s", "caliper": "cal"} if cal else {}))
    have = {r.treated_id: r.control_id for r in got.collect()}
    assert have == brute(pdf, cal)


def test_copies_do_not_stall_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 8)
    pdf = make(np.random.default_rng(4), 300, 1)
    pdf.loc[pdf.index < 200, ["a", "b"]] = 1.0     # two thirds are copies
    df = spark.createDataFrame(pdf).withColumn("coords", F.array("a", "b"))
    got = M.nearest_match(df, ["cell"], small_pairs=0).toPandas()
    nt, nc = int(pdf.treat.sum()), int((1 - pdf.treat).sum())
    assert len(got) == min(nt, nc)
    assert got.control_id.is_unique and got.treated_id.is_unique


def test_scores_solve_the_likelihood(spark):
    rng = np.random.default_rng(5)
    pdf = make(rng, 2000)
    pdf["treat"] = (rng.random(2000) < 1 / (1 + np.exp(-(.5 * pdf.a - pdf.b)))).astype(int)
    df = spark.createDataFrame(pdf)
    s = M.linear_score(df, fit_scores(df, ["lev"], ["a", "b"]), ["lev"], ["a", "b"]).toPandas()
    x = np.column_stack([np.ones(2000), s.a, s.b])
    beta = np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T * (mu * (1 - mu)) @ x, x.T @ (s.treat - mu))
    assert np.allclose(s.score, x @ beta, atol=1e-6)
    lasso = fit_scores(df, ["lev"], ["a", "b"], alpha=1.0, lam=5.0).first()
    assert lasso.beta[1] == 0 and lasso.beta[2] == 0


def test_whitening_is_mahalanobis(spark):
    pdf = make(np.random.default_rng(6), 300)
    pdf["b"] = pdf.b * 3 + pdf.a
    df = spark.createDataFrame(pdf)
    w = M.add_coords(df, M.whitening(df, ["lev"], ["a", "b"]), ["lev"], ["a", "b"]).toPandas()
    z = np.array(w.coords.tolist())
    t = w.treat == 1
    cov = sum(np.cov(w.loc[m, ["a", "b"]].T) * (m.sum() - 1) for m in (t, ~t)) / (len(w) - 2)
    d = w[["a", "b"]].to_numpy()[0] - w[["a", "b"]].to_numpy()[1]
    assert np.sum((z[0] - z[1])**2) == pytest.approx(d @ np.linalg.inv(cov) @ d)


@pytest.mark.parametrize("config", ["nn_exact_1to1", "glm_cal025", "mahal_pscal", "rmahal_cal025",
                                    "elastic_nocal", "trees_cal025"])
def test_every_kind_of_configuration(spark, config):
    pdf = make(np.random.default_rng(7), 300)
    m = match_config(spark.createDataFrame(pdf), "lev", ["cell"], ["a", "b"], config).toPandas()
    assert len(m) and m.pixel_id.is_unique
    g = m.groupby("subclass")
    assert (g.size() == 2).all() and (g.treat.sum() == 1).all() and (g.cell.nunique() == 1).all()


def test_balance_against_numpy(spark):
    pdf = make(np.random.default_rng(8), 500)
    r = balance.balance_table(spark.createDataFrame(pdf), ["lev"], ["a"], "x").first()
    t, c = pdf.a[pdf.treat == 1], pdf.a[pdf.treat == 0]
    grid = np.unique(pdf.a)
    dd = np.abs(np.searchsorted(np.sort(t), grid, "right") / len(t)
                - np.searchsorted(np.sort(c), grid, "right") / len(c))
    assert r.smd == pytest.approx((t.mean() - c.mean()) / t.std())
    assert r.vr == pytest.approx(t.var() / c.var())
    assert (r.ecdf_mean, r.ecdf_max) == pytest.approx((dd.mean(), dd.max()))


@pytest.mark.parametrize("small_pairs", [10**9, 0])
def test_caliper_on_the_axis_ends_the_search(spark, monkeypatch, small_pairs):
    monkeypatch.setattr(M, "BUCKET", 8)
    rng = np.random.default_rng(8)
    n = 600
    s = np.where(np.arange(n) % 2, rng.normal(size=n), rng.normal(size=n) + 2)
    pdf = pd.DataFrame({"pixel_id": np.arange(n), "cell": "x", "treat": (np.arange(n) % 2 == 0).astype(int), "s": s})
    df = spark.createDataFrame(pdf).withColumn("coords", F.array("s")).withColumn("cal", F.lit(.02))
    got = {r.treated_id: r.control_id for r in M.nearest_match(
        df, ["cell"], priority="s", score="s", caliper="cal", small_pairs=small_pairs).collect()}
    free = dict(pdf[pdf.treat == 0][["pixel_id", "s"]].to_numpy())
    want = {}
    for r in pdf[pdf.treat == 1].sort_values(["s", "pixel_id"], ascending=[False, True]).itertuples():
        near = min(((abs(v - r.s), k) for k, v in free.items() if abs(v - r.s) <= .02), default=None)
        if near:
            want[r.pixel_id] = int(near[1])
            free.pop(near[1])
    assert got == want


def leaf(n_t, n_c, seed=0):
    rng = np.random.default_rng(seed)

    def lists(n, k):
        return pa.array(rng.integers(0, 9, (n, k)).astype(float).tolist(), pa.list_(pa.float64()))

    t = pa.table({"n": np.zeros(n_t, np.int64), "tid": rng.permutation(n_t), "prio": rng.normal(size=n_t),
                  "tx": lists(n_t, 3), "ts": rng.normal(size=n_t), "cal": np.full(n_t, 1.0),
                  "tv": lists(n_t, 1), "vcal": pa.array([[4.0]] * n_t, pa.list_(pa.float64()))})
    held = rng.random(n_c) < 0.5
    c = pa.table({"cid": rng.permutation(n_c) + n_t, "cx": lists(n_c, 3), "cs": rng.normal(size=n_c),
                  "cv": lists(n_c, 1), "hp": pa.array(rng.normal(size=n_c), mask=held),
                  "ht": pa.array(rng.integers(0, n_t, n_c), mask=held)})
    return t, c


def test_a_crowded_leaf_is_met_in_bounded_memory():
    t, c = leaf(4096, 4000)
    tracemalloc.start()
    search._meet(t, c, True, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # one matrix of all pairs takes 131 MB, and several are needed


@pytest.mark.parametrize("limits", [(False, False), (True, False), (False, True), (True, True)])
def test_slices_of_a_leaf_give_the_whole(limits, monkeypatch):
    t, c = leaf(120, 90)
    whole = search._meet(t, c, *limits)
    monkeypatch.setattr(search, "MATRIX", 700)
    assert whole.num_rows and search._meet(t, c, *limits).equals(whole)
    empty = search._meet(t, c.slice(0, 0), *limits)
    assert empty.num_rows == 0 and empty.schema == whole.schema


def test_estimates_do_not_grow_from_round_to_round(spark):
    d = cut_lineage(spark.range(10))
    for _ in range(7):
        d = cut_lineage(d.join(d.select("id"), "id"))
    assert int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= UNKNOWN_SIZE
    assert sorted(r.id for r in d.collect()) == list(range(10))


def test_units_wait_until_as_many_search_again(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 8)
    monkeypatch.setattr(search, "KEPT", 3)  # lists are soon used up
    pdf = make(np.random.default_rng(9), 160, 1)
    pdf["treat"] = (np.arange(160) % 5 < 2).astype(int)
    pdf["s"] = pdf.a
    df = spark.createDataFrame(pdf).withColumn("coords", F.array("a", "b"))
    searches, nearest = [], search.Search.nearest

    def counted(self, asked, *rest):
        searches.append(asked.count())
        return nearest(self, asked, *rest)

    monkeypatch.setattr(search.Search, "nearest", counted)
    got = M.nearest_match(df, ["cell"], priority="s", small_pairs=0)
    assert {r.treated_id: r.control_id for r in got.collect()} == brute(pdf)
    assert len(searches) > 1


@pytest.mark.parametrize("bucket,cal", [(64, None), (8, 2.0)])
def test_used_up_lists_are_not_the_end(spark, monkeypatch, bucket, cal):
    """More controls in reach than a list keeps, though every leaf has been read: one leaf, or
    several of which the nearest hold few in reach."""
    monkeypatch.setattr(M, "BUCKET", bucket)
    pdf = make(np.random.default_rng(10), 120, 1)
    pdf["treat"] = (np.arange(120) % 5 < 3).astype(int)
    pdf["s"] = np.random.default_rng(11).normal(size=120)
    df = spark.createDataFrame(pdf).withColumn("coords", F.array("a", "b")).withColumn(
        "cal", F.lit(cal).cast("double"))
    got = M.nearest_match(df, ["cell"], priority="s", small_pairs=0,
                          **({"score": "s", "caliper": "cal"} if cal else {}))
    assert {r.treated_id: r.control_id for r in got.collect()} == brute(pdf, cal)
