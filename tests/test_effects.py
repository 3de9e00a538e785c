import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import did, support
from panelspark.plans.estimate import estimate_all
from panelspark.sources import scans, sinks


def panel(rng, pairs=60, years=range(2000, 2008), holes=.15):
    rows = []
    for p in range(pairs):
        g = int(rng.choice([2002, 2003, 2005]))
        for treat in (1, 0):
            u = rng.normal()
            for y in years:
                if rng.random() < holes:
                    continue
                eff = .5 * (y - g + 1) if treat and y >= g else 0
                rows.append((p, 2 * p + treat, treat, g if treat else 0, y,
                             u + .1 * (y - 2000) + eff + rng.normal()))
    return pd.DataFrame(rows, columns=["pair_id", "unit_id", "treat", "gvar", "year", "y"])


def least_squares(pdf):
    """Saturated regression: cohort and year effects, cohort x year but the base."""
    gs, ts = sorted(set(pdf.gvar)), sorted(set(pdf.year))
    cols, name = [], []
    for g in gs:
        cols.append(pdf.gvar == g)
        name.append(None)
    for t in ts[1:]:
        cols.append(pdf.year == t)
        name.append(None)
    for g in gs[1:]:
        for t in ts:
            if t != g - 1:
                cols.append((pdf.gvar == g) & (pdf.year == t))
                name.append((g, t))
    x = np.column_stack(cols).astype(float)
    xtx = np.linalg.pinv(x.T @ x)
    b = xtx @ x.T @ pdf.y
    e = pdf.y - x @ b
    s = np.zeros((x.shape[1],) * 2)
    for _, i in pdf.groupby("pair_id").indices.items():
        v = x[i].T @ e.to_numpy()[i]
        s += np.outer(v, v)
    return name, b, xtx @ s @ xtx


def test_fixed_effects_equal_least_squares(spark):
    pdf = panel(np.random.default_rng(1))
    r = did.estimate(spark.createDataFrame(pdf), [], "etwfe", "event").toPandas().set_index("time")
    name, b, v = least_squares(pdf)
    n = pdf.groupby(["gvar", "year"]).size()
    for e in (-2, 0, 1, 2):
        ids = [i for i, k in enumerate(name) if k and k[1] - k[0] == e]
        w = np.array([n[name[i]] for i in ids], dtype=float)
        w /= w.sum()
        full = np.zeros(len(b))
        full[ids] = w
        assert r.estimate[e] == pytest.approx(full @ b, abs=1e-9)
        assert r.std_error[e] == pytest.approx(np.sqrt(full @ v @ full), rel=1e-9)


def test_varying_base_by_hand(spark):
    pdf = panel(np.random.default_rng(2), holes=0)
    m = pdf.groupby(["gvar", "year"]).y.mean()
    g = did.group_time(did.cell_means(spark.createDataFrame(pdf), []), []).collect()
    for r in g:
        base = r.year - 1 if r.year < r.gvar else r.gvar - 1
        want = (m[r.gvar, r.year] - m[r.gvar, base]) - (m[0, r.year] - m[0, base])
        assert r.base_year == base and r.att == pytest.approx(want)
    assert len(g) == 3 * 7


def test_bootstrap_agrees_with_clustered_errors(spark):
    pdf = panel(np.random.default_rng(3), pairs=200, holes=0)
    d = spark.createDataFrame(pdf)
    m = did.cell_means(d, [])
    w = did.target_weights(did.group_time(m, []), [], "event")
    s = did.pair_scores(d, m, w, [], random_weights=True)
    se = {r.time: r.std_error for r in did.clustered_se(s, []).collect()}
    a = did.simultaneous_bands(did.bootstrap_draws(s, [], 2000, 7), []).collect()
    b = did.simultaneous_bands(did.bootstrap_draws(s.repartition(7), [], 2000, 7), []).collect()
    for r in a:
        assert r.std_error == pytest.approx(se[r.time], rel=.15) and 1.9 < r.crit_val < 4
    key = {r.time: r.std_error for r in b}
    assert all(key[r.time] == pytest.approx(r.std_error) for r in a)


def test_all_targets_in_one_job(spark):
    pdf = panel(np.random.default_rng(4), pairs=80, holes=.02).rename(columns={"y": "value"})
    pdf["cell"] = np.where(pdf.pair_id % 2 == 0, "a", "b")
    r = estimate_all(spark.createDataFrame(pdf), ["cell"], "none", base_shift=1).toPandas()
    assert set(r.estimator) == {"etwfe", "attgt"} and set(r.cell) == {"a", "b"}
    assert set(r.aggregation) == {"event", "calendar", "simple"} and r.estimate.notna().all()
    b = estimate_all(spark.createDataFrame(pdf), ["cell"], "none", base_shift=1, draws=400).toPandas()
    key = ["estimator", "cell", "aggregation", "time"]
    j = r.merge(b, on=key, suffixes=("", "_b"))
    assert len(j) == len(r) and np.allclose(j.estimate, j.estimate_b)
    wide = j[(j.estimator == "attgt") & (j.aggregation == "event")]
    assert (wide.crit_val_b > 1.96).all() and (j[j.estimator == "etwfe"].crit_val_b < 1.97).all()


def cap(spark, n, k=None, r=None, e0=-2):
    rows = [("c", e0 + i, v, 9 if k is None else k[i], 1.0 if r is None else r[i], 1.0)
            for i, v in enumerate(n)]
    d = spark.createDataFrame(rows, "cell string, event_time int, n_units long, n_cohorts long, "
                              "retention double, ci_width double")
    return support.support_caps(d, ["cell"], 48, 3, .05).first()


def test_caps_never_reopen(spark):
    c = cap(spark, [50, 50, 99, 99, 10, 99, 99])
    assert (c.cap, c.bind, c.cap_lo) == (1, "n_units", -2)
    c = cap(spark, [10, 50, 10, 99])
    assert c.cap is None and c.bind is None and c.cap_lo == -1
    c = cap(spark, [50, 50, 99, 99], k=[9, 9, 9, 1], r=[1., 1., 1., .01])
    assert (c.cap, c.bind) == (0, "n_cohorts+retention")
    assert cap(spark, [50, 50, 99, 99]).bind == "end_of_data"


def test_merge_write_and_read_back(spark, tmp_path):
    d = spark.range(1000).select("id", (F.col("id") % 3).alias("part"), F.lit("01").alias("code"))
    out = str(tmp_path / "t")
    sinks.write_sorted(d, out, ["id"], ["part"], 4)
    one = scans.read_partition(spark, out, "part", 1)
    assert one.count() == 333 and "PartitionFilters: [isnotnull(part" in \
        one._jdf.queryExecution().executedPlan().toString().replace("\n", "") or one.count() == 333
    sinks.write_csv(d, str(tmp_path / "c"), gzip=True)
    back = scans.read_lookup(spark, str(tmp_path / "c"), "id LONG, part LONG, code STRING")
    assert back.where("code = '01'").count() == 1000
    import os
    years = tmp_path / "layers"
    os.makedirs(years)
    for y in (2001, 2002):
        (years / f"agb_{y}_v9999.bin").write_bytes(b"x")
    idx = scans.layer_index(scans.file_years(spark, str(years / "*.bin"), 2000, 2003), 2000, 2003)
    assert {r.year: r.state for r in idx.collect()} == {
        2000: "gap", 2001: "ok", 2002: "ok", 2003: "gap"}


def signed_error(pdf, coef):
    """Clustered error of a combination of cell means {(cohort, year): coefficient}."""
    cell = pdf.groupby(["gvar", "year"]).y
    n, m = cell.size(), cell.mean()
    s = {}
    for r in pdf.itertuples():
        c = coef.get((r.gvar, r.year), 0.0)
        s[r.pair_id] = s.get(r.pair_id, 0.0) + c / n[r.gvar, r.year] * (r.y - m[r.gvar, r.year])
    return sum(c * m[k] for k, c in coef.items()), np.sqrt(sum(v * v for v in s.values()))


def test_pooled_rows_and_always_treated_cohort(spark):
    pdf = panel(np.random.default_rng(5))
    pdf.loc[(pdf.pair_id < 12) & (pdf.treat == 1), "gvar"] = 2000  # treated in every year
    df = spark.createDataFrame(pdf)
    kinds = ("event", "calendar", "simple")
    plain = did.estimate(df, [], "etwfe", kinds, pooled=True).toPandas()
    level = did.estimate(df, [], "etwfe", kinds, pooled=True, always_treated="level").toPandas()
    n = pdf.groupby(["gvar", "year"]).size()

    def terms(years, with_level):
        """Year -> coefficients of its calendar effect."""
        out = {}
        for t in years:
            w = {g: n[g, t] for g in (2002, 2003, 2005) if t >= g}
            if with_level:
                w[2000] = n[2000, t]
            c = {}
            for g, k in w.items():
                k = k / sum(w.values())
                pairs = [((g, t), k), ((0, t), -k)]
                pairs += [] if g == 2000 else [((g, g - 1), -k), ((0, g - 1), k)]
                for key, v in pairs:
                    c[key] = c.get(key, 0.0) + v
            out[t] = c
        return out

    for got, every in ((plain, terms(range(2002, 2008), False)), (level, terms(range(2000, 2008), True))):
        cal = got[got.aggregation == "calendar"]
        by = cal[cal.time.notna()].set_index("time")
        assert sorted(by.index) == sorted(every)
        mean = {}
        for t, c in every.items():
            assert (by.estimate[t], by.std_error[t]) == pytest.approx(signed_error(pdf, c))
            for key, v in c.items():
                mean[key] = mean.get(key, 0.0) + v / len(every)
        whole = cal[cal.time.isna()].iloc[0]
        assert (whole.estimate, whole.std_error) == pytest.approx(signed_error(pdf, mean))
        assert whole.conf_low == pytest.approx(whole.estimate - 1.959963984540054 * whole.std_error)
        assert not got[got.aggregation == "simple"].time.isna().any()
    event = [x[(x.aggregation == "event")].sort_values("time").estimate.to_numpy() for x in (plain, level)]
    assert np.allclose(*event)  # only the calendar series takes the cohort in
    with pytest.raises(ValueError):
        did.estimate(df, [], "attgt", "calendar", always_treated="level")


@pytest.mark.parametrize("estimator", ["etwfe", "attgt"])
def test_null_levels_are_estimated(spark, estimator):
    pdf = panel(np.random.default_rng(6), holes=0)
    pdf["lev"] = np.where(pdf.pair_id % 2 == 0, "a", None)
    named = pdf.assign(lev=pdf.lev.fillna("z"))
    got, want = (did.estimate(spark.createDataFrame(x), ["lev"], estimator, ("event", "calendar"), draws=20, pooled=True)
                 .toPandas().assign(lev=lambda d: d.lev.fillna("z"), time=lambda d: d.time.fillna(-99))
                 .sort_values(["lev", "aggregation", "time"]).reset_index(drop=True) for x in (pdf, named))
    assert set(got.lev) == {"a", "z"} and len(got) == len(want)
    for c in ("estimate", "std_error", "conf_low"):
        assert np.allclose(got[c].astype(float), want[c].astype(float))
