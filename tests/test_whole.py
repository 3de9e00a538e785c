"""Nothing is dropped, capped or merged without a word."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cleaning, detect, matching as M, spatial, support
from panelspark.operators.core import ordered_cumulative
from panelspark.operators.penalty import fit_scores
from panelspark.operators.trees import boosted_scores
from panelspark.sources import loads


def test_layer_without_registry_row_fails(spark):
    s = spark.createDataFrame([("A", 1, 2000, 5.0), ("B", 1, 2000, 7.0)],
                              "layer string, pixel_id long, year int, value double")
    src = spark.createDataFrame([("s", None, 2.0)], "source string, nodata double, scale double")
    lay = spark.createDataFrame([("A", "s", None, None)],
                                "layer string, source string, nodata double, scale double")
    assert loads.load_layers(s.where("layer = 'A'"), lay, src).first().value == 10.0
    with pytest.raises(Exception, match="registry row"):
        loads.load_layers(s, lay, src).collect()


def test_masking_without_reference_is_refused(spark):
    d = spark.createDataFrame([("A", 2000, 1, 5.0)],
                              "layer string, year int, pixel_id long, value double")
    rules = [("A", "mask_by_reference", None)]
    for op in (cleaning.clean_layer, cleaning.rule_effects):
        with pytest.raises(ValueError, match="reference"):
            op(d, {}, .47, {}, rules)


def test_wide_fails_on_unknown_level(spark):
    d = spark.createDataFrame([("x", "a", 1), ("x", "b", 2)], "k string, c string, v int")
    assert support.wide_by(d, ["k"], "c", ["a", "b"], "v").first().asDict() == {"k": "x", "a": 1, "b": 2}
    with pytest.raises(Exception, match="not in the list"):
        support.wide_by(d, ["k"], "c", ["a"], "v").collect()


@pytest.mark.parametrize("block", [5, 16, 40])
def test_block_representative_is_the_best_of_its_block(spark, block):
    n_col, centre = 97, block // 2
    rng = np.random.default_rng(block)
    ids = np.sort(rng.choice(97 * 90, 800, replace=False)) + 1
    got = spatial.block_representatives(
        spark.createDataFrame(pd.DataFrame({"g": "x", "pixel_id": ids})), "g", n_col, block, centre)
    row, col = np.divmod(ids - 1, n_col)
    d2 = (row % block - centre) ** 2 + (col % block - centre) ** 2
    want = pd.DataFrame({"b": list(zip(row // block, col // block)), "d2": d2, "id": ids}
                        ).sort_values(["d2", "id"]).groupby("b").first()
    assert {(r.brow, r.bcol): (r.d2, r.pixel_id) for r in got.collect()} == {
        k: (r.d2, r.id) for k, r in want.iterrows()}


def test_large_ids_stay_apart(spark):
    base = 1 << 60
    rows = [(base + i, int(i % 2), "t" if i % 4 else None) for i in range(40)]
    d = spark.createDataFrame(rows, "pixel_id long, treat int, c string")
    pairs = M.rank_match(d, ["c"]).collect()
    want = []
    for cell in (None, "t"):
        t = sorted(i for i, z, x in rows if z == 1 and x == cell)
        c = sorted(i for i, z, x in rows if z == 0 and x == cell)
        want += [(cell, a, b) for a, b in zip(t, c)]
    assert sorted((str(p.c), p.treated_id, p.control_id) for p in pairs) == sorted(
        (str(c), a, b) for c, a, b in want)
    runs = support.number_runs(spark.createDataFrame(
        [("a", base + i) for i in (0, 1, 2, 5, 7, 8)], "k string, n long"), ["k"], "n")
    assert sorted((r.run_first - base, r.run_last - base, r.n) for r in runs.collect()) == [
        (0, 2, 3), (5, 5, 1), (7, 8, 2)]


def test_crowded_buckets_do_not_change_results(spark, monkeypatch):
    d = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(
        np.random.default_rng(1).normal(size=500))], "k int, v double")
    plain = sorted(map(tuple, ordered_cumulative(d, ["k"], "v", {"n": F.lit(1)}).collect()))
    monkeypatch.setattr("panelspark.operators.core.CROWDED", 2)
    assert sorted(map(tuple, ordered_cumulative(d, ["k"], "v", {"n": F.lit(1)}).collect())) == plain


def test_matching_ways_agree_on_nulls_ties_and_many_axes(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 8)
    rng = np.random.default_rng(2)
    n, p = 160, 9
    x = np.round(rng.normal(size=(n, p)), 1)
    x[40:80] = x[:40]  # exact ties
    rows = [(i, int(i % 3 == 0), None if i % 5 == 0 else "c", None if i % 2 else 1, x[i].tolist())
            for i in range(n)]
    d = spark.createDataFrame(rows, "pixel_id long, treat int, c string, t int, coords array<double>")
    one, many = (sorted((str(r.c), str(r.t), r.treated_id, r.control_id, r.distance) for r in
                        M.nearest_match(d, ["c", "t"], small_pairs=k).collect()) for k in (10**9, 0))
    assert one == many and len(one) > 40
    assert {(a, b) for a, b, *_ in one} >= {("None", "None"), ("None", "1"), ("c", "None")}


def test_fit_reports_separation(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    mixed = (rng.random(400) < 1 / (1 + np.exp(-a))).astype(int)
    rows = [("apart", float(v), int(v > 0)) for v in a] + [
        (None, float(v), int(t)) for v, t in zip(a, mixed)]
    d = spark.createDataFrame(rows, "lev string, a double, treat int")
    fit = {r.lev: r for r in fit_scores(d, ["lev"], ["a"]).collect()}
    assert fit[None].converged and not fit[None].separated
    assert fit["apart"].separated
    assert "converged" not in M.linear_score(d, fit_scores(d, ["lev"], ["a"]), ["lev"], ["a"]).columns


def test_no_level_is_left_out_of_tree_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 2 else "w", float(v), int(v + rng.normal() > 0)) for i, v in
            enumerate(rng.normal(size=120))]
    d = spark.createDataFrame(rows, "lev string, a double, treat int")
    s = boosted_scores(d, ["lev"], ["a"])
    assert s.count() == 120 and s.where("score IS NULL").count() == 0


def test_points_beyond_the_grid_are_null(spark):
    layer = spark.createDataFrame([(i + 1, float(i)) for i in range(12)], "pixel_id long, value double")
    pts = spark.createDataFrame([(1, 0.5, -0.5), (2, 4.5, -0.5), (3, -0.5, -1.5), (4, 1.5, 0.5), (5, 3.9, -2.9),
                                 (6, 1.0, -1.0), (7, 4.0, -1.0)], "pixel_id long, x double, y double")
    got = {r.pixel_id: r.value for r in spatial.sample_nearest(pts, layer, 4, 0.0, 0.0, 1.0).collect()}
    assert got == {1: 0.0, 2: None, 3: None, 4: None, 5: 11.0, 6: 5.0, 7: None}
    bi = {r.pixel_id: r.value for r in spatial.sample_bilinear(pts, layer, 4, 0.0, 0.0, 1.0).collect()}
    assert bi[1] == 0.0 and bi[2] is None and bi[6] == 2.5 and bi[7] is None


def test_harmless_rate_is_zero_where_nothing_was_hit(spark):
    rec = spark.createDataFrame([(1, 2000, "a"), (2, 2001, "a"), (3, 2001, "b"), (4, 2005, "b")],
                                "pixel_id long, event_year int, activity string")
    zones = spark.createDataFrame([(i, "z" if i % 2 else "y") for i in range(1, 20)],
                                  "pixel_id long, zone string")
    clean = spark.range(5, 20).withColumnRenamed("id", "pixel_id")
    det = spark.createDataFrame([(5, 2000), (6, 2001), (2, 2001)], "pixel_id long, year int")
    got = {r.activity: r for r in detect.harmless_rates(rec, clean, zones, det, 0).collect()}
    # zone z: 8 clean cells, hit in 2000 only; zone y: 7, hit in 2001 only; 2005 unknown
    assert got["a"].n_records == 2 and got["a"].exp_rate == pytest.approx((1 / 8 + 1 / 7) / 2)
    assert got["b"].n_records == 1 and got["b"].exp_rate == 0.0


def test_emptied_cells_keep_null_groups(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), ("g", 1)], "g string, c int")
    got = spatial.cells_emptied(a, a.where("c = 1"), ["g"], ["c"]).collect()
    assert [(r.g, r.n_emptied) for r in got] == [(None, 1)]


def test_registry_refuses_repeated_names(spark):
    from panelspark.sources import scans
    a = spark.createDataFrame([("x",), ("y",)], "layer string")
    assert scans.layer_registry({"a": a.where("layer = 'x'"), "b": a.where("layer = 'y'")}).count() == 2
    with pytest.raises(Exception, match="unique"):
        scans.layer_registry({"a": a, "b": a.where("layer = 'y'")}).collect()


def test_covariate_gates(spark):
    grid = spark.createDataFrame([(1, "a"), (2, "b")], "pixel_id long, lulc string")
    v = spark.createDataFrame([(1, 0.5), (2, 1.5)], "pixel_id long, value double")
    assert cleaning.covariate_table(grid, {"north": v}, {}, {}, {"north": (-2, 2)}).count() == 2
    with pytest.raises(Exception, match="outside its range"):
        cleaning.covariate_table(grid, {"north": v}, {}, {}, {"north": (-1, 1)}).collect()
    with pytest.raises(Exception, match="duplicate id in the grid"):
        cleaning.covariate_table(grid.union(grid.where("pixel_id = 1")), {"north": v}, {}, {}).collect()
