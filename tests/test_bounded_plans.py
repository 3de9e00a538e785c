"""Plans that keep their work near the size of the input, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import lookups, spatial, units


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n, low=1, high=9, letters="abcd"):
    return ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)]


def slips(rng, w, n):
    for _ in range(n):
        k = rng.randrange(len(w) + 1)
        w = rng.choice((w[:k] + "x" + w[k:], w[:k] + w[k + 1:], w[:k] + "y" + w[k + 1:]))
    return w


def test_nearest_string_equals_all_pairs(spark):
    rng = random.Random(1)
    known = words(rng, 120) + ["Aa", "aA", "", "é", "thinning", "Thin-ning", "a" * 30]
    asked = ([slips(rng, rng.choice(known), rng.randint(0, 5)) for _ in range(120)]
             + words(rng, 60, letters="abcdefgh") + ["zzzzzzzzzzzzzzzzzzzz", "q", "THINNING", "é", "a" * 27])
    left = spark.createDataFrame([(w,) for w in asked] + [(None,), ("",)], "k string")
    reg = spark.createDataFrame([(w,) for w in known] + [(None,)], "r string")
    got = {r.k: (r.distance, r.nearest) for r in lookups.nearest_key(left, "k", reg, "r").collect()}
    best = {}
    for r in sorted(known):
        best.setdefault(r.upper(), r)
    assert got == {w: min((edits(w.upper(), u), r) for u, r in best.items()) for w in set(asked) - {""}}
    assert lookups.nearest_key(left, "k", reg.limit(0), "r").collect() == []


def test_candidates_are_few(spark):
    rng = random.Random(2)
    known = words(rng, 5000, 8, 20, "abcdefghijklmnopqrst")
    asked = [slips(rng, rng.choice(known), 2) for _ in range(5000)]
    sides = [lookups._grams(spark.createDataFrame([(w,) for w in set(x)], "u string")) for x in (asked, known)]
    counts = sides[0].unionByName(sides[1]).groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    a, b = (lookups._rarest(s, counts) for s in sides)
    assert lookups.within_distance(a, b, 2).count() < 0.02 * 25_000_000


def nearest(cells, n_col):
    rc = np.array([((p - 1) // n_col, (p - 1) % n_col) for p in cells])
    d = ((rc[:, None] - rc[None]) ** 2).sum(axis=2).astype(float)
    np.fill_diagonal(d, np.inf)
    return dict(zip(cells, np.sqrt(d.min(axis=1))))


@pytest.mark.parametrize("kind", ["clusters", "sparse", "pair"])
def test_nearest_distance_by_tiles(spark, kind):
    """Two far clusters and a lone cell, cells far apart, two cells on a wide grid."""
    rng, n_col = np.random.default_rng(3), 5000
    at = {"clusters": [(r, c) for r in range(0, 12) for c in range(3)] + [(4000 + r, 4900) for r in range(0, 40, 2)]
          + [(2500, 100)],
          "sparse": [tuple(x) for x in rng.integers(0, 5000, (150, 2))], "pair": [(0, 0), (4999, 4999)]}[kind]
    cells = sorted({r * n_col + c + 1 for r, c in at})
    df = spark.createDataFrame([(int(p),) for p in cells], "pixel_id long")
    got = {r.pixel_id: r.distance for r in spatial.nearest_distance(df, n_col, size=1.0, tile=4).collect()}
    assert got == pytest.approx(nearest(cells, n_col))


def test_lone_cell_has_no_distance(spark):
    df = spark.createDataFrame([(17,)], "pixel_id long")
    assert [r.distance for r in spatial.nearest_distance(df, 10).collect()] == [None]
    assert spatial.nearest_distance(df.limit(0), 10).collect() == []


def test_distinct_counts_by_bitmaps(spark):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"pair_id": rng.integers(0, 900, n) * 97, "pixel_id": rng.integers(1, 10**7, n),
                        "treat": rng.integers(0, 2, n), "pairing": rng.choice(["A", "B"], n),
                        "stratum": rng.choice(["s", "t", "", None], n), "zone": rng.choice(["1", "2", None], n)})
    pdf.loc[::3, "pixel_id"] = 5
    pdf["gvar"] = np.where(pdf.treat == 1, rng.choice([0, 1985, 1999, 2004], n), 0)
    df = spark.createDataFrame(pdf)
    for by in (["pairing"], ["pairing", "stratum"], []):
        got = units.units_summary(df, by, 1985).toPandas()
        groups = pdf.fillna("-").groupby(by) if by else [((), pdf)]
        assert len(got) == len(groups)
        for name, g in groups:
            name = name if isinstance(name, tuple) else (name,)
            m = np.logical_and.reduce([got[k].fillna("-") == v for k, v in zip(by, name)] or [np.ones(len(got), bool)])
            r, t = got[m].iloc[0], g[g.treat == 1]
            assert (r.n_units, r.n_pairs, r.n_treated_pixels, r.n_control_pixels, r.n_cohorts) == (
                len(g), g.pair_id.nunique(), t.pixel_id.nunique(), g[g.treat == 0].pixel_id.nunique(), t.gvar.nunique())
    got = units.subset_levels(df).toPandas().set_index(["pairing", "stratum", "zone"])
    want = {}
    for p, g in pdf.groupby("pairing"):
        for s in ("", "s", "t"):
            for z in ("", "1", "2"):
                x = g[((g.stratum == s) | (s == "")) & ((g.zone == z) | (z == ""))]
                want[p, s, z] = (len(x), x.pair_id.nunique(), x[(x.treat == 1) & (x.gvar > 0)].gvar.nunique())
    assert {k: tuple(got.loc[k, ["n_units", "n_pairs", "n_cohorts"]]) for k in got.index} == want


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbour_tiles_are_never_broadcast(spark):
    """Nine copies of a packed grid look small to the optimiser, and are not."""
    cells = spark.range(1, 400).withColumnRenamed("id", "pixel_id")
    base = cells.select("pixel_id", spatial.grid_row(F.col("pixel_id"), 20).alias("row"),
                        spatial.grid_col(F.col("pixel_id"), 20).alias("col"))
    asked = base.select(F.col("pixel_id").alias("id"), F.col("row").alias("r"), F.col("col").alias("c"),
                        F.floor(F.col("row") / 8).alias("tr"), F.floor(F.col("col") / 8).alias("tc"))
    assert "Broadcast" not in physical(spatial._nearest_in(asked, base, 8))


def test_spacing_conflicts_are_never_broadcast(spark):
    grid = spark.range(1, 400).select(F.col("id").alias("pixel_id"), F.lit("g").alias("g"))
    blocks = spatial.block_columns(grid, 20, 5, 2)
    assert "Broadcast" not in physical(spatial.spacing_conflicts(blocks, "g", 25))
    near = spatial.spacing_check(grid, "g", 20, 5, 2).collect()
    assert [(r.n_cells, r.n_blocks_shared) for r in near] == [(399, 16)]
