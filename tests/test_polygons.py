"""Point in polygon by tile classes against the plain even-odd rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import spatial


def ring(points):
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def star(rng, n, cx, cy, r):
    t = np.sort(rng.random(n)) * 2 * np.pi
    k = r * (0.4 + 0.6 * rng.random(n))
    return ring([(float(cx + a * np.cos(b)), float(cy + a * np.sin(b))) for a, b in zip(k, t)])


def hits(pts, edges):
    out = set()
    for poly in {e[0] for e in edges}:
        e = np.array([x[1:] for x in edges if x[0] == poly])
        x1, y1, x2, y2 = (c[None, :] for c in e.T)
        x, y = pts[:, 0:1], pts[:, 1:2]
        with np.errstate(all="ignore"):
            c = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        out |= {(int(i), poly) for i in np.flatnonzero(c.sum(axis=1) % 2)}
    return out


def run(spark, pts, edges, tile):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pixel_id long, x double, y double")
    e = spark.createDataFrame(edges, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    rows = [tuple(r) for r in spatial.points_in_polygons(p, e, tile).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("tile", [1.0, 3.0, 0.7, 50.0])
def test_corners_sides_and_holes(spark, tile):
    """Points on vertices and sides, level edges, holes, rings that touch, slivers."""
    rings = {1: [[(0, 0), (9, 0), (9, 9), (0, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)]],
             2: [[(2, 1), (7, 1), (7, 4), (4, 4), (4, 7), (2, 7)]],
             3: [[(0, 0), (5, 0), (5, 5), (0, 5)], [(5, 5), (8, 5), (8, 8), (5, 8)]],
             4: [[(1, 2), (20, 3), (1, 4)]], 5: [[(4, 0), (8, 8), (0, 3), (8, 3), (0, 8)]]}
    edges = [(k, *map(float, e)) for k, rs in rings.items() for r in rs for e in ring(r)]
    pts = np.array([(x / 2, y / 2) for x in range(-3, 43) for y in range(-3, 21)])
    assert run(spark, pts, edges, tile) == hits(pts, edges)


@pytest.mark.parametrize("seed", range(3))
def test_random_stars(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(k, *e) for k in range(6) for e in star(rng, rng.integers(3, 200), *rng.uniform(-20, 20, 2), 15)]
    pts = rng.uniform(-40, 40, (4000, 2))
    assert run(spark, pts, edges, float(rng.uniform(0.5, 8))) == hits(pts, edges)


def test_rows_follow_the_boundary(spark):
    """A polygon of 10,000 edges over many tiles: inner points meet no edge."""
    rng = np.random.default_rng(7)
    t = np.arange(10_000) / 10_000 * 2 * np.pi
    r = 400 + 5 * rng.random(10_000)
    edges = [(1, *e) for e in ring([(float(a * np.cos(b)), float(a * np.sin(b))) for a, b in zip(r, t)])]
    e = spark.createDataFrame(edges, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    inner, border = spatial.tile_classes(e, 10.0)
    tiles = border.select("__tx", "__ty").distinct().count()
    assert border.count() < 3 * len(edges)       # each edge is in the tiles that it touches
    assert tiles < 600 < inner.count()           # a ring of tiles, against its area
    pts = rng.uniform(-420, 420, (3000, 2))
    got = run(spark, pts, edges, 10.0)
    assert got == hits(pts, edges)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pixel_id long, x double, y double")
    met = p.select("pixel_id", F.floor(p.x / 10).alias("__tx"), F.floor(p.y / 10).alias("__ty")).join(
        border, ["__tx", "__ty"]).select("pixel_id").distinct().count()
    assert met < 0.25 * len(pts)


def test_nothing_to_join(spark):
    assert run(spark, np.zeros((0, 2)), [(1, 0.0, 0.0, 1.0, 0.0)], 1.0) == set()
    assert run(spark, np.zeros((3, 2)), [], 1.0) == set()
