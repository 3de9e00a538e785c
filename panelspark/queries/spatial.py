"""Grid arithmetic, sampling, polygons, thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import spatial as G
from panelspark.operators.core import registry
from panelspark.operators.matching import cap_groups
from panelspark.queries.base import N_COL, n_if, part_grid, query, table, with_

REPS = with_("grid", b="""SELECT *, row // 5 AS br, col // 5 AS bc, (row % 5 - 2) * (row % 5 - 2)
    + (col % 5 - 2) * (col % 5 - 2) AS d2 FROM grid""", reps="""SELECT * FROM b QUALIFY
    row_number() OVER (PARTITION BY analysis_group, br, bc ORDER BY d2, pixel_id) = 1""")


@query("cell_table", """SELECT p_partkey + 1 AS pixel_id, CASE p_size % 5 + 40 WHEN 41 THEN
    'Decid' WHEN 42 THEN 'Everg' WHEN 43 THEN 'Mixed' END AS lulc,
    100.0::DOUBLE + (p_partkey % 50 + 0.5::DOUBLE) * 30 AS x,
    900.0::DOUBLE - (p_partkey // 50 + 0.5::DOUBLE) * 30 AS y FROM part
    WHERE p_size % 5 + 40 IN (41, 42, 43)""")
def cell_table(spark, sf):
    from panelspark import profile as P

    k = F.col("p_partkey")
    r = table(spark, sf, "part").select(
        F.floor(k / N_COL).alias("row"), (k % N_COL).alias("col"),
        (F.col("p_size") % 5 + 40).alias("code"))
    return G.cell_table(r, P.CLASSES, N_COL, 100.0, 900.0, 30.0)


def points(spark, sf):
    """Orders as points over the part grid (cells of size 1, 50 wide)."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("pixel_id"),
                    (F.col("o_custkey") % 480 / 10.0 + 0.75).alias("x"),
                    (-(F.col("o_orderkey") % 380 / 10.0 + 0.75)).alias("y"))


POINTS = """SELECT o_orderkey AS pixel_id, (o_custkey % 480) / 10.0::DOUBLE + 0.75 AS x,
    -((o_orderkey % 380) / 10.0::DOUBLE + 0.75) AS y FROM orders"""
LAYER = """SELECT p_partkey + 1 AS cell, CASE WHEN p_size <> 50 THEN p_size END AS v FROM part"""


def layer(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("pixel_id"),
                                           F.col("p_size").alias("value"))


@query("nearest_sample", f"""WITH p AS ({POINTS}), l AS ({LAYER}) SELECT p.pixel_id, p.x, p.y,
    v * 0.5::DOUBLE AS value FROM p LEFT JOIN l
    ON cell = CAST(floor(-y) AS BIGINT) * 50 + CAST(floor(x) AS BIGINT) + 1""")
def nearest_sample(spark, sf):
    return G.sample_nearest(points(spark, sf), layer(spark, sf), N_COL, 0.0, 0.0, 1.0,
                            nodata=50, scale=0.5)


@query("bilinear_sample", f"""WITH p AS (SELECT *, x - 0.5 AS fx, -y - 0.5 AS fy FROM ({POINTS})),
    c AS (SELECT p.pixel_id, floor(fy) + dr AS r, floor(fx) + dc AS c,
      (CASE WHEN dr = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END)
      * (CASE WHEN dc = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
      FROM p, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)), l AS ({LAYER})
    SELECT pixel_id, CASE WHEN bool_and(v IS NOT NULL) THEN round(sum(w * v) * 0.5, 6) END
    AS value FROM c LEFT JOIN l ON cell = CAST(r * 50 + c + 1 AS BIGINT) WHERE w > 0
    GROUP BY pixel_id""")
def bilinear_sample(spark, sf):
    return G.sample_bilinear(points(spark, sf), layer(spark, sf), N_COL, 0.0, 0.0, 1.0,
                             nodata=50, scale=0.5).select(
        "pixel_id", F.round("value", 6).alias("value"))


@query("file_mean", """SELECT l_partkey AS pixel_id, round(avg(l_quantity), 6) AS value FROM
    lineitem GROUP BY l_partkey""")
def file_mean(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pixel_id"),
                                            F.col("l_quantity").alias("value"))
    return G.mean_of_files(v).select("pixel_id", F.round("value", 6).alias("value"))


# three polygons over the point field: a box, a triangle, an L shape
POLY = {1: [(2, -2), (20, -2), (20, -15), (2, -15)],
        2: [(10, -5), (45, -20), (15, -36)],
        3: [(25, -1), (48, -1), (48, -38), (38, -38), (38, -10), (25, -10)]}
EDGES = [(k, *[float(v) for v in a], *[float(v) for v in b]) for k, ring in POLY.items()
         for a, b in zip(ring, ring[1:] + ring[:1])]
EDGE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + str(e[0]) + "::BIGINT, " + ", ".join(f"{v}::DOUBLE" for v in e[1:]) + ")"
    for e in EDGES) + ") v(poly_id, x1, y1, x2, y2)"
PIP = f"""WITH p AS ({POINTS}), e AS ({EDGE_SQL}), hit AS (SELECT pixel_id, poly_id FROM p, e
    WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    GROUP BY pixel_id, poly_id HAVING count(*) % 2 = 1) """


def _edges(spark):
    return registry(spark, ["poly_id", "x1", "y1", "x2", "y2"], EDGES)


def _attrs(spark):
    return registry(spark, ["poly_id", "code", "label"], [
        (1, "7", "box"), (2, "12", "triangle"), (3, "140", "ell")])


@query("pip_join", PIP + "SELECT pixel_id, poly_id, CASE poly_id WHEN 1 THEN 'box' WHEN 2 THEN "
       "'triangle' ELSE 'ell' END AS label FROM hit")
def pip_join(spark, sf):
    return G.join_polygons(points(spark, sf), _edges(spark), _attrs(spark), 4.0).select(
        "pixel_id", "poly_id", "label")


@query("zone_join", PIP + """SELECT p.pixel_id, CASE min(poly_id) WHEN 1 THEN '07' WHEN 2 THEN
    '12' WHEN 3 THEN '14' END AS zone FROM p LEFT JOIN hit USING (pixel_id) GROUP BY 1""")
def zone_join(spark, sf):
    return G.join_zone(points(spark, sf), _edges(spark), _attrs(spark), "code", 4.0, "pad_2")


@query("block_representatives", REPS + """SELECT analysis_group, br AS brow, bc AS bcol,
    pixel_id, d2, row, col FROM reps""")
def block_representatives(spark, sf):
    return G.block_representatives(part_grid(spark, sf), "analysis_group", N_COL, 5, 2)


CONF = REPS[:-1] + """, conf AS (SELECT a.analysis_group, a.pixel_id AS src, b.pixel_id AS dst,
    (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) AS dist2
    FROM reps a JOIN reps b ON a.analysis_group = b.analysis_group AND abs(a.br - b.br) <= 1
    AND abs(a.bc - b.bc) <= 1 AND (b.d2, b.pixel_id) < (a.d2, a.pixel_id)
    WHERE (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) < 25) """


WIDE_REPS = with_("grid", b="""SELECT *, row // 16 AS br, col // 16 AS bc, (row % 16 - 8)
    * (row % 16 - 8) + (col % 16 - 8) * (col % 16 - 8) AS d2 FROM grid""", reps="""SELECT * FROM b
    QUALIFY row_number() OVER (PARTITION BY analysis_group, br, bc ORDER BY d2, pixel_id) = 1""")


@query("block_representatives_wide", WIDE_REPS + """SELECT analysis_group, br AS brow, bc AS bcol,
    pixel_id, d2, row, col FROM reps""")
def block_representatives_wide(spark, sf):
    """Blocks whose corners lie more than 127 squared steps from the centre."""
    return G.block_representatives(part_grid(spark, sf), "analysis_group", N_COL, 16, 8)


@query("spacing_conflicts", CONF + "SELECT * FROM conf")
def spacing_conflicts(spark, sf):
    reps = G.block_representatives(part_grid(spark, sf), "analysis_group", N_COL, 5, 2)
    return G.spacing_conflicts(reps, "analysis_group", 25)


# the one-by-one pass: each representative in order, unless one kept before is too close
@query("spaced_sample", REPS.replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + """, ord AS (
    SELECT analysis_group AS g, pixel_id, row, col, row_number() OVER (PARTITION BY analysis_group
      ORDER BY d2, pixel_id) AS k FROM reps WHERE analysis_group <> 'PROMO'),
    near AS (SELECT a.g, a.k, a.pixel_id, coalesce(list(b.pixel_id) FILTER (b.pixel_id IS NOT NULL),
      []) AS close FROM ord a LEFT JOIN ord b ON a.g = b.g AND b.k < a.k
      AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 < 25 GROUP BY a.g, a.k, a.pixel_id),
    walk AS (SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[] AS kept FROM ord UNION ALL
      SELECT n.g, n.k, CASE WHEN list_has_any(w.kept, n.close) THEN w.kept
        ELSE list_append(w.kept, n.pixel_id) END FROM walk w JOIN near n ON n.g = w.g
        AND n.k = w.k + 1)
    SELECT g AS analysis_group, unnest(kept) AS pixel_id, 'spacing' AS rule_applied
    FROM (SELECT g, arg_max(kept, k) AS kept FROM walk GROUP BY g)
    UNION ALL SELECT analysis_group, pixel_id, 'whole_group' FROM grid
    WHERE analysis_group = 'PROMO'""")
def spaced_sample(spark, sf):
    return G.spaced_sample(part_grid(spark, sf), "analysis_group", N_COL, 5, 2, ["PROMO"])


@query("spaced_sample_check", f"""SELECT p_type AS analysis_group, true AS spaced,
    true AS maximal FROM part GROUP BY p_type""")
def spaced_sample_check(spark, sf):
    """No kept pair is too close, and every dropped one is near a kept better one."""
    reps = G.block_representatives(part_grid(spark, sf), "analysis_group", N_COL, 5, 2)
    kept = G.enforce_spacing(reps, "analysis_group", 25)
    key = ["analysis_group", "pixel_id"]
    chk = G.spacing_check(kept.select(*key), "analysis_group", N_COL, 5, 2)
    conf = G.spacing_conflicts(reps, "analysis_group", 25)
    ok = conf.join(kept.select("analysis_group", F.col("pixel_id").alias("dst")),
                   ["analysis_group", "dst"], "left_semi").select(
        "analysis_group", F.col("src").alias("pixel_id")).distinct()
    bad = reps.join(kept.select(*key), key, "left_anti").join(ok, key, "left_anti").groupBy(
        "analysis_group").agg(F.count(F.lit(1)).alias("n_bad"))
    return chk.join(bad, "analysis_group", "left").select(
        "analysis_group", (F.col("n_close") == 0).alias("spaced"),
        (F.coalesce("n_bad", F.lit(0)) == 0).alias("maximal"))


@query("spacing_check", REPS[:-1] + """, d AS (SELECT analysis_group, br, bc, count(*) AS n
    FROM b GROUP BY ALL), c AS (SELECT a.analysis_group, count(*) AS n_close FROM b a JOIN b
    ON a.analysis_group = b.analysis_group AND abs(a.br - b.br) <= 1 AND abs(a.bc - b.bc) <= 1
    AND (a.br <> b.br OR a.bc <> b.bc) AND (b.d2, b.pixel_id) < (a.d2, a.pixel_id)
    AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) < 25
    GROUP BY a.analysis_group) """ + f"""SELECT analysis_group, CAST(sum(n) AS BIGINT) AS n_cells,
    {n_if("n > 1")} AS n_blocks_shared, coalesce(max(n_close), 0) AS n_close FROM d
    LEFT JOIN c USING (analysis_group) GROUP BY analysis_group""")
def spacing_check(spark, sf):
    return G.spacing_check(part_grid(spark, sf), "analysis_group", N_COL, 5, 2)


@query("cell_density", with_("grid", n="""SELECT analysis_group, brand, count(*) AS u FROM grid
    GROUP BY ALL""") + """SELECT analysis_group, count(*) AS n_cells,
    quantile_cont(u, 0.5) AS median, quantile_cont(u, 0.25) AS q25 FROM n
    GROUP BY analysis_group""")
def cell_density(spark, sf):
    return G.cell_density(part_grid(spark, sf), ["analysis_group"], ["brand"])


@query("cells_emptied", REPS[:-1] + """ SELECT analysis_group, count(*) AS n_emptied FROM
    (SELECT DISTINCT analysis_group, size FROM grid EXCEPT SELECT DISTINCT analysis_group, size
    FROM reps) GROUP BY analysis_group""")
def cells_emptied(spark, sf):
    g = part_grid(spark, sf)
    r = G.block_representatives(g, "analysis_group", N_COL, 5, 2)
    after = g.join(r.select("analysis_group", "pixel_id"), ["analysis_group", "pixel_id"],
                   "left_semi")
    return G.cells_emptied(g, after, ["analysis_group"], ["size"])


@query("control_distance", with_("grid", p="SELECT * FROM grid") + """SELECT a.pixel_id, round(30 * sqrt(min((a.row - b.row) ** 2
    + (a.col - b.col) ** 2)), 6) AS distance FROM p a JOIN p b ON a.pixel_id <> b.pixel_id
    GROUP BY a.pixel_id""")
def control_distance(spark, sf):
    return G.nearest_distance(part_grid(spark, sf), N_COL).select(
        "pixel_id", F.round("distance", 6).alias("distance"))


@query("cap_sample", with_("grid") + """SELECT analysis_group, pixel_id FROM grid QUALIFY
    row_number() OVER (PARTITION BY analysis_group ORDER BY md5('160617:' || pixel_id),
    pixel_id) <= 100""")
def cap_sample(spark, sf):
    from panelspark import profile as P

    return cap_groups(part_grid(spark, sf), ["analysis_group"], "pixel_id", 100, P.SEED).select(
        "analysis_group", "pixel_id")
