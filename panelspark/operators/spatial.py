"""Grid arithmetic, sampling of layers at points, polygons, spatial thinning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import grid_col, grid_row, seeded_order
from panelspark.functions.text import code_prefix, pad_code
from panelspark.operators.core import (exact_quantiles, first_k_per_group, null_safe_join,
                                       registry, small_side)
from panelspark.session import cut_lineage

NEIGHBOURS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def cell_table(raster: DataFrame, classes: Mapping[int, str], n_col: int,
               x0: float, y0: float, size: float) -> DataFrame:
    """Cells of the wanted classes from a tabulated raster (row, col, code)."""
    from panelspark.functions.numeric import lookup

    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    return raster.where(F.col("code").isin(list(classes))).select(
        (r * n_col + c + 1).alias("pixel_id"),
        lookup(F.col("code"), dict(classes)).alias("lulc"),
        (F.lit(x0) + (c + 0.5) * size).alias("x"),
        (F.lit(y0) - (r + 0.5) * size).alias("y"))


def cell_at(x: Column, y: Column, n_col: int, x0: float, y0: float,
            size: float) -> Column:
    """Id of the cell holding a point; null beyond the first row or the side columns."""
    col = F.floor((x - x0) / size).cast("long")
    row = F.floor((F.lit(y0) - y) / size).cast("long")
    return F.when((row >= 0) & (col >= 0) & (col < n_col), row * n_col + col + 1)


def sample_nearest(points: DataFrame, layer: DataFrame, n_col: int, x0: float,
                   y0: float, size: float, nodata: float | None = None,
                   scale: float = 1.0) -> DataFrame:
    """Layer value of the cell each point falls in; no-data null, then scaled."""
    v = F.col("value").cast("double")
    if nodata is not None:
        v = F.when(v != nodata, v)
    lay = layer.select(F.col("pixel_id").alias("__cell"), (v * scale).alias("value"))
    p = points.withColumn("__cell", cell_at(F.col("x"), F.col("y"), n_col, x0, y0, size))
    return p.join(lay, "__cell", "left").drop("__cell")


def sample_bilinear(points: DataFrame, layer: DataFrame, n_col: int, x0: float,
                    y0: float, size: float, nodata: float | None = None,
                    scale: float = 1.0) -> DataFrame:
    """Distance-weighted mean of the four surrounding cell centres.

    No-data goes before interpolation: a missing corner makes the value null.
    Each point emits four rows and is reduced again by its id.
    """
    fx = (F.col("x") - x0) / size - 0.5
    fy = (F.lit(y0) - F.col("y")) / size - 0.5
    c0, r0 = F.floor(fx), F.floor(fy)
    wx, wy = fx - c0, fy - r0

    def corner(dr: int, dc: int) -> Column:
        w = (wy if dr else 1 - wy) * (wx if dc else 1 - wx)
        row, col = r0 + dr, c0 + dc
        inside = (row >= 0) & (col >= 0) & (col < n_col)
        return F.struct(F.when(inside, (row * n_col + col + 1).cast("long")).alias("cell"),
                        w.alias("w"))

    four = F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))
    v = F.col("value").cast("double")
    if nodata is not None:
        v = F.when(v != nodata, v)
    lay = layer.select(F.col("pixel_id").alias("__cell"), v.alias("__v"))
    q = points.select("pixel_id", F.explode(four).alias("__c")).select(
        "pixel_id", F.col("__c.cell").alias("__cell"), F.col("__c.w").alias("__w"))
    s = q.where(F.col("__w") > 0).join(lay, "__cell", "left").groupBy("pixel_id").agg(
        F.sum(F.col("__w") * F.col("__v")).alias("__s"),
        F.sum(F.col("__v").isNull().cast("int")).alias("__missing"))
    return s.select("pixel_id", F.when(F.col("__missing") == 0,
                                       F.col("__s") * scale).alias("value"))


def mean_of_files(stacked: DataFrame) -> DataFrame:
    """Mean over files per cell, missing values ignored."""
    return stacked.groupBy("pixel_id").agg(F.avg("value").alias("value"))


def tile_classes(edges: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Tiles wholly inside a polygon, and the edges of the tiles on its boundary.

    (poly_id, __tx, __ty) and (poly_id, __tx, __ty, base, x1, y1, x2, y2). A scanline
    runs along the lower side of every tile row: an edge stands in the columns that it
    touches within the row, and ``base`` tells whether an odd number of the edges that lie
    farther right cross the line. Between two boundary tiles nothing changes, so the tiles
    there are inside if the one before has an odd base. Rows follow the boundary; only
    the inner tiles, one narrow row each, follow the area.
    """
    ylo, yhi = F.least("y1", "y2"), F.greatest("y1", "y2")
    xlo, xhi = F.least("x1", "x2"), F.greatest("x1", "x2")
    e = edges.select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(
        F.floor(ylo / tile), F.floor(yhi / tile))).alias("__ty"))
    bottom = F.col("__ty") * F.lit(float(tile))

    def at(y: Column) -> Column:
        y = F.least(F.greatest(y, ylo), yhi)
        return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (
            F.col("y2") - F.col("y1")) + F.col("x1")

    # a little wider than the edge: a tile too many does no harm
    flat, pad = F.col("y1") == F.col("y2"), F.lit(float(tile) * 1e-9)
    a = F.when(flat, xlo).otherwise(F.least(at(bottom), at(bottom + tile)) - pad)
    b = F.when(flat, xhi).otherwise(F.greatest(at(bottom), at(bottom + tile)) + pad)
    e = e.withColumns({
        "__a": F.floor(F.greatest(a, xlo) / tile), "__b": F.floor(F.least(b, xhi) / tile),
        "__cross": ((F.col("y1") > bottom) != (F.col("y2") > bottom)).cast("long")})
    border = e.withColumn("__tx", F.explode(F.sequence("__a", "__b")))
    begun = F.sum(F.when(F.col("__tx") == F.col("__a"), F.col("__cross")).otherwise(0))
    row = Window.partitionBy("poly_id", "__ty").orderBy("__tx")
    right = Window.partitionBy("poly_id", "__ty").orderBy(F.col("__tx").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    tiles = border.groupBy("poly_id", "__ty", "__tx").agg(begun.alias("__n")).select(
        "poly_id", "__ty", "__tx", F.lead("__tx").over(row).alias("__next"),
        (F.coalesce(F.sum("__n").over(right), F.lit(0)) % 2).alias("base"))
    inner = tiles.where((F.col("base") == 1) & (F.col("__next") > F.col("__tx") + 1)).select(
        "poly_id", "__ty", F.explode(F.sequence(F.col("__tx") + 1, F.col("__next") - 1)).alias("__tx"))
    keys = ["poly_id", "__ty", "__tx"]
    return inner, border.drop("__a", "__b", "__cross").join(tiles.drop("__next"), keys)


def points_in_polygons(points: DataFrame, edges: DataFrame,
                       tile: float) -> DataFrame:
    """All (pixel_id, poly_id) hits by the even-odd rule.

    ``edges`` is (poly_id, x1, y1, x2, y2), all closed rings of a polygon together. A
    point of an inner tile meets no edge. In a boundary tile it meets the edges that touch
    the tile, under the same comparisons as over all edges: those farther right change
    together at their common ends, so they count by the tile's base and by the ends to
    which edges of the tile lead.
    """
    inner, border = tile_classes(edges, tile)
    p = points.select("pixel_id", "x", "y",
                      F.floor(F.col("x") / tile).alias("__tx"),
                      F.floor(F.col("y") / tile).alias("__ty"))
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (
        F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1"))
        / (F.col("y2") - F.col("y1")) + F.col("x1"))
    bottom = F.col("__ty") * F.lit(float(tile))

    def passed(x: str, y: str) -> Column:
        beyond = F.floor(F.col(x) / tile) > F.col("__tx")
        return (beyond & ((F.col(y) > bottom) != (F.col(y) > F.col("y")))).cast("long")

    level = F.col("y1") == F.col("y2")  # no crossing, and no division
    n = F.when(level, F.lit(0)).otherwise(cross.cast("long")) + passed("x1", "y1") + passed("x2", "y2")
    near = (p.join(border, ["__tx", "__ty"]).groupBy("pixel_id", "poly_id")
            .agg((F.max("base") + F.sum(n)).alias("__n"))
            .where(F.col("__n") % 2 == 1).select("pixel_id", "poly_id"))
    return near.unionByName(p.join(inner, ["__tx", "__ty"]).select("pixel_id", "poly_id"))


def join_zone(points: DataFrame, edges: DataFrame, attrs: DataFrame, field: str,
              tile: float, derive: str | None = None) -> DataFrame:
    """First polygon (lowest id) of each point and its zone code."""
    first = points_in_polygons(points, edges, tile).groupBy("pixel_id").agg(
        F.min("poly_id").alias("poly_id"))
    code = F.col(field)
    if derive == "pad_2":
        padded = pad_code(code, 2)  # a code that is no integer stops the job
        code = F.when(code.isNotNull() & padded.isNull(), F.raise_error(F.concat(
            F.lit(f"{field} holds a code that is no integer: "), code.cast("string")))
            .cast("string")).otherwise(padded)
    elif derive == "substr_8":
        code = code_prefix(code, 8)
    hit = first.join(attrs.select("poly_id", code.cast("string").alias("zone")),
                     "poly_id", "left").drop("poly_id")
    return points.select("pixel_id").join(hit, "pixel_id", "left")


def join_polygons(points: DataFrame, edges: DataFrame, attrs: DataFrame,
                  tile: float) -> DataFrame:
    """One row per point and polygon that holds it, with the record columns."""
    return points_in_polygons(points, edges, tile).join(attrs, "poly_id")


# -- thinning -------------------------------------------------------------------

def block_columns(df: DataFrame, n_col: int, block: int, centre: int) -> DataFrame:
    """Row, column, block coordinates and squared distance to the block centre."""
    d = df.withColumn("row", grid_row(F.col("pixel_id"), n_col)).withColumn(
        "col", grid_col(F.col("pixel_id"), n_col))
    dr = F.pmod("row", F.lit(block)) - centre
    dc = F.pmod("col", F.lit(block)) - centre
    return (d.withColumn("brow", F.floor(F.col("row") / block))
            .withColumn("bcol", F.floor(F.col("col") / block))
            .withColumn("d2", (dr * dr + dc * dc).cast("long")))


def block_representatives(df: DataFrame, group: str, n_col: int, block: int,
                          centre: int) -> DataFrame:
    """Best-centred cell of each occupied block, lowest id on ties.

    The smallest (distance, id) pair, a plain minimum with map-side combining.
    """
    b = block_columns(df, n_col, block, centre)
    best = b.groupBy(group, "brow", "bcol").agg(
        F.min(F.struct("d2", F.col("pixel_id").cast("long").alias("pixel_id"))).alias("__m"))
    return best.select(group, "brow", "bcol", "__m.pixel_id", "__m.d2").withColumn(
        "row", grid_row(F.col("pixel_id"), n_col)).withColumn(
        "col", grid_col(F.col("pixel_id"), n_col))


def spacing_conflicts(reps: DataFrame, group: str, min_d2: int) -> DataFrame:
    """Edges from a representative to a better one that is too close.

    Only the eight surrounding blocks can conflict, so the eight shifted copies
    meet their neighbours in one equi-join: at most eight edges per cell. Estimates
    leave out the copies and what the file packs, so the join is told not to broadcast.
    """
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for a, b in NEIGHBOURS])
    left = reps.withColumn("__o", F.explode(shift)).select(
        group, F.col("pixel_id").alias("src"), F.col("row").alias("__r"),
        F.col("col").alias("__c"), F.col("d2").alias("__d"),
        (F.col("brow") + F.col("__o.a")).alias("brow"),
        (F.col("bcol") + F.col("__o.b")).alias("bcol"))
    j = left.hint("merge").join(reps, [group, "brow", "bcol"])
    dr, dc = F.col("row") - F.col("__r"), F.col("col") - F.col("__c")
    better = (F.col("d2") < F.col("__d")) | (
        (F.col("d2") == F.col("__d")) & (F.col("pixel_id") < F.col("src")))
    return j.where((dr * dr + dc * dc < min_d2) & better).select(
        group, "src", F.col("pixel_id").alias("dst"),
        (dr * dr + dc * dc).alias("dist2"))


def enforce_spacing(reps: DataFrame, group: str, min_d2: int,
                    rounds: int = 100) -> DataFrame:
    """Representatives kept by the greedy minimum-spacing pass.

    A round accepts every undecided cell without a better undecided neighbour
    and rejects the neighbours of those, which is what the one-by-one greedy
    would do. Only cells with a conflict take part; their number shrinks each
    round. Rounds are cut from their lineage on shared storage.
    """
    edges = cut_lineage(spacing_conflicts(reps, group, min_d2)
                        .select(group, "src", "dst"))
    key = [group, "src"]
    dropped = None
    live = edges
    for _ in range(rounds):
        if live.isEmpty():
            break
        blocked = live.select(*key).distinct()
        nodes = live.select(group, F.col("dst").alias("src")).distinct()
        accepted = nodes.join(blocked, key, "left_anti")
        rejected = (live.join(accepted.select(group, F.col("src").alias("dst")),
                              [group, "dst"], "left_semi").select(*key).distinct())
        rejected = cut_lineage(rejected)
        dropped = rejected if dropped is None else dropped.unionByName(rejected)
        # an edge stays while both ends are undecided; the neighbours of an
        # accepted cell were all rejected, so removing these covers both cases
        live = live.join(rejected, key, "left_anti").join(
            rejected.select(group, F.col("src").alias("dst")), [group, "dst"],
            "left_anti")
        live = cut_lineage(live.select(group, "src", "dst"))
    else:
        raise RuntimeError("spacing pass failed to converge")
    if dropped is None:
        return reps
    return reps.join(dropped.withColumnRenamed("src", "pixel_id"),
                     [group, "pixel_id"], "left_anti")


def spaced_sample(df: DataFrame, group: str, n_col: int, block: int, centre: int,
                  whole_groups: Sequence[str] = ()) -> DataFrame:
    """Thin each group to cells at least ``block`` apart; some groups stay whole."""
    whole = F.col(group).isin(list(whole_groups)) if whole_groups else F.lit(False)
    reps = block_representatives(df.where(~whole), group, n_col, block, centre)
    kept = enforce_spacing(reps, group, block * block).select(group, "pixel_id")
    kept = kept.withColumn("rule_applied", F.lit("spacing"))
    if not whole_groups:
        return kept
    return kept.unionByName(df.where(whole).select(group, "pixel_id").withColumn(
        "rule_applied", F.lit("whole_group")))


def cell_density(df: DataFrame, group: Sequence[str],
                 cell: Sequence[str]) -> DataFrame:
    """Occupied exact cells per group: count, median and lower quartile of size."""
    whole = F.lit(True)
    for c in cell:
        whole = whole & F.col(c).isNotNull()
    n = df.where(whole).groupBy(*group, *cell).agg(F.count(F.lit(1)).alias("units"))
    q = exact_quantiles(n, group, "units", {"median": .5, "q25": .25})
    return null_safe_join(n.groupBy(*group).agg(F.count(F.lit(1)).alias("n_cells")), q,
                          list(group))


def cells_emptied(before: DataFrame, after: DataFrame, group: Sequence[str],
                  cell: Sequence[str]) -> DataFrame:
    """Exact cells per group that lost their last unit."""
    a = before.select(*group, *cell).distinct()
    b = after.select(*group, *cell).distinct().withColumn("__left", F.lit(1))
    return null_safe_join(a, b, [*group, *cell], "left").where(
        F.col("__left").isNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n_emptied"))


def spacing_check(sample: DataFrame, group: str, n_col: int, block: int,
                  centre: int) -> DataFrame:
    """Per group: cells, blocks holding two, and pairs that sit too close."""
    b = block_columns(sample, n_col, block, centre)
    dup = b.groupBy(group, "brow", "bcol").agg(F.count(F.lit(1)).alias("n"))
    a = dup.groupBy(group).agg(
        F.sum("n").alias("n_cells"),
        F.sum((F.col("n") > 1).cast("long")).alias("n_blocks_shared"))
    close = spacing_conflicts(b, group, block * block).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_close"))
    return a.join(close, group, "left").withColumn(
        "n_close", F.coalesce("n_close", F.lit(0)))


def nearest_distance(cells: DataFrame, n_col: int, sample: int | None = None, seed: int = 0,
                     size: float = 30.0, tile: int = 8) -> DataFrame:
    """Distance to the nearest other cell, for all cells or a bounded seeded sample.

    The cells (``sample=None``: every one, else at most ``sample``) look in their own
    and the eight surrounding tiles. A distance no longer than the tile is final; the
    others descend through a pyramid of occupied tiles. A cell alone on its grid has none.
    """
    base = cells.select(
        "pixel_id", grid_row(F.col("pixel_id"), n_col).alias("row"),
        grid_col(F.col("pixel_id"), n_col).alias("col"))
    if sample is None:
        todo = base
    else:
        todo = cut_lineage(first_k_per_group(
            base.withColumn("__g", F.lit(1)).withColumn(
                "__o", seeded_order(F.col("pixel_id"), seed)),
            ["__g"], "__o", "pixel_id", sample).select("pixel_id", "row", "col"))
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for a, b in [(0, 0), *NEIGHBOURS]])
    q = todo.withColumn("__o", F.explode(shift)).select(
        F.col("pixel_id").alias("id"), F.col("row").alias("r"), F.col("col").alias("c"),
        (F.floor(F.col("row") / tile) + F.col("__o.a")).alias("tr"),
        (F.floor(F.col("col") / tile) + F.col("__o.b")).alias("tc"))
    near = cut_lineage(todo.join(_nearest_in(q, base, tile), "pixel_id", "left"))
    sure = F.col("d2") <= tile * tile
    far = near.where(~F.coalesce(sure, F.lit(False))).drop("d2")
    done = near.where(sure)
    if not far.isEmpty():
        done = done.unionByName(_nearest_by_tiles(far, base, tile).select(*done.columns))
    return done.select("pixel_id", (F.sqrt("d2") * size).alias("distance"))


def _nearest_in(asked: DataFrame, base: DataFrame, tile: int) -> DataFrame:
    """Smallest squared distance of asked (id, r, c, tr, tc) to other cells of the tiles.

    Estimates leave out the copies of the asked, so the join is told not to broadcast.
    """
    other = base.withColumn("tr", F.floor(F.col("row") / tile)).withColumn(
        "tc", F.floor(F.col("col") / tile))
    dr, dc = F.col("row") - F.col("r"), F.col("col") - F.col("c")
    return asked.hint("merge").join(other, ["tr", "tc"]).where(F.col("pixel_id") != F.col("id")).groupBy(
        F.col("id").alias("pixel_id")).agg(F.min(dr * dr + dc * dc).alias("d2"))


def _nearest_by_tiles(far: DataFrame, base: DataFrame, tile: int, wide: int = 4) -> DataFrame:
    """Nearest other cell by descending through occupied tiles.

    Counts per tile are kept for every width, each ``wide`` times the one below, up to one
    tile over all. A search starts there and goes into the occupied tiles whose nearest
    corner is no farther than the farthest corner of some other occupied tile: a bounded
    number at each width, wherever the cells lie. Only the last tiles give up their cells.
    """
    # rows and columns start at zero, so tiles end up in one
    levels = [(tile, cut_lineage(base.groupBy(
        F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
        .agg(F.count(F.lit(1)).alias("n"))))]
    while levels[-1][1].count() > 1:
        size, below = levels[-1]
        up = below.groupBy(F.floor(F.col("tr") / wide).alias("tr"),
                           F.floor(F.col("tc") / wide).alias("tc")).agg(F.sum("n").alias("n"))
        levels.append((size * wide, cut_lineage(up)))
    top = levels[-1][1].select("tr", "tc")
    cand = far.select(F.col("pixel_id").alias("id"), F.col("row").alias("r"), F.col("col").alias("c")
                      ).crossJoin(top)  # one row
    for size, tiles in reversed(levels[:-1]):
        kids = small_side(tiles.select(
            F.floor(F.col("tr") / wide).alias("__pr"), F.floor(F.col("tc") / wide).alias("__pc"),
            F.col("tr").alias("__r"), F.col("tc").alias("__c"), "n"))
        j = cand.join(kids, (F.col("tr") == F.col("__pr")) & (F.col("tc") == F.col("__pc"))).select(
            "id", "r", "c", F.col("__r").alias("tr"), F.col("__c").alias("tc"), "n")

        def gap(at: str, lo: Column, size=size) -> tuple[Column, Column]:
            hi = lo + size - 1
            return (F.greatest(lo - F.col(at), F.col(at) - hi, F.lit(0)),
                    F.greatest(F.abs(F.col(at) - lo), F.abs(F.col(at) - hi)))

        (rn, rx), (cn, cx) = gap("r", F.col("tr") * size), gap("c", F.col("tc") * size)
        own = (rn == 0) & (cn == 0) & (F.col("n") == 1)  # nobody there but the cell itself
        j = j.where(~own).withColumn("__lo", rn * rn + cn * cn).withColumn("__hi", rx * rx + cx * cx)
        reach = F.min("__hi").over(Window.partitionBy("id"))  # a cell's few candidates
        cand = cut_lineage(j.withColumn("__reach", reach).where("__lo <= __reach").select(
            "id", "r", "c", "tr", "tc"))
    return far.join(_nearest_in(cand, base, tile), "pixel_id", "left")


def classes_registry(spark, classes: Mapping[int, str]) -> DataFrame:
    return registry(spark, ["code", "lulc"], list(classes.items()))
