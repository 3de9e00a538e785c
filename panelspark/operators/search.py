"""Nearest free controls of large exact cells, by a space-partition tree.

The controls of a cell lie in the leaves of a tree of median splits, each along the axis
on which the controls spread most. The splits come from a bounded sample, which shapes
the work and never the result; a leaf's box is the true range of its controls. A search
reads the leaf of the treated unit first and then every leaf whose box is no farther than
the last control kept. It keeps the ``KEPT`` nearest, so that most proposals of later
rounds need no search.

Equally near controls are ordered by a mix of both ids, which is a rotation of the
controls' own order. Crowded leaves, such as copies of one point, are cut by that order,
and a search reads the cut in which its rotation starts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

KEPT = 32
SAMPLE = 400_000    # controls whose coordinates shape the trees, over all cells
TASK_ROWS = 4_096   # treated units that meet a leaf in one task
MATRIX = 1_000_000  # distances that a task holds at once, however many controls a leaf has
FEW = 200_000       # rows (n, id) up to which a round sends them to every task
HELD = "n long, cid long, prio double, tid long, dist double"
M = 1_000_003       # the mix of ids: (t * 7919 + c * 104729) mod M


def spread(t: Column, c: Column) -> Column:
    """Order of equally near controls; differs between treated units."""
    return F.pmod(F.pmod(t, F.lit(M)) * 7919 + F.pmod(c, F.lit(M)) * 104_729, F.lit(M))


@dataclass
class Tree:
    """Splits of one cell: a node goes left up to its cut; leaves are ~(leaf number)."""

    axis: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        if not self.axis:
            return at
        axis, cut, left, right = (np.array(v) for v in (self.axis, self.cut, self.left, self.right))
        open_ = np.arange(len(x))
        while len(open_):
            k = at[open_]
            at[open_] = np.where(x[open_, axis[k]] <= cut[k], left[k], right[k])
            open_ = open_[at[open_] >= 0]
        return ~at


def grow(x: np.ndarray, size: int) -> tuple[Tree, int]:
    """Tree over sample points ``x`` with at most ``size`` of them in a leaf that can split."""
    tree, leaves = Tree([], [], [], []), 0
    stack = [(np.arange(len(x)), None, None)]
    while stack:
        rows, parent, side = stack.pop()
        own, low, high = x[rows], None, None
        if len(rows) > size:
            low, high = own.min(axis=0), own.max(axis=0)
        if low is None or not (high > low).any():
            name, leaves = ~leaves, leaves + 1
        else:
            a = int(np.argmax(high - low))
            v = np.sort(own[:, a])
            cut = v[(len(v) - 1) // 2]
            if cut == v[-1]:  # more than half are equal and largest: cut below them
                cut = v[np.searchsorted(v, cut) - 1]
            name = len(tree.axis)
            for field, value in ((tree.axis, a), (tree.cut, float(cut)), (tree.left, 0), (tree.right, 0)):
                field.append(value)
            stack += [(rows[own[:, a] <= cut], name, tree.left), (rows[own[:, a] > cut], name, tree.right)]
        if parent is not None:
            side[parent] = name
    return tree, leaves


class Boxes:
    """Leaves of one cell: box per axis (coordinates, score, limited columns) and cuts."""

    def __init__(self, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray, cuts: np.ndarray):
        k = np.repeat(np.arange(len(leaf)), cuts)
        self.leaf, self.lo, self.hi = leaf[k], lo[k], hi[k]
        self.sub = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        self.first = -(-self.sub * M // cuts[k])
        self.last = -(-(self.sub + 1) * M // cuts[k]) - 1

    def bounds(self, x, tid, s, cal, v, vcal) -> tuple[np.ndarray, np.ndarray]:
        """(distance, mix) that no control of the leaf goes below; infinite if out of reach."""
        p = x.shape[1]
        d2 = np.zeros((len(x), len(self.leaf)))
        for a in range(p):
            gap = np.maximum(np.maximum(self.lo[:, a] - x[:, a:a + 1], x[:, a:a + 1] - self.hi[:, a]), 0)
            d2 += gap * gap
        d = np.sqrt(d2) * (1 - 1e-12)  # a bound, whatever the rounding
        for at, value, reach in [(p, s, cal)] + [(p + 1 + i, v[:, i], vcal[:, i]) for i in range(v.shape[1])]:
            gap = np.maximum(self.lo[:, at] - value[:, None], value[:, None] - self.hi[:, at])
            d[gap > reach[:, None] + 1e-9 * np.abs(reach[:, None])] = np.inf  # nan: no limit
        turn = (tid % M * 7919 % M)[:, None]
        start = (M - turn) % M
        inside = (self.first <= start) & (start <= self.last)
        return d, np.where(inside, 0, (self.first + turn) % M)


def _floats(column) -> np.ndarray:
    """Arrays of one length as a matrix; nulls are nan."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _meet(t: pa.Table, c: pa.Table, has_cal: bool, has_lim: bool) -> pa.Table:
    """(n, tid, cid, m, d): per treated unit the controls of one leaf that it would take first.

    Treated units go through in slices, so that no matrix of distances grows with the leaf.
    """
    out: dict[str, list] = {k: [] for k in ("n", "tid", "cid", "m", "d")}
    if t.num_rows and c.num_rows:
        t, c = t.combine_chunks(), c.combine_chunks()

        def col(table, name):
            return table.column(name).to_numpy()

        def mat(table, name):
            return _floats(table.column(name).combine_chunks())

        cx, cid, cs, cv = mat(c, "cx"), col(c, "cid"), col(c, "cs"), mat(c, "cv")
        hp, ht = col(c, "hp").astype(float), c.column("ht").to_pandas().to_numpy(float, na_value=np.nan)
        step = max(1, MATRIX // len(cx))
        for at in range(0, t.num_rows, step):
            own = t.slice(at, step)
            tx, tid, prio = mat(own, "tx"), col(own, "tid"), col(own, "prio")
            d2 = np.zeros((len(tx), len(cx)))
            for a in range(cx.shape[1]):  # axis by axis, as one cell in one task adds up
                gap = cx[:, a] - tx[:, a:a + 1]
                d2 += gap * gap
            d = np.sqrt(d2)
            ok = np.isnan(hp) | (hp > prio[:, None]) | ((hp == prio[:, None]) & (ht > tid[:, None]))
            if has_cal:
                ok &= np.abs(cs - col(own, "ts")[:, None]) <= col(own, "cal").astype(float)[:, None]
            if has_lim:
                tv, reach = mat(own, "tv"), mat(own, "vcal")
                for a in range(tv.shape[1]):
                    ok &= np.abs(cv[:, a] - tv[:, a:a + 1]) <= reach[:, a:a + 1]
            d = np.where(ok, d, np.inf)
            if d.shape[1] > KEPT:
                kth = np.partition(d, KEPT - 1, axis=1)[:, KEPT - 1:KEPT]
                i, j = np.nonzero((d <= kth) & np.isfinite(d))
            else:
                i, j = np.nonzero(np.isfinite(d))
            mix = (tid[i] % M * 7919 + cid[j] % M * 104_729) % M
            order = np.lexsort((cid[j], mix, d[i, j], i))
            i, j, mix = i[order], j[order], mix[order]
            place_ = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, mix = (z[place_ < KEPT] for z in (i, j, mix))
            for name, v in (("n", col(own, "n")[i]), ("tid", tid[i]), ("cid", cid[j]), ("m", mix), ("d", d[i, j])):
                out[name].append(v)
    kinds = {k: float if k == "d" else np.int64 for k in out}
    return pa.table({k: np.concatenate(v).astype(kinds[k]) if v else np.zeros(0, kinds[k])
                     for k, v in out.items()})


class Search:
    """Trees and boxes of all large cells, sent to the workers once; their size is bounded."""

    def __init__(self, rows: DataFrame, size: int, report: dict | None = None):
        """``rows``: (n, treat, id, x, s, v, ...) with the number ``n`` of the cell."""
        self.size, sc = size, rows.sparkSession.sparkContext
        self.compared = sc.accumulator(0) if report is not None else None
        controls = rows.where("treat = 0")
        many = controls.count()
        thin = max(1, -(-many // SAMPLE))
        got = controls.where(F.pmod(F.xxhash64("id"), F.lit(thin)) == 0).select("n", "x").toArrow()
        number, x = got.column("n").to_numpy(), _floats(got.column("x").combine_chunks())
        trees = {r["n"]: grow(x[number == r["n"]], size)[0]
                 for r in rows.select("n").distinct().collect()}
        self.trees = sc.broadcast(trees)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        sent = self.trees

        def place(batches):
            for b in batches:
                n, x = b.column("n").to_numpy(), _floats(b.column("x"))
                leaf = np.zeros(len(n), np.int64)
                for k in np.unique(n):
                    leaf[n == k] = sent.value[k].leaf(x[n == k])
                yield b.append_column("leaf", pa.array(leaf))

        self.rows = cut_lineage(rows.mapInArrow(place, kind + ", leaf long"))
        c = self.rows.where("treat = 0")
        axes = F.concat("x", F.array("s"), "v")
        wide = c.select("n", "leaf", F.posexplode(axes).alias("a", "y")).groupBy("n", "leaf", "a").agg(
            F.min("y").alias("lo"), F.max("y").alias("hi"))
        ends = wide.groupBy("n", "leaf").agg(F.sort_array(F.collect_list(F.struct("a", "lo", "hi"))).alias("e"))
        sizes = c.groupBy("n", "leaf").agg(F.count(F.lit(1)).alias("k")).join(ends, ["n", "leaf"]).orderBy(
            "n", "leaf").collect()  # a row per leaf
        boxes, self.cuts = {}, {}
        for k in {r["n"] for r in sizes}:
            mine = [r for r in sizes if r["n"] == k]
            cuts = np.array([max(1, -(-r["k"] // (4 * size * thin))) for r in mine])
            boxes[k] = Boxes(np.array([r["leaf"] for r in mine]),
                             np.array([[e["lo"] for e in r["e"]] for r in mine], float),
                             np.array([[e["hi"] for e in r["e"]] for r in mine], float), cuts)
            self.cuts |= {(k, r["leaf"]): int(m) for r, m in zip(mine, cuts) if m > 1}
        self.boxes = sc.broadcast(boxes)
        self.controls = cut_lineage(self._cut(c))

    def _cut(self, controls: DataFrame) -> DataFrame:
        """Controls with the cut of their leaf that holds their place in the common order."""
        crowded = controls.sparkSession.createDataFrame(
            [(k, leaf, m) for (k, leaf), m in self.cuts.items()], "n long, leaf long, cuts long")
        own = F.pmod(F.pmod("id", F.lit(M)) * 104_729, F.lit(M))
        return controls.join(F.broadcast(crowded), ["n", "leaf"], "left").withColumn(  # as many as leaves
            "sub", F.floor(own * F.coalesce("cuts", F.lit(1)) / M).cast("long")).drop("cuts")

    def _leaves(self, asked: DataFrame, many: int | None) -> DataFrame:
        """(n, tid, leaf, sub): the ``many`` nearest leaves, or all within the bound (bd, bs)."""
        sent = self.boxes

        def run(batches):
            for b in batches:
                n, tid = b.column("n").to_numpy(), b.column("tid").to_numpy()
                x, v, vcal = (_floats(b.column(c)) for c in ("tx", "tv", "vcal"))
                s, cal, bd, bs = (b.column(c).to_numpy(zero_copy_only=False).astype(float)
                                  for c in ("ts", "cal", "bd", "bs"))
                for k in np.unique(n):
                    own, box = np.flatnonzero(n == k), sent.value[k]
                    step = max(1, 2_000_000 // len(box.leaf))
                    for at in range(0, len(own), step):
                        i = own[at:at + step]
                        d, mix = box.bounds(x[i], tid[i], s[i], cal[i], v[i], vcal[i])
                        if many is None:
                            near, far = bd[i, None], bs[i, None]
                            t, f = np.nonzero((d < near) | ((d <= near) & (mix <= far)))
                        else:
                            order = np.lexsort((mix, d), axis=1)[:, :many]
                            t = np.repeat(np.arange(len(i)), order.shape[1])
                            f = order.ravel()
                            ok = np.isfinite(d[t, f])
                            t, f = t[ok], f[ok]
                        yield pa.record_batch({"n": np.full(len(t), k), "tid": tid[i][t],
                                               "leaf": box.leaf[f], "sub": box.sub[f]})

        return asked.select("n", "tid", "tx", "ts", "tv", "cal", "vcal", "bd", "bs").mapInArrow(
            run, "n long, tid long, leaf long, sub long")

    def _kept(self, asked: DataFrame, many: int | None, holds: DataFrame | None,
              has_cal: bool, has_lim: bool) -> DataFrame:
        """(n, tid, cid, d, m, rank): the nearest controls that each unit may still win."""
        pairs = cut_lineage(self._leaves(asked, many).join(
            asked.select("n", "tid", "prio", "tx", "ts", "tv", "cal", "vcal"), ["n", "tid"]))
        place = ["n", "leaf", "sub"]
        parts = pairs.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).alias("parts"))
        left = pairs.join(parts, place).withColumn(
            "part", F.pmod(F.xxhash64("tid"), F.col("parts"))).drop("parts")
        c = self.controls.select(*place, F.col("id").alias("cid"), F.col("x").alias("cx"),
                                 F.col("s").alias("cs"), F.col("v").alias("cv"))
        if holds is None:
            c = c.withColumns({"hp": F.lit(None).cast("double"), "ht": F.lit(None).cast("long")})
        else:
            c = c.join(holds.select("n", "cid", F.col("prio").alias("hp"), F.col("tid").alias("ht")),
                       ["n", "cid"], "left")
        c = c.join(parts, place).withColumn("part", F.explode(
            F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        seen = self.compared

        def meet(t: pa.Table, c: pa.Table) -> pa.Table:
            if seen is not None:
                seen.add(t.num_rows * c.num_rows)
            return _meet(t, c, has_cal, has_lim)

        key = [*place, "part"]
        got = left.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(
            meet, "n long, tid long, cid long, m long, d double")
        w = Window.partitionBy("n", "tid").orderBy("d", "m", "cid")
        return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= KEPT)

    def nearest(self, asked: DataFrame, holds: DataFrame | None, has_cal: bool,
                has_lim: bool) -> tuple[DataFrame, DataFrame]:
        """Lists (n, tid, cid, d, rank) of the nearest controls a unit may win, and the units
        (n, tid) whose list holds all of them."""
        names, none = asked.columns, F.lit(None)
        lists, whole, many = [], [], 4
        todo = asked.withColumns({"bd": none.cast("double"), "bs": none.cast("long")})
        most = max((len(b.leaf) for b in self.boxes.value.values()), default=0)
        while True:
            first = cut_lineage(self._kept(todo, many, holds, has_cal, has_lim))
            edge = first.where(F.col("rank") == KEPT).select(
                "n", "tid", F.col("d").alias("bd"), F.col("m").alias("bs"))
            if many >= most:  # every leaf in reach has been read; a list cut at KEPT may lack some
                lists.append(first)
                whole.append(todo.select("n", "tid").join(edge, ["n", "tid"], "left_anti"))
                break
            sure = cut_lineage(todo.select(*names).join(edge, ["n", "tid"]))
            if not sure.isEmpty():
                lists.append(cut_lineage(self._kept(sure, None, holds, has_cal, has_lim)))
            todo = cut_lineage(todo.join(edge, ["n", "tid"], "left_anti"))
            if todo.isEmpty():
                break
            many *= 16
        out, full = lists[0], todo.select("n", "tid").limit(0)
        for more in lists[1:]:
            out = out.unionByName(more)
        for more in whole:
            full = full.unionByName(more)
        return out.select("n", "tid", "cid", "d", "rank"), full


def _few(rows: DataFrame) -> DataFrame:
    """Rows of a written table, sent to every task if they were counted to be few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def match_rounds(rows: DataFrame, has_cal: bool, has_lim: bool, size: int,
                 report: dict | None = None) -> DataFrame:
    """(n, tid, cid, dist) of cells too large for one task, by rounds of proposals.

    Every free unit proposes to the first control of its list that no better unit holds; a
    control keeps its best proposer. Units whose list is used up wait, and search again
    once they are as many as those that propose; no order of the proposals changes the
    matching. A round reads what concerns its free units.
    ``report`` receives the number of pairs whose distance was computed.
    """
    search = Search(rows, size, report)
    treated = search.rows.where("treat = 1").select(
        "n", F.col("id").alias("tid"), "prio", F.col("x").alias("tx"), F.col("s").alias("ts"),
        F.col("v").alias("tv"), "cal", "vcal")
    key, place = ["n", "tid"], ["n", "cid"]
    lists, full = search.nearest(treated, None, has_cal, has_lim)
    lists, full, free, waiting = cut_lineage(lists), cut_lineage(full), treated, None
    holds = treated.sparkSession.createDataFrame([], HELD)
    while True:
        mine = free.select(*key, "prio")
        h = holds.select(*place, F.col("prio").alias("hp"), F.col("tid").alias("ht"))
        live = lists.join(_few(mine), key).join(h, place, "left").where(
            F.col("hp").isNull() | (F.col("hp") > F.col("prio"))
            | ((F.col("hp") == F.col("prio")) & (F.col("ht") > F.col("tid"))))
        best = cut_lineage(live.groupBy(*key, "prio").agg(F.min(F.struct("rank", "cid", "d")).alias("b")))
        spent = free.join(best.select(*key), key, "left_anti").join(full, key, "left_anti")
        waiting = cut_lineage(spent if waiting is None else spent.unionByName(waiting))
        first = best.select("n", "b.cid", "prio", "tid", F.col("b.d").alias("dist"))
        many = waiting.count()
        if many and many >= best.count():
            # their old lists may stay: whoever holds a control gives way to better units only
            more, done = search.nearest(waiting, holds, has_cal, has_lim)
            more = cut_lineage(more)
            lists, full = lists.unionByName(more), cut_lineage(full.unionByName(done))
            first = first.unionByName(more.where("rank = 1").join(
                waiting.select(*key, "prio"), key).select(
                "n", "cid", "prio", "tid", F.col("d").alias("dist")))
            waiting, many = None, 0
        pool = cut_lineage(first.unionByName(holds))
        holds = cut_lineage(pool.groupBy(*place).agg(F.min(F.struct("prio", "tid", "dist")).alias("h")).select(
            *place, "h.prio", "h.tid", "h.dist"))
        lost = pool.select(*key).join(holds.select(*key), key, "left_anti")
        free = cut_lineage(treated.join(lost, key, "left_semi"))
        if not many and free.isEmpty():
            break
    if report is not None:
        report["compared"] = search.compared.value
    return holds.select("n", "tid", "cid", "dist")
