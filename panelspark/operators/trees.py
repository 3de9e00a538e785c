"""Boosted-tree treatment scores for every level at once.

Covariates are cut into bins at quantiles of their level. A round is one pass over the
binned rows: a task adds up gradient, curvature and count by (level, node, covariate,
bin), and the best split of every open node of every level is read off the summed
histogram. So there is one job per depth and tree, whatever the number of levels, and
what tasks send back is bounded by nodes x covariates x bins of a level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.core import exact_quantiles, null_safe_join, small_side
from panelspark.session import cut_lineage

MAX_CELLS = 20_000_000  # histogram cells of a round: levels x nodes x covariates x bins


@dataclass(frozen=True)
class Boost:
    """Shape of the ensemble; ``keep`` is the least number of rows of a leaf."""

    trees: int = 20
    depth: int = 4
    bins: int = 32
    rate: float = 0.1
    ridge: float = 1.0
    keep: int = 10


@dataclass
class Tree:
    """One tree of one level. Node i of a depth has the children 2 i and 2 i + 1.

    ``column`` and ``cut`` of each depth give the split (bin <= cut goes left); a column
    of -1 sends every row left, which ends a branch.
    """

    column: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: np.ndarray | None = None

    def node(self, bins: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for column, cut in zip(self.column, self.cut):
            c = column[at]
            at = 2 * at + ((c >= 0) & (bins[row, c] > cut[at]))
        return at


def level_cuts(df: DataFrame, by: Sequence[str], covariates: Sequence[str],
               bins: int) -> DataFrame:
    """Per level its number, share of treated and, by covariate, the limits of its bins."""
    t = F.col("treat").cast("double")
    table = df.groupBy(*by).agg(F.avg(t).alias("share"))
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    for c in covariates:
        q = exact_quantiles(df, by, c, probs, kind=1).select(
            *by, F.array_sort(F.array_distinct(F.array(*probs))).alias(f"__cut_{c}"))
        table = null_safe_join(table, q, by, "left")
    return cut_lineage(table.withColumn("__lev", F.monotonically_increasing_id()))


def _bin(covariate: str) -> Column:
    """Number of limits below the value."""
    value = F.col(covariate).cast("double")
    cuts = F.coalesce(f"__cut_{covariate}", F.array().cast("array<double>"))
    return F.size(F.filter(cuts, lambda q: q < value))


def binned_rows(df: DataFrame, table: DataFrame, by: Sequence[str],
                covariates: Sequence[str]) -> DataFrame:
    """(lev, y, bins): a value's bin is the number of limits below it."""
    j = null_safe_join(df, small_side(table.drop("share")), list(by))
    return cut_lineage(j.select("__lev", F.col("treat").cast("double").alias("y"),
                                F.array(*[_bin(c) for c in covariates]).alias("bins")))


def _scores(trees: list[Tree], start: float, rate: float, bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), start)
    for t in trees:
        out += rate * t.leaf[t.node(bins)]
    return out


def _parts(batches):
    """(level, y, bins) of the batches, level by level."""
    for b in batches:
        if not b.num_rows:
            continue
        lev, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        bins = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
        order = np.argsort(lev, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lev[order])) + 1):
            yield int(lev[part[0]]), y[part], bins[part]


def _histograms(rows: DataFrame, model: dict, growing: dict[int, Tree], boost: Boost,
                p: int) -> dict[int, np.ndarray]:
    """Per level the sums (gradient, curvature, rows) by node, covariate and bin."""
    sent = rows.sparkSession.sparkContext.broadcast((model, growing))
    cells = p * boost.bins

    def run(batches):
        model, growing = sent.value
        total: dict[int, np.ndarray] = {}
        for lev, y, bins in _parts(batches):
            start, trees = model[lev]
            mu = 1 / (1 + np.exp(-_scores(trees, start, boost.rate, bins)))
            tree = growing[lev]
            nodes = 2 ** len(tree.column)
            at = ((tree.node(bins) * p)[:, None] + np.arange(p)) * boost.bins + bins
            s = np.stack([np.bincount(at.ravel(), np.repeat(w, p), nodes * cells)
                          for w in (y - mu, mu * (1 - mu), np.ones(len(y)))])
            total[lev] = total.get(lev, 0.0) + s
        for lev, s in total.items():
            on = np.flatnonzero(s[2].ravel())
            yield pa.record_batch({"__lev": np.full(len(on), lev), "cell": on.astype(np.int64),
                                   "g": s[0][on], "h": s[1][on], "n": s[2][on]})

    part = rows.mapInArrow(run, "__lev long, cell long, g double, h double, n double")
    got = part.groupBy("__lev", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    sent.destroy()
    lev, cell = got.column("__lev").to_numpy(), got.column("cell").to_numpy()
    out = {}
    for k in np.unique(lev):
        mine = lev == k
        hist = np.zeros((3, 2 ** len(growing[int(k)].column) * cells))
        for i, c in enumerate("ghn"):
            hist[i, cell[mine]] = got.column(c).to_numpy()[mine]
        out[int(k)] = hist.reshape(3, -1, p, boost.bins)
    return out


def _grow(tree: Tree, hist: np.ndarray, boost: Boost) -> None:
    """Best split of each node (ties: first covariate, then lowest bin) and leaf values."""
    left = np.cumsum(hist, axis=3)
    whole = left[:, :, :1, -1:]
    right = left[:, :, :, -1:] - left

    def worth(s):
        return s[0] ** 2 / (s[1] + boost.ridge)

    gain = worth(left) + worth(right) - worth(whole)
    allowed = (left[2] >= boost.keep) & (right[2] >= boost.keep)
    gain = np.where(allowed, np.round(gain, 9), -1.0).reshape(gain.shape[0], -1)
    best = gain.argmax(axis=1)
    split = gain[np.arange(len(best)), best] > 0
    column, cut = np.where(split, best // boost.bins, -1), best % boost.bins
    tree.column.append(column)
    tree.cut.append(cut)
    at = (np.arange(len(best)), np.maximum(column, 0), cut)
    sides = [np.where(split, left[0][at] / (left[1][at] + boost.ridge),
                      whole[0, :, 0, 0] / (whole[1, :, 0, 0] + boost.ridge)),
             np.where(split, right[0][at] / (right[1][at] + boost.ridge), 0.0)]
    tree.leaf = np.stack(sides, axis=1).ravel()


def fit_trees(rows: DataFrame, levels: list, p: int, boost: Boost) -> dict:
    """Level -> (starting score, trees). ``levels`` are rows with lev and share."""
    if len(levels) * 2 ** max(boost.depth - 1, 0) * p * boost.bins > MAX_CELLS:
        raise ValueError(f"{len(levels)} levels need more than {MAX_CELLS} histogram cells")
    model = {}
    for r in levels:
        share = min(max(r["share"], 1e-6), 1 - 1e-6)
        model[r["__lev"]] = (float(np.log(share / (1 - share))), [])
    for _ in range(boost.trees):
        growing = {lev: Tree() for lev in model}
        for _ in range(boost.depth):
            for lev, hist in _histograms(rows, model, growing, boost, p).items():
                _grow(growing[lev], hist, boost)
        for lev, tree in growing.items():
            model[lev][1].append(tree)
    return model


def fitted_trees(df: DataFrame, by: Sequence[str], covariates: Sequence[str],
                 boost: Boost = Boost()) -> tuple[DataFrame, dict]:
    """Level table with the limits of the bins, and the trees of every level."""
    table = level_cuts(df, by, covariates, boost.bins)
    rows = binned_rows(df, table, by, covariates)
    return table, fit_trees(rows, table.select("__lev", "share").collect(), len(covariates), boost)


def split_table(df: DataFrame, by: Sequence[str], covariates: Sequence[str],
                boost: Boost = Boost()) -> DataFrame:
    """(by, tree, depth, node, covariate, cut): the splits; values up to ``cut`` go left.

    Node i has the children 2 i and 2 i + 1 of the next depth.
    """
    table, model = fitted_trees(df, by, covariates, boost)
    rows = [(lev, t, d, i, covariates[c], int(b))
            for lev, (_, trees) in model.items() for t, tree in enumerate(trees)
            for d, (column, cut) in enumerate(zip(tree.column, tree.cut))
            for i, (c, b) in enumerate(zip(column, cut)) if c >= 0]
    made = df.sparkSession.createDataFrame(
        rows, "__lev long, tree int, depth int, node int, covariate string, bin int")
    cut = F.coalesce(*[F.when(F.col("covariate") == c, F.get(f"__cut_{c}", F.col("bin")))
                       for c in covariates])
    return made.join(table, "__lev").select(*by, "tree", "depth", "node", "covariate",
                                          cut.alias("cut"))


def boosted_scores(df: DataFrame, by: Sequence[str], covariates: Sequence[str],
                   boost: Boost = Boost(), out: str = "score") -> DataFrame:
    """``df`` with the log-odds score of each row under the trees of its level.

    Gradient boosting of the logistic loss with Newton leaf values. Bins are cut at exact
    quantiles of the level, a row without a covariate counts as lowest. Levels with one
    side only keep the score of their share. Scoring is one pass without a shuffle.
    """
    table, model = fitted_trees(df, by, covariates, boost)
    j = null_safe_join(df, small_side(table.drop("share")), list(by))
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded as the histograms are

    def score(lev: pa.Array, cells: pa.Array) -> pa.Array:
        got, number = np.zeros(len(lev)), lev.to_numpy()
        x = cells.flatten().to_numpy().reshape(len(lev), -1)
        for k in np.unique(number):
            mine = number == k
            start, trees = sent.value[int(k)]
            got[mine] = _scores(trees, start, boost.rate, x[mine])
        return pa.array(got)

    run = F.arrow_udf(score, "double")
    return j.select(*df.columns, run("__lev", F.array(*[_bin(c) for c in covariates])).alias(out))
