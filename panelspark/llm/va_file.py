"""Exact top-k by inner product with a vector-approximation file.

Every vector is quantised, one byte for each dimension: the number of its cell. Cells of
a dimension are cut at quantiles of a sample, so outliers do not widen the others. A scan
of the cells alone bounds every score from both sides; a vector whose upper bound falls
short of the k-th best lower bound is out. The exact vectors of the rest are then read in
the order of their bounds until no bound left can reach the k-th score found.

Equal vectors are one entry of the file with their smallest ids, so copies cost one
bound. Bounds and scores are compared with the ids, which also settles ties.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import write_stage

CELLS = 64           # of a dimension
SAMPLE = 8_192       # vectors that the cells' limits are taken from
SHARD = 1 << 20      # components of the vectors that meet a block of queries in one task
BLOCK = 1_024        # queries of a block
FIRST = 4            # times k: exact vectors read in the first round
LARGEST = 2.0 ** 55  # sum of squares from which a vector takes no part
LAST_ID = 2 ** 63 - 1


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every component; null for vectors that take no part.

    Those are null or empty, hold a null, NaN or infinite component, or their sum of
    squares is beyond ``LARGEST``, so that a bound might leave a long.
    """
    v = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c), F.lit(False)))
    squares = F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)
    return F.when(fine & (F.size(v) > 0) & (squares < F.lit(LARGEST)),
                  F.transform(v, lambda c: F.floor(c)))


# -- the file ---------------------------------------------------------------------------

def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, x, ids): each vector once, with its k + 1 smallest ids.

    More ids of one vector never come first k times, the query's own left out. The window
    keeps k + 1 rows of a vector in every task before the shuffle, so copies without
    number stay few. Null ids come last, as the largest number.
    """
    order = Window.partitionBy("x").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    one = few.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return write_stage(one.select(F.monotonically_increasing_id().alias("node"), "x", "ids"),
                       "vectors")


def cell_limits(nodes: DataFrame, d: int) -> list[np.ndarray]:
    """Smallest whole numbers of the cells of each dimension, and one beyond the last.

    Inner limits are quantiles of a bounded sample (``SAMPLE`` vectors with the smallest
    hash), the outer ones the extremes over all vectors, so every vector has its cell.
    """
    ends = (nodes.select(F.posexplode("x")).groupBy("pos")
            .agg(F.min("col").alias("lo"), F.max("col").alias("hi")).collect())
    span = {r["pos"]: (r["lo"], r["hi"]) for r in ends}  # a row per dimension
    rows = (nodes.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow())
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
    out = []
    for j in range(d):
        lo, hi = span[j]
        cut = np.quantile(x[:, j], np.arange(1, CELLS) / CELLS, method="lower").astype(np.int64)
        cut = np.unique(cut[(cut > lo) & (cut <= hi)])
        out.append(np.concatenate(([lo], cut, [hi + 1])).astype(np.int64))
    return out


def _codes(x: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "right") - 1 for j, c in enumerate(limits)],
                    axis=1).astype(np.uint8)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    c = batch.column(name)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def approximation_file(nodes: DataFrame, limits: list[np.ndarray]) -> DataFrame:
    """(node, low, cells): the quantised vectors with their smallest id."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = _codes(_vectors(b, "x"), limits)
                yield pa.record_batch({
                    "node": b.column("node"), "low": b.column("low"),
                    "cells": pa.array([r.tobytes() for r in codes], pa.binary())})

    given = nodes.select("node", F.col("ids")[0].alias("low"), "x")
    return write_stage(given.mapInArrow(run, "node long, low long, cells binary"), "cells")


# -- the scan -----------------------------------------------------------------------------

def _survivors(q: np.ndarray, lows: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
    """(query, entry, upper bound, lower bound) of entries that may be among the first k.

    A product is largest at one end of a cell and smallest at the other, so bounds are
    the middle of the cell, plus and minus its half width by the sizes of ``q``; they are
    doubled to stay whole, and exact: in doubles where every sum fits, else in 64 bits.
    An entry is out if k others have lower bounds above its upper bound, or equal ones
    and smaller ids.
    """
    middle, width = lo + hi, hi - lo
    size = np.abs(q).max(axis=0).astype(float) @ (
        np.abs(middle).max(axis=0).astype(float) + width.max(axis=0))
    kind = np.float64 if size < 2.0 ** 52 else np.int64
    q, middle, width = (x.astype(kind) for x in (q, middle.T, width.T))
    for at in range(0, len(q), 64):
        part = q[at:at + 64]
        centre, spread = part @ middle, np.abs(part) @ width
        upper, lower = centre + spread, centre - spread
        if len(lows) > k:
            kth = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
            worst = np.empty(len(part), np.int64)
            for i, t in enumerate(kth):  # the largest id among the first k lower bounds
                above = int((lower[i] > t).sum())
                worst[i] = np.partition(lows[lower[i] == t], k - above - 1)[k - above - 1]
            keep = (upper > kth[:, None]) | ((upper == kth[:, None])
                                             & (lows[None, :] <= worst[:, None]))
        else:
            keep = np.ones(upper.shape, bool)
        i, j = np.nonzero(keep)
        yield at + i, j, upper[i, j].astype(np.int64), lower[i, j].astype(np.int64)


def scan(cells: DataFrame, queries: DataFrame, limits: list[np.ndarray], k: int,
         shards: int, blocks: int) -> DataFrame:
    """(query, node, low, upper, lower): entries that the bounds of their shard leave open.

    Cells are dealt into shards, queries into blocks; every block meets every shard in
    one task of bounded size, as the stated queries go against all rows.
    """
    def part(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = cells.withColumn("shard", part("node", shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", part("node", blocks)).withColumn("shard", every(shards))

    def meet(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "node": [], "low": [], "upper": [], "lower": []}
        if entries.num_rows and asked.num_rows:
            node, low = (entries.column(c).to_numpy() for c in ("node", "low"))
            codes = np.frombuffer(b"".join(entries.column("cells").to_pylist()), np.uint8)
            codes = codes.reshape(len(node), -1)
            lo = np.stack([c[codes[:, j]] for j, c in enumerate(limits)], axis=1)
            hi = np.stack([c[codes[:, j] + 1] - 1 for j, c in enumerate(limits)], axis=1)
            ids = asked.column("node").to_numpy()
            q = asked.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            for i, j, up, down in _survivors(q, low, lo, hi, k):
                for name, v in (("query", ids[i]), ("node", node[j]), ("low", low[j]),
                                ("upper", up), ("lower", down)):
                    out[name].append(v)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64)
                         for c, v in out.items()})

    return (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
            .applyInArrow(meet, "query long, node long, low long, upper long, lower long"))


# -- exact vectors ------------------------------------------------------------------------

def _exact(wanted: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, node, score): exact vectors read for the wanted entries."""
    q = queries.select(F.col("node").alias("query"), F.col("x").alias("qx"))
    both = wanted.select("query", "node").join(nodes.select("node", "x"), "node").join(q, "query")
    score = F.aggregate(F.zip_with("x", "qx", lambda a, b: a * b), F.lit(0).cast("long"),
                        lambda a, b: a + b)
    return both.select("query", "node", score.alias("score"))


def _first(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_entries(found: DataFrame, nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, node, score): the first k entries of every query.

    Rounds read exact vectors in falling order of the upper bound, each round four times
    as many; a query is certain once the next bound cannot reach its k-th score, or can
    reach it only with a larger id.
    """
    lows = nodes.select("node", F.col("ids")[0].alias("low"))
    left, known, take = found, None, FIRST * k
    while True:
        ranked = left.withColumn("turn", F.row_number().over(
            Window.partitionBy("query").orderBy(F.desc("upper"), "low", "node")))
        read = write_stage(_exact(ranked.where(F.col("turn") <= take), nodes, queries)
                           .join(lows, "node"), "scores")
        known = read if known is None else known.unionByName(read)
        best = write_stage(_first(known, ["query"], [F.desc("score"), F.asc("low")], k), "best")
        kth = best.where(F.col("rank") == k).select(
            "query", (F.col("score") * 2).alias("kth"), F.col("low").alias("last"))
        rest = (ranked.where(F.col("turn") > take).drop("turn").join(kth, "query", "left")
                .where(F.col("kth").isNull() | (F.col("upper") > F.col("kth"))
                       | ((F.col("upper") == F.col("kth")) & (F.col("low") < F.col("last")))))
        left = write_stage(rest.drop("kth", "last"), "open")
        if left.isEmpty():
            return best.select("query", "node", "score")
        known, take = best.drop("rank"), take * 4


def _of_length(rows: DataFrame, asked: DataFrame, d: int, k: int) -> DataFrame:
    """(id, cand, score): at least the first k candidates of the asking rows of length d."""
    nodes = distinct_vectors(rows, k)
    mine = write_stage(asked.join(nodes.select("x", "node"), "x").select("id", "node"), "asked")
    queries = write_stage(nodes.select("node", "x").join(
        mine.select("node").distinct(), "node", "left_semi"), "queries")
    limits = cell_limits(nodes, d)
    # an own id may stand among the first entries, so one more is looked for
    found = write_stage(scan(
        approximation_file(nodes, limits), queries, limits, k + 1,
        math.ceil(nodes.count() * d / SHARD), math.ceil(queries.count() / BLOCK)), "bounds")
    best = best_entries(found, nodes, queries, k + 1)
    ids = best.join(nodes.select("node", F.explode("ids").alias("cand")), "node").select(
        F.col("query").alias("node"), "score", "cand")
    return mine.join(ids, "node").where(F.col("cand") != F.col("id")).select("id", "cand", "score")


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of
    another id; ties go to the smaller id. Components become whole numbers
    floor(scale * c) first; the score is exact.

    Vectors that are null, empty or hold a null or non-finite component take no part (nor
    those whose squares add up to 2^55 when scaled: scores must fit a long). A query meets
    vectors of its own length only. Rows that repeat an id and vector are one candidate,
    and one query; an id with several vectors asks with each, its best k answers stand, and
    as candidate each of them counts. Null ids ask nothing and come last among ties; all of
    them are one id. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    rows = write_stage(
        vectors.select(own.alias("id"), whole_vector(F.col(vector_col), scale).alias("x"))
        .where("x IS NOT NULL").groupBy("id", "x").agg(F.lit(1).alias("one")).drop("one"),
        "rows")
    asked = rows.where((F.col("id") % every == 0) & (F.col("id") != LAST_ID))
    lengths = asked.select(F.size("x").alias("d")).distinct().collect()  # a row per length
    out = spark.createDataFrame([], "id long, cand long, score long")
    for r in sorted(lengths):
        same = F.size("x") == r["d"]
        out = out.unionByName(_of_length(rows.where(same), asked.where(same), r["d"], k))
    # an id that asks with vectors of several lengths has one list
    out = _first(out, ["id"], [F.desc("score"), F.asc("cand")], k)
    return out.select(
        F.col("id").cast(kind).alias("query_id"), "rank",
        F.when(F.col("cand") != LAST_ID, F.col("cand")).cast(kind).alias(id_col), "score")
