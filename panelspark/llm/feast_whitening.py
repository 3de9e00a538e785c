"""Embedding whitening; components by FEAST contour integration.

The covariance is gathered by Spark in one pass of centred block products. Its leading
components are found interval by interval: on a circle around an eigenvalue interval the
quadrature sum of shifted solves (z I - V)^-1 Y projects a block Y onto the wanted
eigenvectors; Rayleigh-Ritz extracts them, and the projection is repeated until residuals
vanish. The solves are independent, so they are tasks of a Spark job. How many
eigenvalues an interval holds is known from inertia (signs of a factorisation of V - s I),
and a component that is missing is noticed and looked for again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import write_stage

COMPONENTS = 8
POINTS = 8           # quadrature points on the upper half circle
CLOSE = 1e-5         # of the norm: nearer eigenvalues share an interval
ROUNDS = 20
MAX_DIM = 8192       # the covariance is held by the driver and sent to workers
MAX_ENTRY = 2.0 ** 40  # whole entries up to it add up in 64 bits


# -- clean vectors and the covariance -------------------------------------------------

def whole_entries(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every entry; null for vectors that take no part.

    Those are null or empty, hold a null, NaN or infinite entry, or one whose scaled value
    is beyond 2^40, too large to be added up exactly.
    """
    v = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.forall(v, lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c) < F.lit(MAX_ENTRY)), F.lit(False)))
    return F.when(fine & (F.size(v) > 0),
                  F.transform(v, lambda c: F.floor(c) + F.lit(shift).cast("long")))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _slices(batches, column: int, rows: int = 4096):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, _matrix(part, column)


def fit_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S): rows and sums per dimension of ``x``, exact; a row per dimension is read."""
    def run(batches):
        n, total = 0, None
        for _, x in _slices(batches, 0):
            n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.record_batch({"n": [n], "s": pa.array([total], pa.list_(pa.int64()))})

    part = fit.select("x").mapInArrow(run, "n long, s array<long>")
    got = (part.select("n", F.posexplode("s")).groupBy("pos")
           .agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect())
    if not got:
        return 0, np.zeros(0, np.int64)
    return got[0]["n"], np.array([r["s"] for r in got], np.int64)


def centred_products(fit: DataFrame, centre: np.ndarray, turn: np.ndarray | None = None
                     ) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows and of their outer products, rows being (x - centre) @ turn.

    A task adds up its own rows; tasks are added by matrix row, so the driver gets one
    matrix of dimension size.
    """
    def run(batches):
        first = second = 0.0
        for _, x in _slices(batches, 0):
            w = x - centre
            w = w if turn is None else w @ turn
            first, second = first + w.sum(axis=0), second + w.T @ w
        if not np.isscalar(second):
            yield pa.record_batch({
                "i": np.arange(len(second), dtype=np.int32), "a": np.atleast_1d(first),
                "v": pa.array(list(second), pa.list_(pa.float64()))})

    part = fit.select("x").mapInArrow(run, "i int, a double, v array<double>")
    rows = (part.select("i", "a", F.posexplode("v")).groupBy("i", "pos")
            .agg(F.sum("a").alias("a"), F.sum("col").alias("v"))
            .groupBy("i").agg(F.first("a").alias("a"),
                              F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
            .select("i", "a", F.col("v.v").alias("v")).orderBy("i").toArrow())
    return (rows.column("a").to_numpy(),
            rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(rows), -1))


# -- eigenvalue counts and contour projections -------------------------------------------

def inertia_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie above ``shift``.

    Signs of the blocks of a symmetric factorisation of v - shift I with diagonal pivots
    of size one or two (Bunch and Kaufman): congruence keeps the signs.
    """
    a = v - shift * np.eye(len(v))
    alpha, above = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        column = np.abs(a[1:, 0])
        big = column.max(initial=0.0)
        size = 1
        if abs(a[0, 0]) < alpha * big:
            r = 1 + int(column.argmax())
            row = np.abs(a[r]).copy()
            row[r] = 0.0
            if abs(a[0, 0]) * row.max() < alpha * big * big:
                swap = 0 if abs(a[r, r]) >= alpha * row.max() else 1
                size = 1 + swap
                order = np.arange(len(a))
                order[[swap, r]] = order[[r, swap]]
                a = a[np.ix_(order, order)]
        d, c = a[:size, :size], a[size:, :size]
        if size == 1:
            above += d[0, 0] > 0
            a = a[1:, 1:] - (c / d[0, 0] @ c.T if d[0, 0] else 0.0)
        else:
            det = d[0, 0] * d[1, 1] - d[0, 1] ** 2
            above += 1 if det < 0 else 2 * (d[0, 0] + d[1, 1] > 0)
            a = a[2:, 2:] - c @ np.linalg.inv(d) @ c.T
    return int(above)


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) around the ``wanted`` largest, highest first.

    Counts locate one eigenvalue after the other by bisection; those nearer than
    ``CLOSE`` share an interval, with the whole of their group. An interval reaches half
    way to the nearest eigenvalue outside, so that the contour keeps its distance.
    """
    d, top = len(v), (float(np.abs(v).sum(axis=1).max()) or 1.0) * 1.000001
    known = {top: 0, -top: d}

    def bracket(k: int) -> tuple[float, float]:
        a = max(s for s, n in known.items() if n >= k)
        b = min(s for s, n in known.items() if n < k)
        while b - a > CLOSE / 10 * top:
            m = (a + b) / 2
            known[m] = inertia_above(v, m)
            a, b = (m, b) if known[m] >= k else (a, m)
        return a, b

    groups: list[list[tuple[float, float]]] = []
    below, k = -top, 0
    while k < d:
        at = bracket(k + 1)
        if groups and groups[-1][-1][0] - at[1] < CLOSE * top:
            groups[-1].append(at)
        elif k >= wanted:
            below = at[1]
            break
        else:
            groups.append([at])
        k += 1
    out, above = [], 2 * top
    for i, g in enumerate(groups):
        low, high = g[-1][0], g[0][1]
        under = groups[i + 1][0][1] if i + 1 < len(groups) else below
        reach = min(low - under, above - high) / 2
        inside = inertia_above(v, low - reach) - inertia_above(v, high + reach)
        out.append((low - reach, high + reach, inside))
        above = low
    return out


def contour_tasks(spans: list[tuple[float, float, int]]) -> list[tuple[int, complex, complex]]:
    """(interval, shift z, weight) for Gauss-Legendre points on each upper half circle."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    out = []
    for k, (low, high, _) in enumerate(spans):
        r = (high - low) / 2
        turn = np.exp(1j * np.pi / 2 * (nodes + 1))
        out += [(k, complex((low + high) / 2 + r * t), complex(w * r * t / 2))
                for t, w in zip(turn, weights)]
    return out


def _project(spark: SparkSession, sent, spans, blocks: dict[int, np.ndarray]
             ) -> dict[int, np.ndarray]:
    """Quadrature sums of the shifted solves: one task per contour point."""
    d = len(next(iter(blocks.values())))
    tasks = [t for t in contour_tasks(spans) if t[0] in blocks]
    given = spark.sparkContext.broadcast(blocks)  # at most MAX_DIM x a few columns each
    table = spark.createDataFrame(pa.table({
        "k": pa.array([t[0] for t in tasks], pa.int32()),
        **{name: pa.array([f(t) for t in tasks], pa.float64()) for name, f in (
            ("zr", lambda t: t[1].real), ("zi", lambda t: t[1].imag),
            ("wr", lambda t: t[2].real), ("wi", lambda t: t[2].imag))}}))

    def run(batches):
        v = sent.value
        for b in batches:
            for r in b.to_pylist():
                y = given.value[r["k"]]
                x = np.linalg.solve(complex(r["zr"], r["zi"]) * np.eye(d) - v, y)
                x = (complex(r["wr"], r["wi"]) * x).real
                yield pa.record_batch({"k": pa.array([r["k"]], pa.int32()),
                                       "q": pa.array([x.ravel()], pa.list_(pa.float64()))})

    parts = min(len(tasks), 4 * spark.sparkContext.defaultParallelism)
    out = {k: 0.0 for k in blocks}
    got = table.repartition(parts).mapInArrow(run, "k int, q array<double>").toArrow()
    for k, q in zip(got.column("k").to_pylist(), got.column("q")):
        out[k] = out[k] + q.values.to_numpy().reshape(d, -1)
    given.destroy()
    return out


def leading_components(spark: SparkSession, v: np.ndarray, wanted: int
                       ) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as columns), falling, of a symmetric matrix.

    Raises if an interval does not give up as many eigenvalues as its inertia count.
    """
    d, scale = len(v), float(np.abs(v).max())
    v = v / scale
    spans = intervals(v, wanted)
    sent = spark.sparkContext.broadcast(v)  # MAX_DIM bounds it
    rng = np.random.default_rng(12)
    block = {k: rng.standard_normal((d, min(d, n + 2)))
             for k, (_, _, n) in enumerate(spans)}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(ROUNDS):
        for k, q in _project(spark, sent, spans, block).items():
            low, high, n = spans[k]
            left, size, _ = np.linalg.svd(q, full_matrices=False)
            basis = left[:, size > size[0] * 1e-14]
            ritz, turn = np.linalg.eigh(basis.T @ v @ basis)
            x = basis @ turn
            inside = (ritz > low) & (ritz < high)
            worst = np.abs(v @ x[:, inside] - x[:, inside] * ritz[inside]).max(initial=0.0)
            if inside.sum() == n and worst <= np.finfo(float).eps * d * max(1.0, abs(high)):
                found[k] = ritz[inside], x[:, inside]
                del block[k]
            elif inside.sum() == n or x.shape[1] >= d:
                block[k] = x
            else:  # room for the eigenvalues that the count says are missing
                block[k] = np.hstack((x, rng.standard_normal((d, min(d - x.shape[1], n)))))
        if not block:
            break
    sent.destroy()
    if block:
        raise ArithmeticError(f"components missing in {[spans[k] for k in block]}")
    e = np.concatenate([found[k][0] for k in found])
    x = np.hstack([found[k][1] for k in found])
    order = np.argsort(-e)[:wanted]
    return e[order] * scale, x[:, order]


# -- the operator ---------------------------------------------------------------------------

def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Rows x components: whitened coordinates of every vector that takes part.

    (id, component, n, deviation, whitened, explained, identity_error). Entries become
    whole numbers floor(scale * c) + shift; n, their sums and each row's deviation, the
    sum of (n x - S)^2 over dimensions, are exact (null where it is beyond a long).

    Vectors that are null, empty or hold a null or non-finite entry (or one beyond 2^40
    when scaled) take no part; nor do those of another length than the most frequent
    (longest among equals). Repeated rows and rows without an id count like any other.
    Components without variance (eigenvalue within rounding of zero) do not exist; fewer
    than ``components`` are returned then, for constant vectors or an empty table none.
    Equal eigenvalues leave their vectors free; any orthonormal choice is returned.
    Other columns are not looked at.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(id_col), whole_entries(F.col(vector_col), scale, shift).alias("x"))
    fit = write_stage(x.where("x IS NOT NULL"), "vectors")
    lengths = (fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    kind = (f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, "
            "deviation long, whitened double, explained double, identity_error double")
    if not lengths:
        return spark.createDataFrame([], kind)
    d = lengths[0]["d"]
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} entries; the covariance is held for {MAX_DIM} at most")
    fit = fit.where(F.size("x") == d)
    n, total = fit_sums(fit)
    centre = total / n
    cov = centred_products(fit, centre)[1] / n
    cov = (cov + cov.T) / 2
    trace = float(np.trace(cov))
    noise = d * np.finfo(float).eps * trace * 16
    wanted = min(components, d, inertia_above(cov, noise) if trace > 0 else 0)
    if wanted == 0:
        return spark.createDataFrame([], kind)
    e, vecs = leading_components(spark, cov, wanted)
    turn = vecs / np.sqrt(e)
    first, second = centred_products(fit, centre, turn)
    mean = first / n
    error = float(np.abs(second / n - np.outer(mean, mean) - np.eye(wanted)).max())
    share = e / trace

    def run(batches):
        for b, x in _slices(batches, 1):
            w = (x - centre) @ turn
            whole = x.astype(object) if _wide(x, n, total) else x
            apart = n * whole - total
            dev = (apart * apart).sum(axis=1)
            dev = pa.array([int(v) if v < 2 ** 63 else None for v in dev], pa.int64())
            row = np.repeat(np.arange(len(x)), wanted)
            yield pa.record_batch({
                id_col: b.column(0).take(pa.array(row)),
                "component": np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x)),
                "n": np.full(len(row), n, np.int64), "deviation": dev.take(pa.array(row)),
                "whitened": w.ravel(), "explained": np.tile(share, len(x)),
                "identity_error": np.full(len(row), error)})

    return fit.mapInArrow(run, kind)


def _wide(x: np.ndarray, n: int, total: np.ndarray) -> bool:
    """Whether sums of (n x - total)^2 may leave 64 bits, products included."""
    high, low = x.max(axis=0).astype(float), x.min(axis=0).astype(float)
    gap = np.maximum(np.abs(n * high - total), np.abs(n * low - total)) * 1.01 + 1
    return bool((gap ** 2).sum() >= 2.0 ** 62 or n * np.abs([high, low]).max() >= 2.0 ** 62
                or np.abs(total.astype(float)).max() >= 2.0 ** 62)
