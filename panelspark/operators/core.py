"""Building blocks shared by the operators.

Two rules hold throughout. A hint to broadcast is given only to literal
registries whose length is known; everything else is left to the optimiser. And
no window is partitioned by a key that can hold a large share of the rows:
order statistics go through :func:`ordered_cumulative`, which splits each group
into value buckets first.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

REGISTRY_LIMIT = 10_000
PARTS = 4096         # value buckets per octave
CROWDED = 200_000    # distinct values above which a bucket is split again
SPLIT = 1024         # parts of a crowded bucket


def registry(spark: SparkSession, columns: Sequence[str],
             rows: Sequence[tuple]) -> DataFrame:
    """A literal table, broadcast because its length is checked here."""
    rows = list(rows)
    if not 0 < len(rows) <= REGISTRY_LIMIT:
        raise ValueError(f"a registry holds 1..{REGISTRY_LIMIT} rows")
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)})
    return F.broadcast(spark.createDataFrame(table))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the left copy of each key stays."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])


def finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def _octave_bucket(v: Column) -> Column:
    """Bucket number that never decreases in ``v``: 4,096 parts per octave.

    Exponent and leading digits of the number; both ways of writing a power of
    two give the same bucket, so rounding in the logarithm is harmless.
    """
    a = F.abs(v)
    e = F.floor(F.log2(a))
    part = F.floor((a / F.pow(F.lit(2.0), e.cast("double")) - 1) * PARTS)
    code = (e + 1100) * PARTS + part
    return F.when(v > 0, code).when(v < 0, -code).otherwise(F.lit(0)).cast("long")


def ordered_cumulative(df: DataFrame, keys: Sequence[str], value: str,
                       sums: dict[str, Column | str], whole: bool = False) -> DataFrame:
    """Exact running totals in value order for groups of any size.

    One row per (keys, distinct value) with, for each name in ``sums``, the
    total at the value (``name``), the total over smaller values
    (``name_before``) and the group total (``name_all``).

    Equal values are pre-aggregated map-side. Each group is then cut into
    buckets by value, crowded buckets once more by their own range, and only
    the bucket totals (a bounded number) are accumulated across the group, so
    no task ever sorts a whole group. Every step is a deterministic function of
    the data: a recomputed task gives the same buckets. Keys travel as one
    struct, which matches nulls and keeps one partitioning throughout. ``whole``
    keeps integers as they are, so that ids beyond 2**53 stay apart. The constants
    above only shape the plan, never the result.
    """
    keys, names = list(keys), list(sums)
    key = F.struct(*keys) if keys else F.lit(0)
    v = F.col("__v")
    exprs = [(F.sum(F.expr(s) if isinstance(s, str) else s)).alias(n)
             for n, s in sums.items()]
    number = F.col(value).cast("long") if whole else F.col(value).cast("double") + F.lit(0.0)
    d = (df.where(finite(F.col(value)))
         .groupBy(key.alias("__k"), number.alias("__v")).agg(*exprs)
         .select("*", _octave_bucket(v.cast("double")).alias("__b1")))
    # every branch below reads all columns of ``d``, so its shuffle is shared
    group = Window.partitionBy("__k")
    range_ = d.groupBy("__k", "__b1").agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
        F.count(F.lit(1)).alias("__n"), *[F.sum(n).alias(f"__t_{n}") for n in names]
    ).select("__k", "__b1", "__lo", "__hi", "__n", *[
        F.sum(f"__t_{n}").over(group).alias(f"{n}_all") for n in names])
    lo, hi = F.col("__lo").cast("double"), F.col("__hi").cast("double")
    step = F.when((F.col("__n") > CROWDED) & (hi > lo), F.least(
        F.floor((v.cast("double") - lo) / (hi - lo) * SPLIT), F.lit(SPLIT - 1))).otherwise(F.lit(0))
    d = d.join(range_, ["__k", "__b1"]).select(
        "__k", "__b1", step.cast("long").alias("__b2"), "__v", *names,
        *[f"{n}_all" for n in names])
    bucket = ["__k", "__b1", "__b2"]
    # backwards, since a frame open at its start is summed in one sweep
    onward = Window.partitionBy("__k").orderBy(
        F.col("__b1").desc(), F.col("__b2").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    offs = d.groupBy(*bucket).agg(
        *[F.sum(n).alias(f"__t_{n}") for n in names],
        *[F.max(f"{n}_all").alias(f"__a_{n}") for n in names]).select(
        *bucket, *[(F.col(f"__a_{n}") - F.sum(f"__t_{n}").over(onward))
                   .alias(f"__o_{n}") for n in names])
    inside = Window.partitionBy(*bucket).orderBy("__v").rowsBetween(
        Window.unboundedPreceding, -1)
    return d.join(offs, bucket).select(
        *[F.col(f"__k.{k}").alias(k) for k in keys],
        F.col("__v").alias(value), *names,
        *[(F.col(f"__o_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
          .alias(f"{n}_before") for n in names],
        *[f"{n}_all" for n in names])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float | tuple[float, Column]],
                    kind: int = 7) -> DataFrame:
    """Exact quantiles per group, one column per name in ``probs``.

    A probability may come with a condition on the rows it is taken over; all
    of them share one pass. ``kind`` 7 interpolates between order statistics, 1
    inverts the empirical distribution. The order statistics are picked by rank
    from the running counts, so a group of any size is spread over tasks.
    """
    conds: dict[str, Column] = {}
    plan = []
    for name, p in probs.items():
        prob, cond = p if isinstance(p, tuple) else (p, None)
        known = {str(c): t for t, c in conds.items() if c is not None}
        tag = known.get(str(cond), f"__w{len(conds)}") if cond is not None else "__w"
        conds.setdefault(tag, cond)
        plan.append((name, float(prob), tag))
    c = ordered_cumulative(df, keys, value, {
        t: F.lit(1) if k is None else k.cast("long") for t, k in conds.items()})
    aggs = []
    for name, p, t in plan:
        n, lo = F.col(f"{t}_all"), F.col(f"{t}_before")
        hi = lo + F.col(t)

        def at(rank: Column, lo=lo, hi=hi) -> Column:
            return F.max(F.when((lo <= rank) & (rank < hi), F.col(value)))

        if kind == 1:
            aggs.append(at(F.greatest(F.ceil(n * F.lit(p) - F.lit(1e-9)) - 1, F.lit(0)))
                        .alias(name))
            continue
        h = (n - 1) * F.lit(p)
        k = F.floor(h)
        low, high = at(k), at(F.least(k + 1, n - 1))
        aggs.append((low + F.max(h - k) * (high - low)).alias(name))
    return c.groupBy(*keys).agg(*aggs)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, rank) with ties sharing their average rank."""
    c = ordered_cumulative(df, keys, value, {"n": F.lit(1)})
    return c.select(*keys, value, "n", (
        F.col("n_before") + (F.col("n") + 1) / 2).cast("double").alias("rank"))


def first_k_per_group(df: DataFrame, keys: Sequence[str], digest: str,
                      tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group that come first by a hex digest column.

    Groups are cut by the leading digits of the digest. Whole cuts below the
    k-th row are kept as they are; only the one cut holding the k-th row is
    ordered, and that is one part in 65,536 of its group.
    """
    keys = list(keys)
    d = df.withColumn("__cut", F.substring(digest, 1, 4))
    w = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(
        Window.unboundedPreceding, -1)
    cuts = d.groupBy(*keys, "__cut").agg(F.count(F.lit(1)).alias("__n"))
    cuts = cuts.withColumn(
        "__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    cuts = cuts.where(F.col("__before") < k)
    d = null_safe_join(d, cuts, [*keys, "__cut"])
    whole = (F.col("__before") + F.col("__n")) <= k
    inside = Window.partitionBy(*keys, "__cut").orderBy(digest, tie)
    edge = (d.where(~whole)
            .withColumn("__rn", F.row_number().over(inside))
            .where(F.col("__before") + F.col("__rn") <= k).drop("__rn"))
    return (d.where(whole).unionByName(edge)
            .drop("__cut", "__n", "__before"))


def global_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Dense 1-based position in a total order over the whole table.

    A range sort places the rows, the copy is cut from its lineage so that the
    partitions are fixed, and partition sizes (one row per partition) give the
    offsets.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn(
        "__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    placed = placed.withColumn("__part", part).withColumn(
        "__pos", F.col("__mid") - F.shiftleft(F.col("__part"), 33))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offs = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        F.col("__part"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (placed.join(offs, "__part")
            .withColumn(name, F.col("__off") + F.col("__pos") + 1)
            .drop("__mid", "__part", "__pos", "__off"))


def small_side(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """A join side whose size was counted: broadcast up to ``limit`` rows.

    Beyond the limit the join is left to the optimiser (sort-merge with skew
    handling). The table is written once, so the count costs no second run.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Fail the job on the first row for which ``bad`` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean"))
                    .otherwise(F.lit(True)))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits))
