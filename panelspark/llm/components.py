"""Connected components over an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import cut_lineage


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): each node of the edges with the smallest node it can reach.

    Rounds of two star steps. Step one hangs the larger neighbours of every node on the
    smallest of its neighbourhood; step two hangs the smaller ones there. Minima combine
    before the shuffle and edges join them by node, so no neighbourhood is ever gathered;
    a node with very many edges is a skewed join that Spark splits. Rounds end when the
    edges stay the same, after about log(longest chain) of them; each round's edges go to
    the checkpoint folder. Null ends and loops are left out; an empty table gives none.
    """
    e = cut_lineage(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
                    .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
                    .distinct())
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select("b", "a"))
        low = both.groupBy("n").agg(F.least("n", F.min("m")).alias("lo"))
        large = (both.where("m > n").join(low, "n")
                 .select(F.col("m").alias("a"), F.col("lo").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = (large.join(low, "a")
                 .select(F.when(F.col("b") == F.col("lo"), F.col("a"))
                         .otherwise(F.col("b")).alias("a"), F.col("lo").alias("b"))
                 .where("a <> b").distinct())
        e = cut_lineage(small)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select("b", "b").distinct())
