"""SimHash near-duplicates by pigeonhole blocks.

64 bits are cut into six blocks. Two fingerprints that differ in at most four bits agree
on two blocks at least, so they meet in one of the fifteen joins on a pair of blocks
(21 or 22 equal bits each); the distance is then checked.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.shared import write_stage

RADIUS = 4
BLOCKS = (11, 11, 11, 11, 10, 10)
CROWD = 4096  # fingerprints of a bucket that one task takes; larger ones are cut further


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spans(sizes) -> list[int]:
    """Masks of neighbouring runs of bits."""
    ends = np.cumsum([0, *sizes])
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in pairwise(ends)]


_HALVES = [_spans([k // 2, k - k // 2]) for k in BLOCKS]
HALVES = [[h << sum(BLOCKS[:i]) for h in pair] for i, pair in enumerate(_HALVES)]


def masks() -> dict[int, list[int]]:
    """Mask of each pair of blocks -> its finer masks.

    Eight half blocks lie outside a pair. At most four differ, so four agree: a finer
    mask adds four half blocks, which leaves at most 24 free bits.
    """
    out = {}
    for pair in combinations(range(len(BLOCKS)), 2):
        own = sum(h for i in pair for h in HALVES[i])
        rest = [h for i in range(len(BLOCKS)) if i not in pair for h in HALVES[i]]
        out[_signed(own)] = [_signed(own | sum(c)) for c in combinations(rest, 4)]
    return out


def fingerprint_bits(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """Majority fingerprint of the XXH64 of word shingles, repeats included."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(shingle, len(words)) - 1:].tolist()
    first = [0, *(ends[:len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(first, last)), np.uint64, len(last))
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        part = h[k:k + 8192].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """Signed 64-bit fingerprint of a text column; null and empty texts have 0."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint_bits((t.as_py() or "").encode().lower().split(),
                                                  shingle, seed)) for t in texts], pa.int64())
    return F.arrow_udf(run, "long").asNondeterministic()(text)


def spanning_edges(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (root, member) that connect what the bucket's links connect.

    A member that is reached leaves the pool, so a crowd of close fingerprints costs few
    passes and gives one link per member, never all pairs.
    """
    pool, out = np.unique(fps), []
    while len(pool) > 1:
        root, pool, queue = pool[0], pool[1:], [pool[0]]
        while queue and len(pool):
            near = np.bitwise_count((pool ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                hit = pool[near]
                out += [(int(root), int(x)) for x in hit]
                queue += list(hit)
                pool = pool[~near]
    return out


def _bucket_links(members: DataFrame) -> DataFrame:
    """Members (mask, part, fp) -> links; buckets are bounded by the caller."""
    def run(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())]))
        return pa.array([[{"u": u, "v": v} for u, v in spanning_edges(
            x.values.to_numpy(zero_copy_only=False))] for x in lists], kind)

    spread = F.arrow_udf(run, "array<struct<u:long,v:long>>").asNondeterministic()
    return (members.groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"))
            .select(F.explode(spread("fps")).alias("e")).select("e.u", "e.v"))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` that connect all pairs within 4 bits.

    Bucket sizes are counted first. Two members are compared at once; up to ``crowd``
    meet in one task; a larger bucket is dealt again by the finer masks, which bounds a
    group by its free bits. The size only picks the way, the links connect the same.
    """
    fine = masks()
    keyed = prints.select("fp", F.explode(F.array(*map(F.lit, fine))).alias("mask"))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    sizes = write_stage(
        keyed.groupBy("mask", "part")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1"), "buckets")
    two = sizes.where((F.col("n") == 2)
                      & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v")
    some = keyed.join(sizes.where((F.col("n") > 2) & (F.col("n") <= crowd))
                      .select("mask", "part"), ["mask", "part"])
    out = two.union(_bucket_links(some))
    hot = sizes.where(F.col("n") > crowd).select("mask", "part")
    if not hot.isEmpty():
        table = F.create_map(*[x for k, v in fine.items()
                               for x in (F.lit(k), F.array(*map(F.lit, v)))])
        cut = (keyed.join(hot, ["mask", "part"])
               .select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
               .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"))
        out = out.union(_bucket_links(cut.distinct()))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    crowd: int = CROWD) -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``.

    Equal fingerprints are one node, so exact copies and empty or null texts (fingerprint
    0) cost one row whatever their number. component_id is the smallest id reachable;
    null ids are never the smallest, and a component of null ids only has none. Repeated
    rows stay repeated; an empty table gives no rows.
    """
    # a column of this name may be there already: only two columns are taken along
    prints = write_stage(docs.select(F.col(id_col), simhash(F.col(text_col)).alias("fp")),
                         "fingerprints")
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    nodes = components(links(first.select("fp"), crowd))
    linked = nodes.join(first, nodes["node"] == first["fp"]).select("node", "root", "first")
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    group = linked.join(low, "root").select(F.col("node").alias("fp"), "low")
    # written apart: a plain table on both sides lets Spark split a crowded fingerprint
    ids = write_stage(first.join(group, "fp", "left").select(
        "fp", F.coalesce("low", "first").alias("component_id")), "components")
    return prints.join(ids, "fp").select(id_col, "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
