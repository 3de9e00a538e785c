"""Passages that repeat across documents, by sparse suffix arrays.

A suffix is kept at a word position only if the k words from there have the smallest
hash of some ``window`` neighbouring positions. Two equal passages of k + window - 1
words keep suffixes at the same places, so each shares one whose first k words match.
Kept suffixes with equal heads are sorted by what follows and by what precedes, compared
with their neighbours, and extended to both sides as far as a passage of the least length
can reach. A word is repeated if it lies in some passage of that length that another
document has as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import WordHasher, mixed
from panelspark.llm.shared import write_stage

MIN_WORDS = 50
WINDOW = 31
CROWD = 200_000  # suffixes with one head that one task takes; others are counted by passage
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _powers(BACK, n - k + 1))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def minimiser_places(keys: np.ndarray, window: int) -> np.ndarray:
    """Positions whose key is the smallest of some ``window`` neighbouring keys."""
    if len(keys) < window:
        return np.zeros(0, np.int64)
    low = _sliding(keys, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), window, np.maximum)
    return np.flatnonzero(best == keys)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _contexts(h: np.ndarray, at: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Per place: ``reach`` words that follow the head, as many that precede it (nearest
    first), 32 bits each, and how many of each there are."""
    short = (h >> np.uint64(32)).astype("<u4")
    padded = np.concatenate([np.zeros(reach, "<u4"), short, np.zeros(reach, "<u4")])
    step = np.arange(reach)
    right = padded[at[:, None] + reach + k + step]
    left = padded[at[:, None] + reach - 1 - step]
    room = np.stack([np.minimum(len(h) - at - k, reach), np.minimum(at, reach)], 1)
    return np.concatenate([right.view(np.uint8), left.view(np.uint8), room.astype(np.uint8)], 1)


def _passages(h: np.ndarray, at: np.ndarray, k: int, reach: int) -> list[list[int | None]]:
    """Per place: hash of the passage that begins o words before it, o = 0 .. reach."""
    whole = gram_hashes(h, k + reach).view(np.int64).tolist()
    return [[whole[p - o] if 0 <= p - o < len(whole) else None for o in range(reach + 1)]
            for p in at.tolist()]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(a == b, axis=1).sum(1)


def _best_neighbour(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Longest prefix of ``side`` shared with another suffix of the group: sort, then
    compare neighbours."""
    order = np.argsort(np.concatenate(
        [group.astype(">u8").view(np.uint8).reshape(-1, 8), side.astype(">u4").view(np.uint8)], 1)
        .view(f"S{8 + 4 * side.shape[1]}").ravel(), kind="stable")
    a, b = order[:-1], order[1:]
    n = np.where(group[a] == group[b], _common(side[a], side[b]), -1)
    best = np.full(len(group), -1, np.int64)
    best[a] = n
    best[b] = np.maximum(best[b], n)
    return best


def _rolled(side: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row."""
    out = np.empty((len(side), side.shape[1] + 1), np.uint64)
    out[:, 0] = start
    for j in range(side.shape[1]):
        out[:, j + 1] = mixed(out[:, j] + side[:, j] + np.uint64(1))
    return out


def extend(group: np.ndarray, doc: np.ndarray, ctx: np.ndarray,
           reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix two bit sets over o: the passage that begins o words before it is in
    another document; it is in one of a smaller id."""
    width = 4 * reach
    right = np.ascontiguousarray(ctx[:, :width]).view("<u4")
    left = np.ascontiguousarray(ctx[:, width:2 * width]).view("<u4")
    most_right = np.minimum(_best_neighbour(group, right), ctx[:, -2])
    most_left = np.minimum(_best_neighbour(group, left), ctx[:, -1])
    again, later = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    own = np.flatnonzero(most_right + most_left >= reach)
    if not len(own):
        return again, later
    after = _rolled(right[own], mixed(group[own].astype(np.uint64)))
    before = _rolled(left[own], np.full(len(own), 5, np.uint64))
    for o in range(reach + 1):
        can = np.flatnonzero((most_left[own] >= o) & (most_right[own] >= reach - o))
        if len(can) < 2:
            continue
        h = mixed(after[can, reach - o] ^ (before[can, o] * np.uint64(BASE)))
        order = np.argsort(h, kind="stable")
        rows, h = own[can[order]], h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        low = np.repeat(np.minimum.reduceat(doc[rows], first), size)
        high = np.repeat(np.maximum.reduceat(doc[rows], first), size)
        again[rows[low < high]] |= 1 << o
        later[rows[(low < high) & (doc[rows] > low)]] |= 1 << o
    return again, later


def merge_spans(places: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Word spans [start, end) that the passages of (place, bit set over o) cover."""
    found = []
    for at, bits in places:
        o = 0
        while bits >> o:
            o += ((bits >> o) & -(bits >> o)).bit_length() - 1
            n = ((~(bits >> o)) & ((bits >> o) + 1)).bit_length() - 1
            found.append((at - o - n + 1, at - o + length))
            o += n
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _heads(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(key, doc, n): heads of the suffixes that each document keeps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            keys, ids, counts = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = gram_hashes(hasher(_words(text)), k)
                own, n = np.unique(grams[minimiser_places(grams, window)], return_counts=True)
                keys.append(own.view(np.int64))
                ids.append(np.full(len(own), doc, np.int64))
                counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, ids, counts)], ["key", "doc", "n"])
    return docs.mapInArrow(run, "key long, doc long, n long")


def _suffixes(docs: DataFrame, k: int, window: int, crowded: bool) -> DataFrame:
    """Suffixes whose heads are in the array ``keys`` of the document's row: (key, doc, at)
    with their contexts, or with the hashes of the passages around them."""
    reach = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = hasher(_words(text))
                grams = gram_hashes(h, k)
                at = minimiser_places(grams, window)
                at = at[np.isin(grams[at].view(np.int64), own.values.to_numpy(zero_copy_only=False))]
                if not len(at):
                    continue
                around = (pa.array(_passages(h, at, k, reach), pa.list_(pa.int64())) if crowded else
                          pa.array([x.tobytes() for x in _contexts(h, at, k, reach)], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), pa.array(np.full(len(at), doc, np.int64)),
                     pa.array(at), around], ["key", "doc", "at", "around"])
    return docs.mapInArrow(run, "key long, doc long, at long, around "
                           + ("array<long>" if crowded else "binary"))


def _by_head(suffixes: DataFrame, reach: int) -> DataFrame:
    """(doc, at, again, later) of suffixes grouped by head; groups are bounded by CROWD."""
    kind = pa.struct([("doc", pa.int64()), ("at", pa.int64()), ("again", pa.int64()),
                      ("later", pa.int64())])

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        group = np.repeat(np.arange(len(sizes)), sizes)
        doc, at = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ctx = np.frombuffer(b"".join(flat.field(2).to_pylist()), np.uint8).reshape(len(doc), -1)
        again, later = extend(group, doc, ctx, reach) if len(doc) else (doc, doc)
        hit = again != 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(group[hit], minlength=len(sizes)))])
        rows = pa.StructArray.from_arrays(
            [pa.array(x[hit]) for x in (doc, at, again, later)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    out = F.arrow_udf(run, "array<struct<doc:long,at:long,again:long,later:long>>").asNondeterministic()
    return (suffixes.groupBy("key").agg(F.collect_list(F.struct("doc", "at", "around")).alias("s"))
            .select(F.explode(out("s")).alias("s")).select("s.*"))


def _by_passage(suffixes: DataFrame) -> DataFrame:
    """The same for crowded heads: passages are counted where they are before the shuffle,
    so a passage that very many documents share costs one row per task."""
    rows = suffixes.select("doc", "at", F.posexplode("around").alias("o", "p")).where("p IS NOT NULL")
    shared = write_stage(rows.groupBy("p").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                         .where("lo < hi").select("p", "lo"), "passages")
    bit = F.expr("shiftleft(1L, o)")
    return (rows.join(shared, "p").groupBy("doc", "at")
            .agg(F.bit_or(bit).alias("again"),
                 F.bit_or(F.when(F.col("doc") > F.col("lo"), bit).otherwise(0)).alias("later")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, window: int = WINDOW,
                      crowd: int = CROWD) -> DataFrame:
    """(id, spans, later_spans, n_repeated): one row per document with repeated words.

    ``spans``: word ranges [start, end) made of passages of ``min_words`` words that
    another document has as well. ``later_spans``: the part of them that a document of a
    smaller id has, which deduplication would cut. Words are split at white space and
    compared as they are. Repeats inside one id, also in repeated rows of it, don't count;
    rows without an id or text, short texts and empty tables give no rows.
    """
    if not 1 < window <= min(60, min_words):
        raise ValueError("window must be from 2 to 60 and at most min_words")
    k = min_words - window + 1
    own = (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
           .where("doc IS NOT NULL AND text IS NOT NULL"))
    heads = _heads(own, k, window)
    shared = write_stage(heads.groupBy("key").agg(F.sum("n").alias("n"), F.min("doc").alias("lo"),
                                                  F.max("doc").alias("hi"))
                         .where("lo < hi").select("key", "n"), "heads")

    def suffixes(keys: DataFrame, crowded: bool) -> DataFrame:
        mine = (heads.join(keys.select("key"), "key").groupBy("doc")
                .agg(F.collect_set("key").alias("keys")))
        return _suffixes(own.join(mine, "doc").select("doc", "text", "keys"), k, window, crowded)

    found = _by_head(suffixes(shared.where(F.col("n") <= crowd), False), window - 1)
    if not shared.where(F.col("n") > crowd).isEmpty():
        found = found.union(_by_passage(suffixes(shared.where(F.col("n") > crowd), True)))

    def run(lists: pa.Array) -> pa.Array:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        whole, part = [], []
        for x in lists.to_pylist():
            for out, name in ((whole, "again"), (part, "later")):
                out.append([{"start": a, "end": b} for a, b in merge_spans(
                    [(s["at"], s[name]) for s in x], min_words)])
        return pa.StructArray.from_arrays([pa.array(whole, span), pa.array(part, span)],
                                          ["spans", "later_spans"])

    kind = "array<struct<start:long,end:long>>"
    merged = F.arrow_udf(run, f"spans {kind}, later_spans {kind}").asNondeterministic()
    return (found.groupBy("doc").agg(F.collect_list(F.struct("at", "again", "later")).alias("s"))
            .withColumn("m", merged("s"))
            .select(F.col("doc").alias(id_col), "m.spans", "m.later_spans",
                    F.aggregate("m.spans", F.lit(0).cast("long"),
                                lambda n, s: n + s["end"] - s["start"]).alias("n_repeated")))
