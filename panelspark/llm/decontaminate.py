"""Benchmark decontamination by SimHash windows of the size of each item.

Every window of an item's size has a fingerprint over its word shingles. Fingerprints
within RADIUS bits of an item's are found through four blocks of sixteen bits: tables say
in one look how many bits a block is from the nearest item's, and over the four blocks that
adds up to RADIUS at most. Windows found are compared by their weighted shingles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from panelspark.llm.hashing import WordHasher
from panelspark.llm.shared import write_stage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15  # a similarity of 0.8 turns about eight bits of an item of thirty words
CHUNK_WORDS = 8192
SLICE = 64
ITEM_BYTES = 16 << 20  # item text that one pass sends to the executors
MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def weighted_shingles(words: list[bytes], k: int) -> Counter:
    """Shingles with the number of times they occur."""
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of smaller weights over sum of larger ones."""
    low = sum((a & b).values())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = (out ^ h[j:j + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def _running(shingles: np.ndarray, kind) -> np.ndarray:
    """Running votes per bit. They wrap around; a difference of two is exact while a
    window has fewer shingles than the type has values."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(bits) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def _kind(shingles: int):
    return np.uint8 if shingles < 256 else np.uint16 if shingles < 65536 else np.int64


def _prints(run: np.ndarray, m: int, n: int, space: dict | None = None) -> np.ndarray:
    """Fingerprints of the n windows of m shingles; ``space`` keeps arrays for the next call."""
    space = {} if space is None else space
    key = run.dtype
    if key not in space or len(space[key][0]) < n:
        space[key] = np.empty((n, 64), key), np.empty((n, 64), bool)
    votes, ones = (x[:n] for x in space[key])
    np.subtract(run[m:m + n], run[:n], out=votes)
    np.greater(votes, m // 2, out=ones)
    return np.packbits(ones.ravel()).view(np.uint64)


GROUP = 64  # items of one length whose block tables are one


def _block_tables(fps: np.ndarray) -> list[np.ndarray]:
    """Per block of sixteen bits: in how many bits the nearest item's block differs."""
    values = np.arange(1 << 16, dtype=np.uint16)
    ones, tables = np.bitwise_count(values), []
    for blocks in fps.view(np.uint16).reshape(-1, 4).T:
        tables.append(np.full(1 << 16, 16, np.uint8))
        for block in np.unique(blocks):
            np.minimum(tables[-1], ones.take(values ^ block), out=tables[-1])
    return tables


def window_words(size: int) -> int:
    """Words of the windows that look for an item: its length, less an eighth at most.

    Items of nearly one length then share a window, which holds their first words.
    """
    return size - size % max(1, size // 8)


class Bench:
    """Items by window size with their block tables."""

    def __init__(self, items: list[tuple], shingle: int, similarity: float, radius: int):
        self.shingle, self.similarity, self.radius = shingle, similarity, radius
        self.hasher, self.space = WordHasher(), {}
        sizes: dict[int, list] = {}
        for item_id, text in items:
            words = split_words(text)
            if words:
                sizes.setdefault(window_words(len(words)), []).append((item_id, words))
        self.sizes = []
        for base, own in sorted(sizes.items()):
            k = min(shingle, base)
            m = base - k + 1
            for start in range(0, len(own), GROUP):
                part = own[start:start + GROUP]
                grams = [shingle_hashes(self.hasher(w), k) for _, w in part]
                first, whole = (np.concatenate([
                    _prints(_running(g, np.int64), n or len(g), 1) for g in grams]) for n in (m, 0))
                self.sizes.append((
                    base, k, m, [i for i, _ in part], np.array([len(w) for _, w in part]),
                    first, whole, _block_tables(first),
                    [weighted_shingles(w, k) for _, w in part], [set(g.tolist()) for g in grams]))

    def scan(self, docs: list[list[bytes]]) -> list[dict]:
        """Per text: item number -> (similarity, start, words) of its best window."""
        found: list[dict] = [{} for _ in docs]
        for group in _groups(docs):
            self._scan(docs, group, found)
        return found

    def _scan(self, docs, group, found) -> None:
        words = [w for d in group for w in docs[d]]
        lengths = np.array([len(docs[d]) for d in group])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(group)), lengths)
        room = ends[owner] - np.arange(len(words))  # words to the end of the text
        h = self.hasher(words)
        runs: dict = {}
        texts: dict = {}  # fingerprints of whole texts
        for base, k, m, ids, sizes, fps, whole, tables, weights, sets in self.sizes:
            if k not in runs:
                runs[k] = shingle_hashes(h, k), {}
            grams, made = runs[k]
            run = made.get(_kind(m))
            if run is None:
                run = made[_kind(m)] = _running(grams, _kind(m))
            n = len(words) - base + 1
            if n > 0:
                fp = _prints(run, m, n, self.space)
                blocks = fp.view(np.uint16).reshape(-1, 4).T.astype(np.intp, order="C")
                least_bits = tables[0].take(blocks[0], mode="wrap")  # never out of range: unchecked
                for table, b in zip(tables[1:], blocks[1:]):
                    least_bits += table.take(b, mode="wrap")
                at = np.flatnonzero(least_bits <= self.radius)
                close = np.bitwise_count(fp[at][:, None] ^ fps) <= self.radius
                hit, items = np.divmod(np.flatnonzero(close), len(fps))
                hit = at[hit]
                fits = room[hit] >= sizes[items]
                for i, j in zip(hit[fits].tolist(), items[fits].tolist()):
                    size = int(sizes[j])
                    own = grams[i:i + size - k + 1].tolist()
                    if sum(map(sets[j].__contains__, own)) >= self.similarity * len(own):
                        self._compare(words[i:i + size], k, ids[j], weights[j], found[group[owner[i]]],
                                      i - int(ends[owner[i]] - lengths[owner[i]]))
            # a text a little shorter than an item is one window
            least = k - 1 + self.similarity * (sizes.min() - k + 1)
            for g in np.flatnonzero((lengths < sizes.max()) & (lengths >= max(k, least))).tolist():
                a, z = int(ends[g] - lengths[g]), int(ends[g])
                if (k, g) not in texts:
                    texts[k, g] = _prints(_running(grams[a:z - k + 1], np.int64), z - a - k + 1, 1)
                near = (np.bitwise_count(whole ^ texts[k, g]) <= self.radius) & (sizes > z - a)
                for j in np.flatnonzero(near).tolist():
                    self._compare(words[a:z], k, ids[j], weights[j], found[group[g]], 0)

    def _compare(self, window, k, item, weights, best, start) -> None:
        s = weighted_similarity(weighted_shingles(window, k), weights)
        if s >= self.similarity and (s, -start) > (best.get(item, (0, 0))[0], -best.get(item, (0, 0))[1]):
            best[item] = (s, start, len(window))


def _groups(docs: list[list[bytes]]) -> Iterator[list[int]]:
    """Texts that are scanned together; a long one is a group by itself."""
    own, n = [], 0
    for d, words in enumerate(docs):
        if not words:
            continue
        if own and n + len(words) > CHUNK_WORDS:
            yield own
            own, n = [], 0
        own.append(d)
        n += len(words)
    if own:
        yield own


_MADE: dict[int, Bench] = {}  # of the last broadcast met by a worker


def _leaks(text: Column, sent, key: int, conf: tuple, item_type: DataType) -> Column:
    """Hits of one broadcast list of (item text, its ids)."""
    item = pa.struct([("item_id", to_arrow_type(item_type)), ("similarity", pa.float64()),
                      ("start", pa.int64()), ("n_words", pa.int64())])

    def run(texts: pa.Array) -> pa.Array:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Bench([(i, t) for i, (t, _) in enumerate(sent.value)], *conf)
        found: list[dict] = []
        for start in range(0, len(texts), SLICE):  # the words of so many texts at a time
            found += _MADE[key].scan([split_words(t.as_py()) for t in texts[start:start + SLICE]])
        return pa.array([[{"item_id": one, "similarity": s, "start": a, "n_words": n}
                          for i, (s, a, n) in sorted(best.items()) for one in sent.value[i][1]]
                         for best in found], pa.list_(item))
    return F.arrow_udf(run, _hits_ddl(item_type)).asNondeterministic()(text)


def _hits_ddl(item_type: DataType) -> str:
    return (f"array<struct<item_id:{item_type.simpleString()},similarity:double,start:bigint,"
            "n_words:bigint>>")


def find_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", out: str = "leaks",
               item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
               similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``out``: array of (item_id, similarity, start word, words), best window each.

    Equal item texts are scanned once and reported under each id. Null and empty texts and
    items never leak, items without an id are left out; items below the shingle length must
    occur as they are. Items are sent to the executors; where their text exceeds ITEM_BYTES
    they are dealt by hash into passes, each written before the next. The windows, not the
    text size, bound the memory of a task: long texts are scanned whole, short ones some at
    a time.
    """
    spark = docs.sparkSession
    items = (bench.where(F.octet_length(F.trim(item_text)) > 0)
             .groupBy(F.col(item_text).alias("t")).agg(F.collect_set(item_col).alias("ids")))
    size = items.agg(F.sum(F.octet_length("t") + 16 * F.size("ids"))).first()[0] or 0
    passes = max(1, -(-size // ITEM_BYTES))
    item_type = bench.schema[item_col].dataType
    got = docs.withColumn(out, F.array().cast(_hits_ddl(item_type)))
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == p).orderBy("t").collect()
        if not rows:
            continue
        sent = [(r.t, sorted(r.ids)) for r in rows]
        key = xxhash.xxh64_intdigest(repr((sent, shingle, similarity, radius)))
        hits = _leaks(F.col(text_col), spark.sparkContext.broadcast(sent), key,
                      (shingle, similarity, radius), item_type)
        got = got.withColumn("_hits", hits).withColumn(out, F.concat(out, "_hits")).drop("_hits")
        if passes > 1:
            got = write_stage(got, f"leaks{p}")
    return got


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **conf) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): one row per document and item it holds."""
    got = find_leaks(docs.select(id_col, "text"), bench, out="_leaks", **conf)
    return got.select(id_col, F.explode("_leaks").alias("_l")).select(id_col, "_l.*")
