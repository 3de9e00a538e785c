"""Spelling variants by a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed
trie. Both tries are numbered over the sorted vocabulary: the node of depth d is made by
the first word, in order, that has it. A word without its i-th letter is then the pair
(node before i, node after i), and a word cut at i is the pair (node up to i, node from
i). Words that agree on a pair are exact neighbours: two skips of one pair differ by a
replaced letter, a skip and a cut by an inserted one.

A pair fixes every letter but one, so at most 90 words (the letters of ``LETTERS``) skip
to it and one is cut there: no group grows with the data. Within a pair only counts and
the best two are used, never all pairs.
"""

from __future__ import annotations

import math
import os.path
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import cut_lineage, write_stage

LETTERS = "A-Za-zÀ-ÿ"
RARE = 31          # one run in so many loses a letter
SHORTEST = 7
TIMES = 10         # a form is so many times as frequent as the word
PIECE = 1 << 20    # code points of a long text looked at together
HELD = 1 << 24     # letters of counted words that a task holds before it passes them on


def _pieces(text: str, outside: re.Pattern):
    """Slices of a long text, none of which ends inside a run of letters."""
    at = 0
    while len(text) - at > PIECE:
        stop = outside.search(text, at + PIECE)
        if stop is None:
            break
        yield text[at:stop.start()]
        at = stop.start()
    yield text[at:] if at else text


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shortest: int = SHORTEST, rare: int = RARE) -> DataFrame:
    """(word, n): runs of letters with their occurrences over all texts.

    A-Z are lower-cased; a run whose crc32 with the id is divisible by ``rare`` loses the
    letter that the crc names (null ids count as empty). Words below ``shortest`` are left
    out. Equal words of a task are added up before the shuffle.
    """
    low = LETTERS.removeprefix("A-Z")

    def run(batches):
        runs = re.compile(f"[{low}]{{{shortest},}}").findall
        outside = re.compile(f"[^{low}]")
        counts: Counter = Counter()
        held = 0

        def out():
            return pa.record_batch({"word": pa.array(counts.keys(), pa.string()),
                                    "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                key = ids[i].as_py()
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                own: Counter = Counter()
                for piece in _pieces(text.encode().lower().decode(), outside):
                    own.update(runs(piece))
                for word, k in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % rare == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    if word not in counts:
                        held += len(word) + 50
                    counts[word] += k
                if held > HELD:
                    yield out()
                    counts.clear()
                    held = 0
        yield out()

    got = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n"))


# -- numbering of the tries ---------------------------------------------------------

def _step(state: tuple[str, list[int], int], word: str) -> tuple[str, list[int], int]:
    """(word, its path, nodes made) after the next word in order.

    A path holds the node of each prefix. Nodes are numbered from 1 in the order in which
    they are made, so those of a part's first word bear their depths.
    """
    last, path, made = state
    same = len(os.path.commonprefix((last, word)))
    new = len(word) - same
    return word, path[:same] + list(range(made + 1, made + new + 1)), made + new


def _carry(ends) -> dict[int, tuple[int, list[int]]]:
    """Part -> (what its own numbers are raised by, nodes that it shares with parts before).

    ``ends`` has one row per part of the sorted table: its first and last word, the nodes
    made and the path of the last word. The first word shares a prefix with the last one
    before it; those nodes have their numbers already.
    """
    out: dict[int, tuple[int, list[int]]] = {}
    last, path, raised = "", [], 0
    for r in sorted(ends, key=lambda r: r["part"]):
        same = len(os.path.commonprefix((last, r["first"])))
        shared = path[:same]
        out[r["part"]] = (raised, shared)
        path = [shared[k - 1] if k <= same else raised + k for k in r["path"]]
        last, raised = r["last"], raised + r["made"]
    return out


def number_nodes(words: DataFrame, key: str) -> DataFrame:
    """``words`` with ``nodes``: the number of the trie node of each prefix of ``key``.

    Keys are distinct and not empty. They are range-sorted and written, so that parts and
    their order stay; each part numbers its own nodes, and one row per part (first and
    last key) settles which nodes it shares with the part before. The last number of a
    key is its own and rises in code-point order.
    """
    kept = cut_lineage(words.orderBy(key).withColumn("part", F.spark_partition_id()))
    at = kept.columns.index(key)

    def ends(batches):
        state, first, part = ("", [], 0), None, None
        for b in batches:
            for k in b.column(at):
                state = _step(state, k.as_py())
                if first is None:
                    first, part = state[0], b.column(b.num_columns - 1)[0].as_py()
        if first is not None:
            last, path, made = state
            yield pa.record_batch({
                "part": pa.array([part], pa.int32()), "first": pa.array([first]),
                "last": pa.array([last]), "made": pa.array([made], pa.int64()),
                "path": pa.array([path], pa.list_(pa.int64()))})

    rows = kept.mapInArrow(
        ends, "part int, first string, last string, made long, path array<long>").collect()
    carry = _carry(rows)  # as many rows as the sorted table has parts

    def paths(batches):
        state = ("", [], 0)
        for b in batches:
            if not b.num_rows:
                continue
            raised, shared = carry[b.column(b.num_columns - 1)[0].as_py()]
            out, size, begin = [], 0, 0
            for i, k in enumerate(b.column(at)):
                state = _step(state, k.as_py())
                out.append([shared[x - 1] if x <= len(shared) else raised + x
                            for x in state[1]])
                size += len(state[0])
                if size > HELD // 8 or i == b.num_rows - 1:
                    piece = b.slice(begin, i + 1 - begin)
                    yield pa.record_batch(
                        [*piece.columns[:-1], pa.array(out, pa.list_(pa.int64()))],
                        names=[*piece.schema.names[:-1], "nodes"])
                    out, size, begin = [], 0, i + 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return kept.mapInArrow(paths, kinds + ", nodes array<long>")


# -- neighbours -----------------------------------------------------------------------

CUT, SKIP, WHOLE = 0, 1, 2
PAIR_ROWS = 1_000_000  # rows of pairs that one task sorts


def _pairs(batches):
    """Skips and cuts (p, s, kind, n, id) of words (id, n, word, up, down).

    ``up`` and ``down`` hold the nodes of prefixes and suffixes by length. A skip is
    WHOLE if it stands for the deletion: of a run of equal letters only the last does,
    so that two words meet once by insertion.
    """
    for batch in batches:
        sizes = np.diff(batch.column(3).offsets.to_numpy())
        begin = 0
        while begin < batch.num_rows:
            upto = np.cumsum(sizes[begin:])
            many = max(1, int(np.searchsorted(upto, PAIR_ROWS // 4, "right")))
            b, k = batch.slice(begin, many), sizes[begin:begin + many].astype(np.int64)
            begin += many
            first = np.cumsum(k + 1) - (k + 1)  # a word of k letters has k + 1 cuts
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            p = np.zeros(len(inner) + len(k), np.int64)
            s = p.copy()
            p[np.repeat(first, k) + inner + 1] = b.column(3).flatten().to_numpy()
            s[np.repeat(first + k - 1, k) - inner] = b.column(4).flatten().to_numpy()
            letters = np.frombuffer("".join(b.column(2).to_pylist()).encode("utf-32-le"), "<u4")
            whole = np.ones(len(inner), bool)
            whole[:-1] = letters[1:] != letters[:-1]
            whole[np.cumsum(k) - 1] = True
            here = np.repeat(first, k) + inner
            row = np.concatenate((np.repeat(np.arange(len(k)), k + 1),
                                  np.repeat(np.arange(len(k)), k)))
            yield pa.record_batch({
                "p": np.concatenate((p, p[here])), "s": np.concatenate((s, s[here + 1])),
                "kind": np.concatenate((np.zeros(len(p), np.int8),
                                        np.where(whole, WHOLE, SKIP).astype(np.int8))),
                "n": b.column(1).to_numpy()[row], "id": b.column(0).to_numpy()[row]})


def _meet(batches):
    """(id, k, n, o): for each word of a pair its near words there and the best of them.

    Rows of a pair stand in one task: skips first, the most frequent before, so that the
    best other skip is the first row or, for the first row, the second.
    """
    cols = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not cols:
        return
    p, s, kind, n, i = (np.concatenate(c) for c in zip(*cols))
    order = np.lexsort((i, -n, kind == CUT, s, p))
    p, s, kind, n, i = (x[order] for x in (p, s, kind, n, i))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    pair, end = np.cumsum(new) - 1, np.append(first[1:], len(p))
    rows, none = np.arange(len(p)), len(p)
    skips = np.add.reduceat((kind != CUT).astype(np.int64), first)
    wholes = np.add.reduceat((kind == WHOLE).astype(np.int64), first)
    top_whole = np.minimum.reduceat(np.where(kind == WHOLE, rows, none), first)
    cut = np.where(end - first > skips, end - 1, none)
    k = np.where(kind == CUT, wholes[pair],
                 skips[pair] - 1 + ((kind == WHOLE) & (cut[pair] < none)))
    other = np.where(rows == first[pair], np.where(skips[pair] > 1, rows + 1, none), first[pair])
    other = np.where(kind == CUT, top_whole[pair], other)
    second = np.where(kind == WHOLE, cut[pair], none)
    n_, i_ = np.append(n, -1), np.append(i, np.iinfo(np.int64).max)
    better = (n_[second] > n_[other]) | ((n_[second] == n_[other]) & (i_[second] < i_[other]))
    best = np.where(better, second, other)
    met = np.flatnonzero(k > 0)
    met = met[np.lexsort((i_[best[met]], -n_[best[met]], i[met]))]
    if len(met):
        at = np.flatnonzero(np.append(True, i[met][1:] != i[met][:-1]))
        yield pa.record_batch({"id": i[met][at], "k": np.add.reduceat(k[met], at),
                               "n": n_[best[met]][at], "o": -i_[best[met]][at]})


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): near words of words (id, n, word, up, down) that have any.

    Near words differ by exactly one inserted, deleted or replaced letter; each counts
    once. ``best`` is (n, -id) of the most frequent, the smallest id among equals. The
    number of tasks follows the number of pairs.
    """
    rows = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 1
    parts = max(math.ceil(rows / PAIR_ROWS),
                int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = words.select("id", "n", "word", "up", "down").mapInArrow(
        _pairs, "p long, s long, kind byte, n long, id long")
    met = pairs.repartition(parts, "p", "s").mapInArrow(_meet, "id long, k long, n long, o long")
    return met.groupBy("id").agg(F.sum("k").alias("n_near"),
                                 F.max(F.struct("n", "o")).alias("best"))


def _roots(steps: DataFrame, rounds: int) -> DataFrame:
    """(id, root) for steps (id, to): every step followed to its end by doubling."""
    r = cut_lineage(steps)
    for _ in range(rounds):
        on = r.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        r = cut_lineage(r.join(on, "to", "left").select(
            "id", F.coalesce("beyond", "to").alias("to")))
    return r.withColumnRenamed("to", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shortest: int = SHORTEST, at_least: int = 2, times: int = TIMES,
                    rare: int = RARE) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the vocabulary with its spelling variants.

    Words occur ``at_least`` times over all texts. ``form`` is the most frequent near word
    if it is at least ``times`` as frequent (ties: the first in code-point order), ``root``
    the end of the chain of forms. Counts rise along a chain by ``times``, so the largest
    count bounds the rounds that follow chains.

    Null and empty texts have no words, a repeated row counts as often as it stands, very
    long texts are read in slices, other columns are not looked at, and an empty table
    gives no rows.
    """
    words = count_words(docs, id_col, text_col, shortest, rare).where(F.col("n") >= at_least)
    up = number_nodes(words, "word").select(
        F.element_at("nodes", -1).alias("id"), "word", "n", F.col("nodes").alias("up"))
    up = write_stage(up, "forward")
    down = number_nodes(up.select("id", F.reverse("word").alias("back")), "back").select(
        "id", F.col("nodes").alias("down"))
    both = write_stage(up.join(down, "id"), "nodes")
    near = neighbours(both)
    plain = up.select("id", "word", "n")
    found = plain.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"))
    found = write_stage(found.select("id", "word", "n", "n_near", (-F.col("best.o")).alias("to"),
                                     F.col("best.n").alias("form_n")), "forms")
    most = found.agg(F.max("n")).first()[0]
    if most is None:
        rounds = 0
    else:
        longest = max(1, math.ceil(math.log(max(most / at_least, times), times)))
        rounds = math.ceil(math.log2(longest))
    roots = _roots(found.where("to IS NOT NULL").select("id", "to"), rounds)
    names = plain.select(F.col("id").alias("to"), F.col("word").alias("form"))
    ends = plain.select(F.col("id").alias("root"), F.col("word").alias("end"))
    linked = (found.where("to IS NOT NULL").join(roots, "id").join(names, "to")
              .join(ends, "root")
              .select("word", "n", "n_near", "form", "form_n", F.col("end").alias("root")))
    lone = found.where("to IS NULL").select(
        "word", "n", "n_near", F.lit(None).cast("string").alias("form"), "form_n",
        F.col("word").alias("root"))
    return linked.unionByName(lone)
