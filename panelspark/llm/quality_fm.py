"""Text quality by a factorisation machine.

Inputs are hashed words, statistics of the text's structure and its recorded length, the
statistics cut at fixed limits so that pairs of them can interact. The pairwise part of
the score takes linear time: half the square of the sum less the sum of the squares.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.compression_bands import SYMBOLS, text_stats
from panelspark.llm.labels import labelled_sample

WORD_BUCKETS = 1 << 15
MEMO = 200_000
# Statistics and the limits at which each is cut.
SHARE = (0.002, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8)
LIMITS: dict[str, tuple[float, ...]] = {
    "symbols": SHARE, "capitals": SHARE, "digits": SHARE, "marks": SHARE, "commas": SHARE,
    "stops": SHARE, "dup_lines": SHARE, "repeats": SHARE,
    "distinct": (0.05, 0.15, 0.3, 0.45, 0.6, 0.7, 0.8, 0.9, 0.97),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 12),
    "line_words": (2, 5, 10, 20, 40, 80, 160, 320),
    "words": (1, 5, 10, 20, 50, 100, 200, 400, 800, 1600, 3200),
    "recorded": (1, 50, 100, 200, 500, 1000, 2000, 4000, 8000, 16000),
}
STARTS = dict(zip(LIMITS, np.cumsum([0, *(len(v) + 1 for v in LIMITS.values())]).tolist()))
SIZE = WORD_BUCKETS + sum(len(v) + 1 for v in LIMITS.values())


@dataclass(frozen=True)
class Fit:
    """``sample`` bounds the labelled rows that are learned from."""

    sample: int = 6000
    factors: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.08
    decay: float = 2e-4
    seed: int = 11


def structure(text: str, n_chars: int | None) -> dict[str, float]:
    """Statistics of one text; shares of characters, words or lines."""
    n_words, chars, symbols, dup, repeats = text_stats(text)
    size, lines = max(1, len(text)), text.count("\n") + 1
    ascii_text = text.encode("ascii", "ignore")
    capitals = sum(map(str.isupper, text)) if len(ascii_text) != len(text) else (
        len(text) - len(ascii_text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    return {
        "symbols": symbols / size, "capitals": capitals / size,
        "digits": (len(ascii_text) - len(ascii_text.translate(None, b"0123456789"))) / size,
        "marks": (text.count("!") + text.count("?")) / size, "commas": text.count(",") / size,
        "stops": text.count(".") / size, "dup_lines": dup / lines,
        "repeats": repeats / max(1, n_words), "word_length": chars / max(1, n_words),
        "line_words": n_words / lines, "words": n_words,
        "recorded": -1 if n_chars is None else n_chars}


class Inputs:
    """Texts to (feature numbers, values)."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        memo, buckets = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for w in text.encode().lower().split():
            b = memo.get(w)
            if b is None:
                b = memo[w] = zlib.crc32(w) % WORD_BUCKETS
            buckets.append(b)
        at, count = np.unique(np.array(buckets, np.int64), return_counts=True)
        stats = structure(text, n_chars)
        stats["distinct"] = len(at) / max(1, len(buckets))
        cut = [WORD_BUCKETS + STARTS[k] + int(np.searchsorted(LIMITS[k], v, "right"))
               for k, v in stats.items()]
        value = np.sqrt(count)
        return (np.concatenate([at, cut]),
                np.concatenate([value / max(1e-9, np.sqrt((value ** 2).sum())), np.ones(len(cut)) / 3]))


@dataclass
class Machine:
    """bias + w.x + half of (|sum of v x| squared - sum of |v x| squared)."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(0)
        return float(self.bias + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, fit: Fit) -> Machine:
    """Logistic loss by AdaGrad; features of a batch are updated together."""
    rng = np.random.default_rng(fit.seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, fit.factors)))
    if not len(rows):
        m.v[:] = 0
        return m
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, fit.factors), 1e-6), 1e-6
    for _ in range(fit.epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), fit.batch):
            own = order[start:start + fit.batch]
            at = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])[:, None]
            sizes = np.array([len(rows[i][0]) for i in own])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = m.v[at] * x
            total = np.add.reduceat(vx, first)
            raw = m.bias + np.add.reduceat(m.w[at] * x[:, 0], first) + 0.5 * (
                (total ** 2).sum(1) - np.add.reduceat((vx * vx).sum(1), first))
            slip = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) / len(own)
            g = np.repeat(slip, sizes)[:, None]
            used, back = np.unique(at, return_inverse=True)
            dv = np.zeros((len(used), fit.factors))
            np.add.at(dv, back, g * x * (np.repeat(total, sizes, 0) - vx))
            dw = np.bincount(back, (g * x)[:, 0], len(used))
            dv += fit.decay * m.v[used]
            dw += fit.decay * m.w[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            gb += slip.sum() ** 2
            m.w[used] -= fit.rate * dw / np.sqrt(gw[used])
            m.v[used] -= fit.rate * dv / np.sqrt(gv[used])
            m.bias -= fit.rate * slip.sum() / np.sqrt(gb)
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), target: str = "quality",
                folds: int = 4, held_out: int = 2) -> Machine:
    """Learns on the driver from the bounded sample; its inputs are made on the executors."""
    def inputs(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        make = Inputs()
        got = [make(t.as_py(), n.as_py()) for t, n in zip(texts, sizes)]
        return pa.StructArray.from_arrays(
            [pa.array([a for a, _ in got], pa.list_(pa.int32())),
             pa.array([x for _, x in got], pa.list_(pa.float32()))], ["at", "x"])

    made = F.arrow_udf(inputs, "at array<int>, x array<float>").asNondeterministic()
    sample = labelled_sample(docs.select("doc_id", "text", "n_chars"), labels, target, folds,
                             held_out, fit.sample)
    got = sample.select(F.col("_label").cast("int").alias("y"), F.col("doc_id").alias("id"),
                        made("text", F.col("n_chars").cast("long")).alias("f")).toArrow().to_pylist()
    got.sort(key=lambda r: r["id"])
    return train([(np.array(r["f"]["at"]), np.array(r["f"]["x"])) for r in got],
                 np.array([r["y"] for r in got], float), fit)


def quality_score(spark: SparkSession, text: Column, n_chars: Column, model: Machine) -> Column:
    """Probability of label 1; empty and null texts score by their structure alone."""
    sent = spark.sparkContext.broadcast((model.bias, model.w.astype(np.float32),
                                         model.v.astype(np.float32)))  # about a megabyte, fixed

    def run(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        m, make = Machine(*sent.value), Inputs()
        raw = np.array([m.raw(*make(t.as_py(), n.as_py())) for t, n in zip(texts, sizes)], float)
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
    return F.arrow_udf(run, "double").asNondeterministic()(text, n_chars.cast("long"))


def score_quality(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``docs`` with ``score``. Without labelled rows every score is 0.5."""
    model = fit_quality(docs, labels, fit)
    return docs.withColumn("score", quality_score(docs.sparkSession, F.col("text"),
                                                  F.col("n_chars"), model))
