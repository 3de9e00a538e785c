"""Toxicity after noisy-channel deobfuscation.

A token that mixes letters with digits or signs, consists of them, doubles or stretches a
letter, or is spelled out with spaces becomes a lattice: a sign may stand for letters or for nothing, a repeated
letter for one or two. Viterbi picks the path that a character trigram model, counted
over the whole corpus, and the cost of each arc make likeliest. The restored words are
then scored by logistic regression on words and word beginnings.
"""

from __future__ import annotations

import math
import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.labels import labelled_sample
from panelspark.llm.shared import write_stage

GRAMS = 1 << 18  # counters of the language model, whatever the corpus
FEATURES = 1 << 20
MEMO = 200_000
SPELLED_WORD = 24  # letters of a word within a longer stretch; a whole stretch may have more
LONGEST = 40  # longer tokens may be several words, and are none for the language model
SHORT = 64  # words or features of a token that is remembered

# What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
        "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
        "¡": "i", "§": "s", "*": "aeiou"}
# -log of how a writer obfuscates: a sign for a letter; a sign or digit that could be a
# letter added for nothing; other signs added; a letter written twice, and more often.
SIGN_COST, SPARE_COST, DROP_COST, TWICE_COST, FOLD_COST = 1.0, 12.0, 0.5, 6.0, 0.3
MASKS = "*(|+"  # signs that also stand between letters for nothing
WORD = re.compile(r"[^\W\d_]+")
# Single characters, three at least, between white space, or dots, hyphens or underscores.
SPELLED = re.compile(r"(?<!\S)\S(?:(?:\s+\S(?!\S)){2,}|([._*-])\S(?:\1\S)+(?!\S))")
TWICE = re.compile(r"(\w)\1")
RUN = re.compile(r"([^\W\d_])\1+")
MANY = re.compile(r"([^\W\d_])\1{2,}")
TRIM = re.compile(r"^[^\w@$!|+(€£¡§]+|[^\w]+$")


def add_words(words: Counter, total: np.ndarray) -> None:
    """Adds the last three, two and one characters at each place of ``^^word$``."""
    three: dict[str, int] = {}
    for w, n in words.items():
        s = f"\x02\x02{w}\x03"
        for i in range(len(s) - 2):
            g = s[i:i + 3]
            three[g] = three.get(g, 0) + n
    for g, n in three.items():
        for part in (g, g[1:], g[2:]):
            total[zlib.crc32(part.encode()) % GRAMS] += n


class CharModel:
    """Interpolated character trigrams over hashed counters."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.total = counts, max(1.0, float(counts.sum()) / 3)
        self.memo: dict[str, float] = {}

    def _count(self, gram: str) -> float:
        return float(self.counts[zlib.crc32(gram.encode()) % GRAMS])

    def cost(self, before: str, char: str) -> float:
        """-log P(char | two characters before)."""
        gram = before + char
        known = self.memo.get(gram)
        if known is None:
            p = (self._count(char) + 0.5) / (self.total + 500)
            p = (self._count(gram[1:]) + 20 * p) / (max(self._count(before[1:]), self._count(gram[1:])) + 20)
            p = (self._count(gram) + 20 * p) / (max(self._count(before), self._count(gram)) + 20)
            known = self.memo[gram] = -math.log(p)
        return known


def arcs(token: str) -> list[list[tuple[str, float]]]:
    """Per place the (output, cost) arcs of the lattice."""
    out = []
    for i, c in enumerate(token):
        if c.isalpha():
            if i and token[i - 1] == c:
                far = i > 1 and token[i - 2] == c  # a third equal letter is no spelling
                out.append([("", FOLD_COST)] if far else [(c, 0.0), ("", TWICE_COST)])
            else:
                out.append([(c, 0.0)])
        else:
            own = [(x, SIGN_COST) for x in LEET.get(c, "")]
            out.append([*own, ("", SPARE_COST if own and c not in MASKS else DROP_COST)])
    return out


def viterbi(token: str, model: CharModel) -> str:
    """Likeliest letters of a token; ties go to the alphabetically first.

    What all paths begin with is set aside on the way, so time grows with the length.
    """
    best, done, known = {"\x02\x02": (0.0, "")}, [], model.memo
    for at, place in enumerate(arcs(token), 1):
        step: dict[str, tuple[float, str]] = {}
        if len(best) == 1 and len(place) == 1:  # one way on costs every path the same
            [(state, (cost, text))], char = best.items(), place[0][0]
            step[state[1:] + char if char else state] = (cost, text + char)
        else:
            for state, (cost, text) in best.items():
                for char, extra in place:
                    if char:
                        new, priced = state[1:] + char, known.get(state + char)
                        if priced is None:
                            priced = model.cost(state, char)
                        now = (cost + extra + priced, text + char)
                    else:
                        new, now = state, (cost + extra, text)
                    old = step.get(new)
                    if old is None or now < old:
                        step[new] = now
        best = step
        if at % 64 == 0:
            done.append(os.path.commonprefix([t for _, t in best.values()]))
            best = {s: (c, t[len(done[-1]):]) for s, (c, t) in best.items()}
    return "".join([*done, min((c + model.cost(s, "\x03"), t) for s, (c, t) in best.items())[1]])


def suspicious(token: str) -> bool:
    """A letter twice in a row, letters with a sign or digit among them, or signs and
    digits that may stand for letters."""
    if token.isalpha():
        return TWICE.search(token) is not None
    return any(c.isalpha() or c in LEET for c in token)


def pieces(decoded: str, least: int) -> Iterator[str]:
    """What may be a word in letters whose words' ends nothing marks."""
    for n in range(least, SPELLED_WORD + 1):
        for i in range(len(decoded) - n + 1):
            yield decoded[i:i + n]


def restore(token: str, model: CharModel) -> list[str]:
    """Words of a lower-case token without white space."""
    core = token.strip(".,;:?")
    if any(c.isalpha() for c in core):
        core = core if core.isalpha() else TRIM.sub("", token)
    if not suspicious(core):
        return WORD.findall(core)
    short = MANY.sub(r"\1\1", core)  # any more equal letters cost all paths the same
    whole = viterbi(short, model)
    plain, read = WORD.findall(core), [whole]
    if short != core or sum(1 for _ in RUN.finditer(core)) > 2:  # stretched throughout
        read.append(viterbi(RUN.sub(r"\1", core), model))
    words = [w for w in dict.fromkeys([*read, *plain]) if len(w) > 1 or (w == whole and plain)]
    return words if len(short) <= LONGEST else list(dict.fromkeys([*words, *pieces(whole, 4)]))


def restored_words(text: str | None, model: CharModel, memo: dict) -> Counter:
    """Counts of the restored words of a text."""
    out: Counter = Counter()
    low = (text or "").lower()
    if len(memo) > MEMO:
        memo.clear()
    for token, n in Counter(low.split()).items():
        words = memo.get(token)
        if words is None:
            words = restore(token, model)
            if len(words) <= SHORT:
                memo[token] = words
        for w in words:
            out[w] += n
    for m in SPELLED.finditer(low):  # nothing marks its words' ends: every stretch may be one
        whole = viterbi(m.group()[::2] if m[1] else "".join(m.group().split()), model)
        for w in [whole] * (len(whole) > SPELLED_WORD) + list(pieces(whole, 3)):
            out[w] = max(1, out[w])
    return out


def word_features(word: str) -> list[int]:
    """The word and its beginnings of four to six letters."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def text_features(text: str | None, model: CharModel, memo: dict, feats: dict) -> tuple:
    """(feature numbers, log(1 + count)) of one text."""
    got: Counter = Counter()
    if len(feats) > MEMO:
        feats.clear()
    for w, n in restored_words(text, model, memo).items():
        f = feats.get(w)
        if f is None:
            f = feats[w] = word_features(w)
        for i in f:
            got[i] += n
    return np.array(list(got), np.int64), np.log1p(np.array(list(got.values()), float))


@dataclass(frozen=True)
class Fit:
    """``sample`` bounds the labelled rows that are learned from, ``kept`` the features."""

    sample: int = 6000
    kept: int = 3000
    fewest: int = 8  # sample texts that a kept feature is in
    rounds: int = 400
    decay: float = 3e-4


@dataclass
class Regression:
    bias: float
    weights: dict[int, float]

    def raw(self, at, x) -> float:
        w = self.weights
        return self.bias + sum(w[i] * v for i, v in zip(at.tolist(), x.tolist()) if i in w)


def chosen(used: np.ndarray, a: np.ndarray, t: np.ndarray, n: int, pos: float,
           fit: Fit) -> np.ndarray:
    """Kept features by likelihood ratio of their presence, in falling gain.

    ``t`` of ``n`` texts have the feature, ``a`` of the ``pos`` texts of label 1.
    """
    def part(k, of, rate):
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(of * rate, 1e-9))
    gain = sum(part(k, t if m else n - t, r) for m in (1, 0) for k, r in (
        ((a if m else pos - a), pos / n), ((t - a if m else n - pos - t + a), 1 - pos / n)))
    gain[t < fit.fewest] = -1
    return np.sort(used[np.lexsort((used, -gain))[:min(fit.kept, int((gain > 0).sum()))]])


def train(doc: np.ndarray, at: np.ndarray, x: np.ndarray, labels: np.ndarray, keep: np.ndarray,
          fit: Fit) -> Regression:
    """Weights of the kept features by accelerated descent; entries (doc, feature, value)."""
    n, pos = len(labels), float(labels.sum())
    if not n or pos in (0, n):
        return Regression(20.0 * (pos > 0) - 10.0 if n else 0.0, {})
    order = np.lexsort((at, doc))
    doc, col, x = doc[order], np.searchsorted(keep, at[order]), x[order]
    w, b, rate = np.zeros(len(keep)), float(np.log(pos / (n - pos))), 0.0
    rate = 4.0 / max(1.0, np.bincount(doc, x * x, n).mean())
    look, prev = w.copy(), w.copy()
    for k in range(fit.rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, x * look[col], n), -30, 30)))
        slip = (p - labels) / n
        w = look - rate * (np.bincount(col, slip[doc] * x, len(keep)) + fit.decay * look)
        b -= slip.sum()
        look, prev = w + k / (k + 3) * (w - prev), w
    return Regression(b, dict(zip(keep.tolist(), w.tolist())))


def count_grams(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Character counters over the words of every text, summed before and after the shuffle.

    Each task adds the grams of its distinct words, weighted by their counts; what is
    summed grows with the corpus, the number of counters is fixed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(GRAMS), Counter()

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(x for x in map(_plain, t.lower().split()) if x)
            if len(words) > MEMO:
                add_words(words, total)
                words.clear()
        add_words(words, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    rows = (docs.select(text_col).mapInArrow(run, "slot long, n double")
            .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(GRAMS)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return CharModel(counts)


def _plain(token: str) -> str:
    """The token as a word of the model, or nothing."""
    if token.isalpha():
        return token if len(token) <= LONGEST else ""
    core = token.strip(".,;:?")
    core = core if core.isalpha() else TRIM.sub("", token)
    return core if core.isalpha() and len(core) <= LONGEST else ""


def fit_toxicity(docs: DataFrame, labels: DataFrame, model: CharModel, fit: Fit = Fit(),
                 target: str = "toxic", folds: int = 5, held_out: int = 0) -> Regression:
    """Learns on the driver from the bounded sample, restored on the executors."""
    sent = docs.sparkSession.sparkContext.broadcast(model.counts.astype(np.float32))

    def inputs(texts: pa.Array) -> pa.Array:
        lm, memo, feats = CharModel(sent.value), {}, {}
        got = [text_features(t.as_py(), lm, memo, feats) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([a for a, _ in got], pa.list_(pa.int32())),
             pa.array([x for _, x in got], pa.list_(pa.float32()))], ["at", "x"])

    made = F.arrow_udf(inputs, "at array<int>, x array<float>").asNondeterministic()
    sample = labelled_sample(docs.select("doc_id", "text"), labels, target, folds, held_out,
                             fit.sample)
    rows = write_stage(sample.select(
        F.col("_label").cast("int").alias("y"), F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").alias("id"), made("text").alias("f")), "sample")
    ids = rows.select("row", "id", "y").toArrow()  # bounded by the sample
    order = np.lexsort((ids.column("row").to_numpy(), ids.column("id").to_numpy()))
    row = ids.column("row").to_numpy()[order]
    y = ids.column("y").to_numpy()[order].astype(float)
    # which features to keep is counted by Spark; only entries of kept ones are gathered
    entry = rows.select("row", "y", F.explode(F.arrays_zip("f.at", "f.x")).alias("e")).select(
        "row", "y", F.col("e.at").alias("at"), F.col("e.x").alias("x"))
    seen = (entry.groupBy("at").agg(F.sum("y").cast("double").alias("a"),
                                    F.count("*").cast("double").alias("t"))
            .where(F.col("t") >= fit.fewest).toArrow())
    used, a, t = (seen.column(c).to_numpy() for c in ("at", "a", "t"))
    n, pos = len(y), float(y.sum())
    keep = chosen(used, a, t, n, pos, fit) if 0 < pos < n else np.zeros(0, np.int64)
    kept = docs.sparkSession.createDataFrame(pa.table({"at": pa.array(keep, pa.int32())}))
    got = entry.join(F.broadcast(kept), "at").select("row", "at", "x").toArrow()
    place = np.argsort(row)
    doc = place[np.searchsorted(row[place], got.column("row").to_numpy())]
    return train(doc, got.column("at").to_numpy(), got.column("x").to_numpy().astype(float),
                 y, keep, fit)


class Scorer:
    """Scores texts; keeps the features of tokens, which are none for most of them."""

    def __init__(self, model: CharModel, fitted: Regression):
        self.model, self.fitted = model, fitted
        self.words: dict[str, list[str]] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}

    def _kept(self, words) -> tuple[int, ...]:
        weights = self.fitted.weights
        return tuple(i for w in words for i in word_features(w) if i in weights)

    def counts(self, text: str | None) -> dict[int, int]:
        """Kept features of the restored words with their counts."""
        got: dict[int, int] = {}
        low = (text or "").lower()
        if SPELLED.search(low):
            parts = ((self._kept([w]), n) for w, n in
                     restored_words(text, self.model, self.words).items())
        else:
            if len(self.tokens) > MEMO:
                self.tokens.clear()
            parts = self._of_tokens(low)
        for own, n in parts:
            for i in own:
                got[i] = got.get(i, 0) + n
        return got

    def _of_tokens(self, low: str):
        known = self.tokens
        for token, n in Counter(low.split()).items():
            own = known.get(token)
            if own is None:
                own = self._kept(restore(token, self.model))
                if len(own) <= SHORT:
                    known[token] = own
            if own:
                yield own, n

    def __call__(self, text: str | None) -> float:
        weights = self.fitted.weights
        raw = self.fitted.bias + math.fsum(
            weights[i] * math.log1p(n) for i, n in self.counts(text).items())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, raw))))


def toxicity_score(spark: SparkSession, text: Column, model: CharModel, fitted: Regression) -> Column:
    """Probability of label 1; empty and null texts have no words and score by the bias."""
    sent = spark.sparkContext.broadcast((model.counts.astype(np.float32), fitted.bias,
                                         fitted.weights))  # fixed number of counters

    def run(texts: pa.Array) -> pa.Array:
        counts, bias, weights = sent.value
        scorer = Scorer(CharModel(counts), Regression(bias, weights))
        return pa.array([scorer(t.as_py()) for t in texts], pa.float64())
    return F.arrow_udf(run, "double").asNondeterministic()(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``docs`` with ``score``. Without labelled rows every score is 0.5."""
    model = count_grams(docs)
    fitted = fit_toxicity(docs, labels, model, fit)
    return docs.withColumn("score", toxicity_score(docs.sparkSession, F.col("text"), model, fitted))
