"""Quality rules by zstandard ratio, over whole documents and fixed chunks.

Repetitive text compresses too well, noise too little; what is usual depends on the
length, because a short text gives the compressor nothing to refer back to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes / bytes.

    ``whole``: (bytes below, lowest, highest) in rising order. ``chunk`` holds for
    pieces of ``chunk_bytes``; a last piece below half of that joins the one before.
    A text fails if its whole ratio is outside, or more than ``bad_share`` of its bytes
    lie in pieces outside. Texts below the first length are not judged.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.0, 9e9), (1024, 0.36, 0.85), (4096, 0.30, 0.75),
        (16384, 0.25, 0.68), (9e18, 0.20, 0.62))
    chunk: tuple[float, float] = (0.30, 0.75)
    chunk_bytes: int = 2048
    bad_share: float = 0.5
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, first one included."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, inv, count = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True,
                              return_counts=True)
    again = count[inv] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= again
    return int(cover.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)), dup, repeated_words(words))


def ratios(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor):
    """(whole ratio, share of bytes in pieces outside the chunk limits)."""
    if not data:
        return 0.0, 0.0
    size = bands.chunk_bytes
    starts = list(range(0, len(data), size))
    if len(starts) > 1 and len(data) - starts[-1] < size // 2:
        starts.pop()
    bad = 0
    for a, b in zip(starts, [*starts[1:], len(data)]):
        r = len(packer.compress(data[a:b])) / (b - a)
        bad += (b - a) * (not bands.chunk[0] <= r <= bands.chunk[1])
    return len(packer.compress(data)) / len(data), bad / len(data)


def verdict(n_bytes: int, whole: float, bad_share: float, bands: Bands) -> bool:
    if n_bytes < bands.whole[0][0]:
        return True
    low, high = next((lo, hi) for below, lo, hi in bands.whole if n_bytes < below)
    return low <= whole <= high and bad_share <= bands.bad_share


OUT = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("ratio", pa.float64()), ("bad_chunk_share", pa.float64()), ("kept", pa.bool_())])
DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, ratio double, bad_chunk_share double, kept boolean")


def compression_verdict(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of statistics, ratios and the verdict for a text column.

    Null and empty texts have no words, ratio 0 and fail the base rule. Each text is
    judged whole and alone, so repeated rows get equal verdicts and nothing is shuffled.
    """
    def judge(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for t in texts:
            t = t.as_py()
            n, chars, sym, dup, rep = text_stats(t)
            failed = n < bands.min_words or 100 * rep > bands.max_repeat_percent * n
            data = (t or "").encode()
            whole, bad = ratios(data, bands, packer)
            kept = not failed and verdict(len(data), whole, bad, bands)
            rows.append((n, chars, sym, dup, rep, failed, whole, bad, kept))
        cols = list(zip(*rows)) if rows else [[] for _ in OUT]
        return pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(cols, OUT)], fields=list(OUT))

    return F.arrow_udf(judge, DDL).asNondeterministic()(text)


def compression_bands(docs: DataFrame, text_col: str = "text", out: str = "bands",
                      bands: Bands = Bands()) -> DataFrame:
    """``docs`` with the struct column ``out``; every other column is carried along."""
    return docs.withColumn(out, compression_verdict(F.col(text_col), bands))
