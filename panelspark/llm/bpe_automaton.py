"""BPE as a deterministic automaton over tokens: encode by transitions, decode by labels.

The automaton starts with one state in which every symbol leads back to it. For each
merge (u, v) -> w, in order, a gadget is added: the state behind u is copied, the copy
loses its v arc and becomes the state behind u; every state with a u arc gains a w arc
to the state behind v. A token sequence then has a path exactly if it is the BPE encoding
of what its labels spell, so each prefix of a word has one last token, and all arcs of a
token lead to the same state.

A copy shares the arcs of its original, so three notes per gadget hold the automaton:
the arc that was lost and when (``lost``), the token whose state the new one continues
(``tail``), and the token whose arcs the new one follows (``head``). ``table`` keeps the
transitions that texts have used.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import sha

MEMO = 200_000  # chunks, pieces or transitions a worker keeps before it starts afresh
LONG = 64  # longer chunks are not kept
# White space by Unicode; Python's own split() also takes U+001C to U+001F.
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
NEVER = float("inf")


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Automaton:
    """Compiled merges. Tokens are numbers; ``end`` closes the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.label = {i: t for t, i in vocab.items()}
        self.head: dict[int, int] = {}
        self.tail: dict[int, int] = {}
        self.born: dict[int, float] = {}
        self.lost: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        dead: set[int] = set()
        for i, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.born or self.born.get(u, -1) >= i or self.born.get(v, -1) >= i:
                raise ValueError(f"merge {i} uses a later token or repeats a result")
            if u in dead or v in dead or not self._arc(u, v):
                dead.add(w)  # no path has u before v, so no arc ever gets this label
            else:
                self.lost[u, v] = i
            self.head[w], self.tail[w], self.born[w] = u, v, i
        if any(part not in self.born and len(self.label[part].removesuffix(end)) > 1
               for pair in self.lost for part in pair):
            raise ValueError("a merge uses a token that no merge makes")
        # Without an end mark, every token may stand anywhere in a word.
        vocab = {t: i for t, i in vocab.items() if i not in dead}
        self.inner = self._by_ending(t for t in vocab.items() if not (end and t[0].endswith(end)))
        self.final = self._by_ending((t.removesuffix(end), i) for t, i in vocab.items()
                                     if t.endswith(end))

    @staticmethod
    def _by_ending(tokens: Iterable[tuple[str, int]]) -> dict:
        """Tree of the tokens read backwards; a token's number stands under ``None``."""
        root: dict = {}
        for text, number in tokens:
            node = root
            for c in reversed(text):
                node = node.setdefault(c, {})
            if text:
                node[None] = number
        return root

    def _arc(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has an arc for ``token``.

        The state continues that of the tail of ``last`` before its gadget, and so on; an arc
        follows that of its head. So it is absent if a part lost it while it was shared.
        """
        until: float = NEVER
        while True:
            part, made = token, NEVER
            while True:
                when = self.lost.get((last, part))
                if when is not None and when < until and when <= made:
                    return False
                if part not in self.head:
                    break
                made, part = self.born[part], self.head[part]
            if last not in self.tail:
                return True
            until, last = min(until, self.born[last]), self.tail[last]

    def arc(self, last: int, token: int) -> bool:
        known = self.table.get((last, token))
        if known is None:
            if len(self.table) >= MEMO:
                self.table.clear()
            known = self.table[last, token] = self._arc(last, token)
        return known

    def encode(self, word: str) -> list[int]:
        """Tokens of one word: each prefix has exactly one last token that an arc allows."""
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        table, inner = self.table, self.inner
        for k in range(1, n + 1):
            node, a = self.final if k == n else inner, k
            while a:  # tokens that end here; the one that an arc allows is the only one
                node = node.get(word[a - 1])
                if node is None:
                    break
                a -= 1
                t = node.get(None)
                if t is not None:
                    if a:
                        u = last[a]
                        known = table.get((u, t))
                        if not (u >= 0 and self.arc(u, t) if known is None else known):
                            continue
                    last[k], start[k] = t, a
                    break
        out, k = [], n
        while k:
            if last[k] < 0:
                raise ValueError("a symbol is not in the vocabulary")
            out.append(last[k])
            k = start[k]
        return out[::-1]


class Tokenizer:
    """Pre-splitting, the automaton and the added tokens of one tokenizer file."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model, kinds = conf["model"], [x["type"] for x in conf["normalizer"]["normalizers"]]
        split, level = conf["pre_tokenizer"]["pretokenizers"]
        if (model["type"], kinds, split["behavior"], split["invert"], level["use_regex"],
                level["add_prefix_space"], conf["decoder"], model["byte_fallback"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "Removed", True, False, False, None, False):
            raise ValueError("a tokenizer of another kind")
        self.split = regex.compile(split["pattern"]["Regex"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-split piece; those of short pieces are kept."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = tuple(self.automaton.encode("".join([self.letters[b] for b in piece.encode()])))
            if len(piece) <= LONG:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def pre_split(self, chunk: str) -> list[str]:
        """Pieces of a chunk. Characters of no category are symbols, never letters."""
        if chunk.isascii():
            return self.split.findall(chunk)
        shown = "".join("\u2603" if unicodedata.category(c) == "Cn" else c for c in chunk)
        return [chunk[m.start():m.end()] for m in self.split.finditer(shown)]

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number, ids, labels) of a text without white space."""
        known = self.memo.get(chunk)
        if known is None:
            ids = [i for piece in self.pre_split(chunk) for i in self.piece(piece)]
            known = (len(ids), " ".join(map(str, ids)),
                     " ".join([self.automaton.label[i] for i in ids]))
            if len(chunk) <= LONG:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = known
        return known

    def chunks(self, text: str):
        """The chunks of a text in order; an added token is a chunk by itself."""
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.added:
                yield 1, str(self.added[part]), part
                continue
            part = unicodedata.normalize("NFC", part)
            # a capital sigma is lowered by itself, whatever stands behind it
            part = (part.replace("Σ", "σ") if "Σ" in part else part).lower()
            plain = not any(c in part for c in "\x1c\x1d\x1e\x1f")
            for w in part.split() if plain else SPACE.split(part):
                if w:
                    yield self.chunk(w)

    def encode(self, text: str) -> np.ndarray:
        ids = " ".join([ids for _, ids, _ in self.chunks(text)])
        return np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Arc labels with one space between them."""
        names = {i: t for t, i in self.added.items()}
        return " ".join([names.get(i) or self.automaton.label[i] for i in ids])


_MADE: dict[str, Tokenizer] = {}  # one per file and worker


def _tokenizer(spec: str) -> Tokenizer:
    key = sha(spec)
    if key not in _MADE:
        _MADE[key] = Tokenizer(spec)
    return _MADE[key]


def _spec(spark: SparkSession, path: str):
    """The file, sent once to each executor; its size does not depend on the texts."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int> of token ids; null and empty texts give an empty array."""
    spec = _spec(spark, path)

    def run(texts: pa.Array) -> pa.Array:
        t = _tokenizer(spec.value)
        ids = [t.encode(x.as_py() or "") for x in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))
    return F.arrow_udf(run, "array<int>").asNondeterministic()(text)


def bpe_decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """Text of an id array; a null or empty array gives an empty text."""
    spec = _spec(spark, path)

    def run(lists: pa.Array) -> pa.Array:
        t = _tokenizer(spec.value)
        return pa.array([t.decode(x.as_py() or []) for x in lists], pa.string())
    return F.arrow_udf(run, "string").asNondeterministic()(ids)


def bpe_digest(spark: SparkSession, text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of encoding and decoding again."""
    spec = _spec(spark, path)

    def run(texts: pa.Array) -> pa.Array:
        t, rows = _tokenizer(spec.value), []
        for x in texts:
            parts = list(t.chunks(x.as_py() or ""))
            rows.append((sum(p[0] for p in parts), sha(" ".join(p[1] for p in parts)),
                         sha(" ".join(p[2] for p in parts))))
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
             pa.array(cols[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
    return F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string"
                       ).asNondeterministic()(text)
