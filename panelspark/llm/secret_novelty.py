"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

A string beside a sensitive word is a secret if it is new to its surroundings: the bytes
that it adds to the compressed text around it, with a dictionary of common identifiers
loaded first, stay close to its length. Names, paths and prose are found in one of the
two or share their statistics, and cost little.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.llm.shared import sha

# Base patterns: fixed by contract.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Words beside which an unknown string is sensitive, and names that are common in code.
SENSITIVE = re.compile(
    r"(?ai:pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|auth|credential|bearer|"
    r"private|access|signature|signing|encrypt|session|key)")
# What may stand between the pieces of one secret, short dotted pieces included.
LINK = re.compile(r"""(?:[\s."'`,\\]|\+(?=\s)|(?<=\.)[A-Za-z0-9+/_=-]{1,15}(?=\.))*""")
BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----")
PIECE = re.compile(r"[A-Za-z0-9+/_=-]+")
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx
example placeholder changeme default undefined required optional deprecated configuration
environment variable application production development staging database connection
localhost username password passphrase secret token access_token refresh_token api_key
apikey client_id client_secret private_key public_key authorization bearer signature
credential certificate session cookie request response header content-type
application/json multipart/form-data text/html charset=utf-8 http:// https:// www. .com
.org .net /usr/local/bin /etc/ssl/certs /home/user/.ssh/id_rsa getElementById
addEventListener toString hasOwnProperty DEFAULT_TIMEOUT MAX_RETRIES ACCESS_KEY_ID
SECRET_ACCESS_KEY aws_access_key_id aws_secret_access_key your_api_key_here
""".split()


@dataclass(frozen=True)
class Novelty:
    """``reach``: characters between a sensitive word and the first piece of a candidate;
    ``around``: context on each side; ``least``: added bytes per character from which a
    string is reported."""

    identifiers: tuple[str, ...] = tuple(IDENTIFIERS)
    min_chars: int = 16
    reach: int = 48
    around: int = 400
    least: float = 0.6
    level: int = 9


@lru_cache(maxsize=4)
def _packer(conf: Novelty) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(" ".join(conf.identifiers).encode(),
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=conf.level, dict_data=primed, write_checksum=False,
                                    write_content_size=False)


@lru_cache(maxsize=4)
def _candidate(conf: Novelty) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % conf.min_chars)


def added_bytes(text: str, start: int, end: int, conf: Novelty) -> int:
    """Compressed bytes of the surroundings with the candidate, less those without it."""
    before = text[max(0, start - conf.around):start]
    after = text[end:end + conf.around]
    pack = _packer(conf).compress
    return len(pack((before + text[start:end] + after).encode())) - len(
        pack((before + after).encode()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kinds may overlap each other."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) between the BEGIN and END marks of private keys."""
    out, at = [], 0
    while "-----BEGIN" in text and (m := BEGIN.search(text, at)):
        at = text.find("-----END", m.end())
        if at < 0:
            break
        out.append((m.end(), at))
    return out


def novel_spans(text: str, known: list[tuple[int, int, int]],
                conf: Novelty) -> list[tuple[int, int, int]]:
    """Unknown strings after a sensitive word that no base span touches.

    A candidate holds letters and digits and begins within ``reach`` of the word, or
    follows the candidate before it with nothing but separators between. Such pieces are
    one secret where they are new together, and else measured each. What stands between
    the marks of a private key is one candidate, whatever lines it has. Each is measured
    once, however many words stand before it.
    """
    out, done = [], -1
    run = _candidate(conf)

    def fits(a: int, b: int) -> bool:
        body = text[a:b]
        return not (any(s < b and e > a for s, _, e in known) or body.isalpha()
                    or not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body))

    def novel(a: int, b: int) -> bool:
        return added_bytes(text, a, b, conf) >= conf.least * (b - a)

    blocks = key_blocks(text)
    for start, end in blocks:
        found = [m.span() for m in PIECE.finditer(text, start, end)]
        if any(b - a >= conf.min_chars for a, b in found) and novel(found[0][0], found[-1][1]):
            out.append((found[0][0], 3, found[-1][1]))
    for word in SENSITIVE.finditer(text):
        at = word.end()
        limit = at + conf.reach
        at = max(at, done)
        while at < limit:
            m = run.search(text, at)
            if m is None or m.start() >= limit:
                break
            chain = []
            while m is not None:
                a, b = m.span()
                inside = [e for s, e in blocks if s < b and e > a]
                if not inside:
                    chain.append((a, b))
                at = done = max(b, *inside) if inside else b
                m = run.match(text, LINK.match(text, at).end())
            whole = len(chain) > 1 and novel(chain[0][0], chain[-1][1])
            out += [(a, 3, b) for a, b in chain if fits(a, b) and (whole or novel(a, b))]
    return out


def find_secrets(text: str | None, conf: Novelty = Novelty()) -> list[tuple[int, int, int]]:
    """All spans by start, then kind; null and empty texts have none."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, conf))


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with each stretch covered by spans replaced by one mark."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(text: Column, conf: Novelty = Novelty()) -> Column:
    """array<struct(start, kind, end)>, code points, end exclusive, overlapping kinds kept."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "kind": KINDS[k], "end": b}
                          for a, k, b in find_secrets(t.as_py(), conf)] for t in texts], kind)
    return F.arrow_udf(run, "array<struct<start:int,kind:string,end:int>>"
                       ).asNondeterministic()(text)


def secret_digest(text: Column, conf: Novelty = Novelty()) -> Column:
    """Counts of the base kinds, a digest of the base spans, and all spans as one string."""
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            spans = find_secrets(t.as_py(), conf)
            base = [s for s in spans if s[1] < 3]
            n = [sum(s[1] == k for s in base) for k in range(3)]
            rows.append((*n, sha(_joined(base)), _joined(spans)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return F.arrow_udf(run, "n_assign long, n_access long, n_hex long, base_sha256 string, "
                       "spans string").asNondeterministic()(text)


def redact_secrets(text: Column, mark: str = "[SECRET]", conf: Novelty = Novelty()) -> Column:
    """The text without its secrets; a null text stays null."""
    def run(texts: pa.Array) -> pa.Array:
        values = [t.as_py() for t in texts]
        return pa.array([redact(t, find_secrets(t, conf), mark) for t in values], pa.string())
    return F.arrow_udf(run, "string").asNondeterministic()(text)
