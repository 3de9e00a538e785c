"""Spelling variants, whitening and exact search against brute force and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n long, word string, root string"


def make_docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 1, "w", "r") for i, t in pairs], DOCS).repartition(3)


# 11: spelling variants

def brute_words(pairs):
    count = Counter()
    for i, t in pairs:
        for r in re.findall("[a-zÀ-ÿ]+", (t or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 7:
                count[r] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_groups(pairs):
    n = brute_words(pairs)
    form, near = {}, {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in n}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), r))
    return sorted(out)


def spelling_corpus():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdeé", k=rng.randint(7, 11))) for _ in range(40)]
    stems += ["bookkeeper", "bookkeper", "bookeeper", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "éàüößçñ"]

    def slip(w):
        k, c = rng.randrange(len(w)), rng.choice("abcdeéÿ")
        return rng.choice((w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:]))

    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(5, 80)):
            w = stems[min(int(rng.expovariate(0.1)), len(stems) - 1)]
            w = slip(w) if rng.random() < 0.2 else w
            words.append(slip(w) if rng.random() < 0.05 else w)
        texts.append(rng.choice((" ", "-", "1", "\n")).join(words))
    # a chain: each word a tenth as frequent as the next
    texts += [" ".join(["chainaaa"] * 2 + ["chainaab"] * 20 + ["chainabb"] * 200 + ["chainbbb"] * 2000)]
    texts += ["", " ", "ABCDEFG abcdefg AbCdEfG", "ÀÀÀÀÀÀÀÀ àààààààà ÀÀÀÀÀÀÀÀ", "x" * 3000 + " " + "x" * 3000,
              "日本語 русский слово слово"]
    return [(k * 7, t) for k, t in enumerate(texts)] + [(None, texts[0]), (5, None), (None, None),
                                                        (7, texts[1]), (7, texts[1])]


def test_spelling_groups(spark):
    from panelspark.llm.spelling import spelling_groups
    corpus = spelling_corpus()
    got = spelling_groups(make_docs(spark, corpus))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == brute_groups(corpus)
    by = {r[0]: r for r in rows}
    assert {"chainaab", "chainabb", "chainbbb"} <= set(by)  # three links followed to the end
    assert any(r[3] and r[3] != r[5] for r in rows)
    assert any(len(w) > 2900 for w in by)


def test_spelling_of_nothing(spark):
    from panelspark.llm.spelling import spelling_groups
    assert spelling_groups(make_docs(spark, [])).collect() == []
    assert spelling_groups(make_docs(spark, [(1, "short words only"), (2, None)])).collect() == []


def test_long_texts_are_cut_between_words(monkeypatch):
    from panelspark.llm import spelling
    monkeypatch.setattr(spelling, "PIECE", 10)
    rng = random.Random(1)
    text = " ".join("x" * rng.randint(1, 25) for _ in range(200)) + "y" * 50
    pieces = list(spelling._pieces(text, re.compile("[^a-z]")))
    assert "".join(pieces) == text
    assert [w for p in pieces for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


def test_node_numbers_across_parts(spark):
    """A node has one number wherever the sorted table is cut."""
    from panelspark.llm.spelling import number_nodes
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400)} | {"a" * 40})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = number_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    of = defaultdict(set)
    for r in rows:
        assert len(r.nodes) == len(r.word)
        for d, k in enumerate(r.nodes, 1):
            of[r.word[:d]].add(k)
    assert all(len(k) == 1 for k in of.values())
    assert len({min(k) for k in of.values()}) == len(of)
    last = {r.word: r.nodes[-1] for r in rows}
    assert sorted(words, key=last.get) == words


# 12: whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, component int, whitened double"


def make_vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, 2, 3, 0.5) for i, v in rows], VECTORS).repartition(4)


def odd_vectors(d):
    nan, inf = float("nan"), float("inf")
    return [(9001, None), (9002, [None] + [0.0] * (d - 1)), (9003, [nan] * d), (9004, [inf] + [0.0] * (d - 1)),
            (9005, [-inf] + [0.0] * (d - 1)), (9006, []), (None, [0.25] * d)]


def brute_whitening(rows, k=8):
    keep = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([np.float32(v) for _, v in keep]).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return keep, e, e / np.trace(c.T @ c / n), c @ v / np.sqrt(e), ((n * x - s) ** 2).sum(axis=1)


@pytest.mark.parametrize("d,many", [(12, 300), (5, 40), (1, 20)])
def test_whitening(spark, d, many):
    from panelspark.llm.feast_whitening import whiten
    rng = np.random.default_rng(d)
    base = rng.standard_normal((many, d)) * np.linspace(1, 3, d)
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)] + odd_vectors(d)
    rows += [rows[3], rows[3]]
    keep, e, share, white, dev = brute_whitening(rows)
    got = whiten(make_vectors(spark, rows)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                 "identity_error"]
    assert len(got) == len(keep) * min(8, d) and (got.n == len(keep)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    got["vec_id"] = got.vec_id.astype("float").fillna(-1)
    for c in range(min(8, d)):
        mine = got[got.component == c + 1].set_index("vec_id")
        assert np.allclose(mine.explained, share[c], rtol=1e-10)
        want = {(-1 if i is None else i): (w, v) for (i, _), w, v in zip(keep, white[:, c], dev)}
        sign = np.sign(sum(mine.whitened[i] * w for i, (w, _) in want.items() if i != 3))
        for i, (w, v) in want.items():
            a = mine.loc[[i]]
            assert np.allclose(a.whitened * sign, w, atol=1e-8) and (a.deviation == v).all()


def test_whitening_degenerate(spark):
    """No variance, fewer directions than components, equal eigenvalues, no rows."""
    from panelspark.llm.feast_whitening import whiten
    assert whiten(make_vectors(spark, [])).collect() == []
    assert whiten(make_vectors(spark, odd_vectors(3)[:6])).collect() == []
    assert whiten(make_vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect() == []
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)]
    got = whiten(make_vectors(spark, line)).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1)
    corners = [(k, [1.0 if j == k else 0.0 for j in range(12)]) for k in range(12)]
    got = whiten(make_vectors(spark, corners)).toPandas()
    assert set(got.component) == set(range(1, 9)) and got.identity_error.max() < 1e-9
    mixed = [(k, [float(k % 3), float(k % 5)]) for k in range(30)] + [(99, [1.0, 2.0, 3.0])]
    assert 99 not in set(whiten(make_vectors(spark, mixed)).toPandas().vec_id)


def test_inertia_and_intervals():
    from panelspark.llm.feast_whitening import inertia_above, intervals
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 9, 40):
        a = rng.standard_normal((d, d))
        for v in (a + a.T, a @ a.T, np.diag(np.arange(d, dtype=float)), np.fliplr(np.eye(d))):
            e = np.linalg.eigvalsh(v)
            for s in (-1.05, -0.3, 0.21, 0.77, 2.4):
                assert inertia_above(v, s) == (e > s).sum()
            for low, high, n in intervals(v, min(4, d)):
                assert n == ((e > low) & (e < high)).sum() > 0
            assert sum(n for _, _, n in intervals(v, min(4, d))) >= min(4, d)


def test_wide_deviation_is_null(spark):
    from panelspark.llm.feast_whitening import whiten
    far = [(k, [float(2 ** 28 * (k % 2)), float(k)]) for k in range(40)]
    got = whiten(make_vectors(spark, far)).toPandas()
    x = np.array([[int(1024 * c) + 100_000 for c in v] for _, v in far], dtype=object)
    dev = ((40 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    want = {k: int(v) if v < 2 ** 63 else None for k, v in enumerate(dev)}
    for k, v in zip(got.vec_id, got.deviation):
        assert (v is None or np.isnan(v)) if want[k] is None else int(v) == want[k]


# 13: exact top-k

def brute_top(rows, k=5):
    clean = sorted({(2 ** 63 - 1 if i is None else i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v))
                    for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)})
    out = []
    for q in sorted({i for i, _ in clean if i % 50 == 0}):
        s = [(-sum(a * b for a, b in zip(x, y)), j) for i, x in clean if i == q for j, y in clean
             if j != q and len(y) == len(x)]
        out += [(q, r, None if j == 2 ** 63 - 1 else j, -v) for r, (v, j) in enumerate(sorted(s)[:k], 1)]
    return out


def search_rows(kind):
    rng = np.random.default_rng(5)
    if kind == "copies":  # one vector on a third of the rows, queries among them
        base = rng.standard_normal((90, 6))
        rows = [(k, list(map(float, base[k % 90]))) for k in range(200)]
        rows += [(k, [0.5] * 6) for k in range(200, 320)]
    elif kind == "ties":  # one-hot vectors: all scores are zero or one
        rows = [(k, [1.0 if j == k % 8 else 0.0 for j in range(8)]) for k in range(160)]
    elif kind == "outliers":
        rows = [(k, list(map(float, v))) for k, v in enumerate(rng.standard_normal((250, 5)))]
        rows += [(1000, [1e5, 0.0, 0.0, 0.0, -1e5]), (1001, [-3e4] * 5), (1050, [0.0] * 5)]
    else:
        rows = [(k - 100, list(map(float, v))) for k, v in enumerate(rng.standard_normal((400, 16)))]
    return rows


@pytest.mark.parametrize("kind", ["plain", "copies", "ties", "outliers"])
def test_exact_top_k(spark, kind, monkeypatch):
    from panelspark.llm import va_file
    monkeypatch.setattr(va_file, "SHARD", 600)
    monkeypatch.setattr(va_file, "BLOCK", 3)
    monkeypatch.setattr(va_file, "FIRST", 1)
    rows = search_rows(kind)
    got = va_file.exact_top_k(make_vectors(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)


def test_exact_top_k_odd_rows(spark):
    from panelspark.llm.va_file import exact_top_k
    rows = search_rows("plain")[95:170] + odd_vectors(16) + [(50, [1.0, 2.0]), (7, [3.0, 4.0])]
    rows += [rows[5], rows[5], (rows[5][0], [0.25] * 16), (None, [1.0] * 16)]
    got = exact_top_k(make_vectors(spark, rows))
    key = lambda r: (r[0], r[1])
    want = brute_top(rows)
    best = defaultdict(list)
    for q, _, j, s in want:
        best[q].append((-s, 2 ** 63 - 1 if j is None else j))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert exact_top_k(make_vectors(spark, [])).collect() == []
    few = [(50, [1.0]), (51, [2.0]), (52, [-1.0])]
    assert [tuple(r) for r in exact_top_k(make_vectors(spark, few)).orderBy("rank").collect()] == [
        (50, 1, 51, 131072), (50, 2, 52, -65536)]


def test_scan_leaves_most_vectors_unread():
    """On clustered vectors the bounds alone rule out nearly all entries."""
    from panelspark.llm import va_file
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    x = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.1 * rng.standard_normal((4000, 32)))).astype(np.int64)
    limits = []
    for j in range(32):
        cut = np.unique(np.quantile(x[:, j], np.arange(1, 64) / 64, method="lower").astype(np.int64))
        limits.append(np.concatenate(([x[:, j].min()], cut[cut > x[:, j].min()], [x[:, j].max() + 1])))
    codes = va_file._codes(x, limits)
    lo = np.stack([c[codes[:, j]] for j, c in enumerate(limits)], axis=1)
    hi = np.stack([c[codes[:, j] + 1] - 1 for j, c in enumerate(limits)], axis=1)
    assert (lo <= x).all() and (x <= hi).all()
    left = sum(len(i) for i, *_ in va_file._survivors(x[:50], np.arange(4000), lo, hi, 6))
    assert left < 0.05 * 50 * 4000
