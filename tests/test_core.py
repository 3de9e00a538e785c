import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import stats
from panelspark.functions import text as X
from panelspark.operators import core as C


def frame(spark, rng, n=3000):
    g = rng.choice(["a", "b", None], n, p=[.6, .3, .1])  # one key holds most rows
    v = np.where(rng.random(n) < .3, 7.0, np.round(rng.normal(0, 50, n), 1))
    v[:20] = [0, -0.0, 1, 2, 4, .5, .25, -1, -2, -4, 1e9, -1e9, 1e-9, 1024, 1023.9999999,
              1024.0000001, -1024, -1023.9999999, 3, 6]
    return pd.DataFrame({"g": g, "v": v + 0.0})


@pytest.mark.parametrize("crowded", [200_000, 3])
def test_ordered_cumulative_matches_sort(spark, monkeypatch, crowded):
    monkeypatch.setattr(C, "CROWDED", crowded)
    pdf = frame(spark, np.random.default_rng(1))
    df = spark.createDataFrame(pdf, "g string, v double").repartition(7)
    got = C.ordered_cumulative(df, ["g"], "v", {"n": F.lit(1)}).toPandas()
    got["g"] = got["g"].fillna("-")
    pdf["g"] = pdf["g"].fillna("-")
    for g, part in pdf.groupby("g"):
        want = part.groupby("v").size().sort_index()
        have = got[got.g == g].set_index("v").sort_index()
        assert (have["n"] == want).all()
        assert (have["n_before"] == want.cumsum() - want).all()
        assert (have["n_all"] == len(part)).all()


def test_exact_quantiles(spark):
    pdf = frame(spark, np.random.default_rng(2))
    df = spark.createDataFrame(pdf, "g string, v double")
    pos = F.col("v") > 0
    q = C.exact_quantiles(df, ["g"], "v", {"a": .05, "b": .5, "c": (.9, pos)}).toPandas()
    one = C.exact_quantiles(df, [], "v", {"m": .37}, kind=1).first()["m"]
    for _, r in q.iterrows():
        part = pdf[pdf.g.isna()] if r.g is None else pdf[pdf.g == r.g]
        assert r.a == pytest.approx(np.quantile(part.v, .05))
        assert r.b == pytest.approx(np.quantile(part.v, .5))
        assert r.c == pytest.approx(np.quantile(part.v[part.v > 0], .9))
    assert one == np.quantile(pdf.v, .37, method="inverted_cdf")


def test_first_k_is_exact_and_independent_of_partitions(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") < 4500, "hot").otherwise("x")
                                 .alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    def pick(x):
        return sorted(map(tuple, C.first_k_per_group(x, ["g"], "h", "id", 300)
                          .select("g", "id").collect()))
    got = pick(d.repartition(3))
    assert got == pick(d.repartition(11, "id"))
    pdf = d.toPandas().sort_values("h")
    want = sorted((g, i) for g, p in pdf.groupby("g") for i in p.head(300)["id"])
    assert got == want


def test_global_index_is_dense(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(9)
    got = C.global_index(d, [F.col("k")], "pos").toPandas().sort_values("k")
    assert got["pos"].tolist() == list(range(1, 1001))


def test_registry_and_broadcast_limits(spark):
    with pytest.raises(ValueError):
        C.registry(spark, ["a"], [(i,) for i in range(10_001)])
    small = C.small_side(spark.range(5).toDF("k"), 10)
    big = C.small_side(spark.range(50).toDF("k"), 10)
    def hinted(d):
        return "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small) and not hinted(big)


def test_tails(spark):
    for k, n, p in [(3, 10, .1), (0, 5, .5), (10, 10, .3), (60, 100, .5), (90, 500, .15)]:
        want = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k, n + 1))
        assert stats.binomial_upper_tail(k, n, p) == pytest.approx(want, rel=1e-8)
    p = spark.range(1).select(stats.two_sided_p(F.lit(1.959963984540054))).first()[0]
    assert p == pytest.approx(.05)
    r = spark.createDataFrame([(3, 10, .1), (1, 2, 0.0)], "k long, n long, p double")
    got = [x[0] for x in r.select(stats.binomial_greater_p("k", "n", "p")).collect()]
    assert got[0] == pytest.approx(0.0701908264) and got[1] is None


def test_text_edges(spark):
    d = spark.createDataFrame([("1", "  a--b ", "1899-12-30", "2004"), ("x", None, "1999-05-01", "1"),
                               ("08", "<MISSING>", "junk", "99999")], "c string, k string, d string, y string")
    r = d.select(X.pad_code(F.col("c")).alias("p"), X.normalise_or_missing(F.col("k")).alias("n"),
                 X.resolve_event_year(F.col("d"), F.col("y"), "1899-12-30").alias("y")).collect()
    assert [x["p"] for x in r] == ["01", None, "08"]
    assert [x["n"] for x in r] == ["A B", "<MISSING>", "<MISSING>"]
    assert [x["y"] for x in r] == [2004, 1999, None]
