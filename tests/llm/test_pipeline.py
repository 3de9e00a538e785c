"""The stages on a small table, each against a brute-force version of its decision."""

import corpus_pipeline
from test_text_operators import brute_base, brute_groups, brute_print, make_docs, prose

import random


def test_stages(spark, tmp_path, corpus_rows):
    rows, items = corpus_rows
    sf = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = make_docs(spark, rows)
    columns = docs.columns
    docs.write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert left and all(not brute_base(t)[5] for _, t in left)
    one = corpus_pipeline.near_duplicate_groups(spark, kept, sf)
    assert one.columns == columns
    fps = [(i, brute_print(t)) for i, t in left]
    want = {i for (i, _), c in zip(fps, brute_groups(fps)) if i == c and i is not None}
    got = [r.doc_id for r in one.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want)  # a repeated id stays once
    assert got.count(None) == sum(i is None for i, _ in left)
    clean = corpus_pipeline.benchmark_decontamination(spark, one, sf)
    assert clean.columns == columns
    gone = {i for i in got} - {r.doc_id for r in clean.collect()}
    assert gone == {700}
    safe = corpus_pipeline.secret_scans(spark, clean, sf)
    assert safe.columns == columns and safe.count() == clean.count()
    (r,) = safe.where("doc_id = 701").collect()
    assert "hunter2hunter2" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text)
    out = corpus_pipeline.bpe_tokens(spark, safe, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() == safe.count()
    assert corpus_pipeline.run(spark, sf).count() == out.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id = -99"), sf).count() == 0


import pytest  # noqa: E402


@pytest.fixture
def corpus_rows():
    rng = random.Random(21)
    texts = [prose(rng, 120) for _ in range(12)]
    item = prose(rng, 30)
    rows = list(enumerate(texts)) + [
        (20, texts[2]), (2, texts[2]), (None, texts[4]), (None, None), (30, "na " * 300), (31, ""),
        (700, f"{prose(rng, 60)} {item} {prose(rng, 60)}"),
        (701, f'{prose(rng, 60)} password = "hunter2hunter2" {prose(rng, 60)}')]
    return rows, [(1, item), (2, None), (None, "")]
