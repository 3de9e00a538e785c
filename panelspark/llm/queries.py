"""The text operators on the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.bloom_cascade import judge_urls
from panelspark.llm.bpe_automaton import bpe_digest
from panelspark.llm.compression_bands import compression_bands
from panelspark.llm.decontaminate import contaminated
from panelspark.llm.feast_whitening import whiten
from panelspark.llm.noisy_channel import score_toxicity
from panelspark.llm.quality_fm import score_quality
from panelspark.llm.secret_novelty import secret_digest
from panelspark.llm.shared import fold, read
from panelspark.llm.simhash import hex16, near_duplicates
from panelspark.llm.spelling import spelling_groups
from panelspark.llm.sparse_suffixes import repeated_passages
from panelspark.llm.va_file import exact_top_k
from panelspark.llm.warc_index import archive_and_read


def BPE_FILE() -> str:
    """The tokenizer file that the box offers; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    b = compression_bands(docs)
    return b.select("doc_id", *(f"bands.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "ratio", "bad_chunk_share")))


@query
def op9_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs.withColumn("d", bpe_digest(spark, F.col("text"), BPE_FILE()))
    return d.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


@query
def op10_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs.withColumn("d", secret_digest(F.col("text")))
    return d.select("doc_id", "d.n_assign", "d.n_access", "d.n_hex", "d.base_sha256", "d.spans")


# Path rules: fixed by contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
SPAM_WORDS = ["casino", "bet", "bets", "betting", "poker", "jackpot", "lottery", "pills",
              "viagra", "loans", "porn", "xxx"]


@query
def op7_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), RULES, SPAM_WORDS)


def _fits(rule: str) -> str:
    site, _, start = rule.partition("/")
    return (f"(host = '{site}' OR ends_with(host, '.{site}')) "
            f"AND starts_with(path, '/{start}')")


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0]))
SQL["op7_bloom_cascade"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed AS (
  SELECT DISTINCT host FROM parts
  WHERE list_has_any(regexp_split_to_array(host, '[.-]'), {SPAM_WORDS}))
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{v}'" for r, v in _BY_LENGTH)}
    WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


@query
def op4_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read(spark, sf_dir, "pages"))


SQL["op4_warc_capture_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100
  THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f"""


@query
def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op5_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


@query
def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    got = score_quality(docs, read(spark, sf_dir, "labels"))
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_toxicity(docs, read(spark, sf_dir, "labels"))
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


# crc32 by its table of 256 bytes; words without a letter meet on what is left
SQL["op11_trie_pairs"] = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
h AS (SELECT run, k, xor(list_reduce(list_transform(range(1, length(x), 2),
    lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, tab),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
s AS MATERIALIZED (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z
    FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS MATERIALIZED (SELECT x.word AS u, y.word AS w FROM s x JOIN s y ON x.i = y.i AND x.a = y.a
      AND x.z = y.z AND x.word <> y.word
    UNION SELECT s.word, v.word FROM s JOIN v ON v.word = s.a || s.z
    UNION SELECT v.word, s.word FROM s JOIN v ON v.word = s.a || s.z),
f AS MATERIALIZED (SELECT v.word, v.n, count(p.w) AS k, max(o.n) AS most,
    min(o.word) FILTER (o.n = (SELECT max(q.n) FROM p z JOIN v q ON q.word = z.w
      WHERE z.u = v.word)) AS best
    FROM v LEFT JOIN p ON p.u = v.word LEFT JOIN v o ON o.word = p.w GROUP BY v.word, v.n),
g AS MATERIALIZED (SELECT word, n, k, CASE WHEN most >= 10 * n THEN best END AS form,
    CASE WHEN most >= 10 * n THEN most END AS form_n FROM f),
c AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL
    SELECT c.word, g.form, step + 1 FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM c WHERE c.word = g.word) AS root,
  n, k AS n_near, form_n FROM g"""


@query
def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


@query
def op13_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"))


SQL["op13_va_file"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c:
    CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c:
    c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x),
    lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""
