"""Document pipeline: each stage reads what the stage before has kept.

Columns of ``documents`` (doc_id, text, lang, source, n_chars) pass through every stage
but the last. Rows with null ids or texts, repeated rows and empty tables go through each
stage as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.bpe_automaton import bpe_encode
from panelspark.llm.compression_bands import compression_bands
from panelspark.llm.decontaminate import find_leaks
from panelspark.llm.queries import BPE_FILE
from panelspark.llm.secret_novelty import redact_secrets
from panelspark.llm.shared import read, write_stage
from panelspark.llm.simhash import near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    judged = compression_bands(docs, out="_bands")
    return judged.where(F.col("_bands.kept")).drop("_bands")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Documents without an id stay. Rows that repeat the id that stays are one document:
    only ids found more than once go through another shuffle, and mostly there are none.
    """
    groups = write_stage(near_duplicates(docs), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = write_stage(groups.where("doc_id = component_id").groupBy("doc_id").count()
                        .where("count > 1").select("doc_id"), "repeated_ids")
    if twice.isEmpty():
        return stay
    one = stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"), out="_leaks")
    return found.where(F.size("_leaks") == 0).drop("_leaks")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and its length counted again."""
    return (docs.withColumn("text", redact_secrets(F.col("text")))
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number for every document."""
    ids = docs.select("doc_id", bpe_encode(spark, F.col("text"), BPE_FILE()).alias("ids"))
    return ids.select("doc_id", "ids", F.size("ids").alias("n_tokens"))


STAGES = [("quality_rules", quality_rules), ("simhash_near_duplicates", near_duplicate_groups),
          ("benchmark_decontamination", benchmark_decontamination),
          ("secret_scans", secret_scans), ("bpe_encoding", bpe_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# zstandard, fingerprint groups and tokenization cannot be said in SQL.
ORACLE_SQL = None
