"""Bounded labelled samples for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int,
                    rows: int) -> DataFrame:
    """Text columns of at most ``rows`` labelled documents outside the held-out fold.

    The bound holds the driver's memory; the rows are those with the smallest hash of the
    id, so they are spread evenly and stay the same under any partitioning. Labels
    repeated for an id count as one, the smallest; null labels and ids are left out. Ids
    and labels never reach a score: the label is the target only.
    """
    ids = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()
                        & (fold("doc_id", folds) != held_out))
           .groupBy("doc_id").agg(F.min(target).alias("_label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.join(ids, "doc_id")
