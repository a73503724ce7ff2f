"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on, unless the caller says otherwise.
SAMPLE_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, *columns): whole texts of at most ``rows`` labelled documents, chosen by a hash of the id.

    Labels without an id or with a null among ``columns`` are left out; an id labelled twice keeps its greatest
    labels, an id with several texts the one with the smallest hash. The chosen ids are at most ``rows`` rows, hence
    broadcast; repeated rows are dropped before texts are shuffled.
    """
    chosen = (
        labels.dropna(subset=["doc_id", *columns])
        .groupBy("doc_id")
        .agg(*[F.max(c).alias(c) for c in columns])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), texts["_id"] == chosen["doc_id"]).select("text", "doc_id", *columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return found.withColumn("_place", first).filter("_place = 1").drop("_place")
