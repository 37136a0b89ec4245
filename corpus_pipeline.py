"""A training corpus from raw documents: quality, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import ngram_join, packing, pii, quality
from terraloom.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees.

    The trees are fitted on labelled documents among `docs`. Rows go by their own verdict:
    of rows that share an id, or have none, each stays or goes with its text."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, trees).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar 5-word shingle sets: that of smallest id.

    Rows are told apart by id and text: another text under a used id goes only if it is in
    the group itself. Of repeated rows one stays; rows without an id are members like
    others, and one of them stays where no member has an id. Rows without words, a null
    text among them, are in no group and stay. An empty table gives none."""
    rows = written(ngram_join.representatives(docs, words=5, num=80, den=100))
    named = docs.select(*COLUMNS, *ngram_join.row_names(F.col("doc_id"), F.col("text")))
    names = ["_key", "_hash"]
    again = rows.filter("stays AND copies > 1").select(*names)
    gone = rows.filter("NOT stays").select(*names)
    if again.isEmpty():
        return named.join(gone, names, "left_anti").select(*COLUMNS)
    once = named.join(again, names, "left_semi").dropDuplicates(names)
    return named.join(gone.union(again), names, "left_anti").select(*COLUMNS).union(once.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return pii.redact(pii.detect(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", reject_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_windows),
]

#: Boosted trees and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
