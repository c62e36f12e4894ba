"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it decides takes effect on the rows it returns. All but the last return the columns of documents. Stages are written as Parquet to the shared folder and read again between one another, and what the stage before last wrote is then deleted.

Decisions are made on rows, not on identifiers: each stage numbers its rows by file and place (shared.numbered), and picks those that stay by a bitmap of these numbers (shared.picked), so rows that repeat an identifier are judged each by its own text, and texts that stay are not shuffled while the bitmap is small enough to broadcast.

Cases: null and empty texts are scored, and of several one stays; very long texts are treated whole; rows without identifier or with one that others have are treated like others, so that of equal texts one row stays, whatever their identifiers; of rows that agree in text and identifier the first by number stays; an empty table gives no rows; further columns are carried along up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from hushframe.llm.shared import forget, free, keep, numbered, picked, scratch, table

#: A document with a lower quality score goes.
REJECT = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Labels are learnt from the rows that op8 learns from; a document goes if its calibrated score is below REJECT, that is if it is more likely bad than good."""
    row = free(docs, "__row")
    rows = numbered(docs, row)
    with scratch():
        stats = keep(quality.statistics_of(rows, carry=row), "pipeline-statistics")
        model = quality.fit(stats, table(spark, sf_dir, "labels"), "quality", quality.remainder(4) != 2)
        good = quality.scored_statistics(stats, model).where(F.col("score") >= REJECT)
        return picked(rows, row, good.select(F.col("row_id").alias(row))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest identifier; of rows that also share it, the first."""
    row = free(docs, "__row")
    rows = numbered(docs, row)
    with scratch():
        kept = exact_dedup.groups(rows.select("doc_id", "text", F.col(row).alias("row_id")), carry="row_id").where("kept")
        first = kept.groupBy("text_sha256").agg(F.min("row_id").alias(row))
        return picked(rows, row, first.select(row)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first row by number: runs of five words, similarity 0.8 or more."""
    row = free(docs, "__row")
    rows = numbered(docs, row)
    with scratch():
        kept = near_dedup.near_duplicates(rows, n=5, percent=80, id_col=row, row=row).where("kept")
        return picked(rows, row, kept.select(F.col("row_id").alias(row))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document stands in it once for each pass in which its first word is taken, whole, so up to twice or not at all. Documents are shuffled by their numbers."""
    row = free(docs, "__row")
    rows = numbered(docs, row)
    with scratch():
        pieces = mixing.mix(rows, id_col=row)[1]
        taken = keep(pieces.where("start = 0").select(F.col("doc_id").alias(row), "pass").distinct(), "pipeline-passes")
        found = None
        for number in range(mixing.MOST):
            once = picked(rows, row, taken.where(F.col("pass") == number).select(row)).select(*docs.columns)
            found = once if found is None else found.unionByName(once)
    return found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand: op2's table over the mixture."""
    return packing.packed(docs)


STAGES = [("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Minhash links and trained scores are beyond SQL; tests/llm hold each stage, and run() as a whole, against plain versions of them.
ORACLE_SQL = None
