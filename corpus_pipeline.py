"""Corpus pipeline: quality classifier, near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet into the shared folder and gives the next stage what it reads back. The tables go when the session ends.

All stages take null in any column, empty and very long texts, ties, repeated rows and empty tables, which give empty
results. All but the last return the columns of documents and no others, whatever further columns they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm import bpe, classifier, mixing, queries, simhash, substring
from rowforge.llm.common import settle_table
from rowforge.session import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above; a null text is scored as an empty one."""
    network = classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return classifier.score(docs, network).where(F.col("score") >= classifier.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component; texts without words, null ones included, are one component."""
    return simhash.keep_one(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 35-word windows, else as written (null as ''); those that lose all their words go."""
    cut = substring.remove_repeats(docs, as_written=True).where("n_removed = 0 or n_removed < n_words")
    text = F.coalesce("kept", F.lit(""))
    changed = (F.col("n_removed") > 0) | F.col("kept").isNull()
    size = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("text", text).withColumn("n_chars", size).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, a document repeated as often as it is taken.

    The one document of a source that would exceed its target comes once with its first words only, as many as are wanted.
    """
    return mixing.mix(docs.select(*COLUMNS), length="n_chars").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document (little-endian unsigned 32-bit integers) beside its id and source; none for null and empty texts."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mixed),
    ("byte-level BPE", tokens),
]

#: Not expressible in SQL: the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a data folder."""
    rows = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = settle_table(stage(spark, rows, sf_dir))
    return rows
