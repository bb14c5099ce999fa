"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents; each result is written as Parquet and read again as the next one's docs.

Odd rows: a null or empty text is scored as one empty line, loses no lines, is nobody's copy, holds
no item and gives no words. Rows of a null id are judged by their text alone and lose no lines; near
copies among them stay. Repeated rows of one id are scored and searched each; near_dedup treats
them as one document, and the mix as several. Of equal texts, that of the smallest id stays. Texts
are read whole, however long. An empty table stays empty; other columns, whatever their names, are
passed on. Labels of one kind only leave every document in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, lines, mixing, neardup, quality
from tessella.session import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks they share with earlier ones. A document of which nothing is
    left goes; n_chars follows the text."""
    return lines.dedup_lines(docs, drop_emptied=True, chars_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies, by the parameters of the
    operator's query: shingles of two words, a similarity of 0.8."""
    gone = neardup.link_near_duplicates(docs, size=2).filter(~F.col("kept")).select(F.col("doc_id").alias("_tessella_id"))
    return docs.join(gone, docs["doc_id"] == gone["_tessella_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the documents that the mix takes."""
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]
#: The line model, patience diff and the MinHash links have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
