"""The training-data queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import alignment, audit, decontaminate, licenses, lines, mixing, neardup, neighbours, quality, scoring, secrets, substrings, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan_licenses(_documents(spark, sf_dir)).drop("matches")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without words of windows that stand earlier."""
    return substrings.remove_repeats(_documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and weak candidates beside their complements."""
    return secrets.scan_secrets(_documents(spark, sf_dir)).drop("n_linked")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document shares with an earlier one, and what is left without them."""
    return lines.report(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    return toxicity.score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("evidence")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix_sources(_documents(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth one."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its lines."""
    return quality.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that they hold."""
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that every document belongs to."""
    return neardup.link_near_duplicates(_documents(spark, sf_dir), size=2)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers overlap in every document."""
    return alignment.align_tokenizers(_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by language."""
    return audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is by n-grams of the training documents."""
    return scoring.score_texts(_documents(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.SQL, "op2_substring_dedup": substrings.SQL, "op6_source_mixing": mixing.SQL, "op9_benchmark_decontamination": decontaminate.SQL, "op10_minhash_near_dedup": neardup.SQL, "op12_filter_audit": audit.SQL}
