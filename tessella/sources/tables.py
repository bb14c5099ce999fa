"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the dataset. Readers only: the folder may be in any store Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
