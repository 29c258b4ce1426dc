"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The low 62 bits of a packed file number hold the number, the top two the path id.
FILE_NUMBER_MASK = (1 << 62) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_number(packed):
    """The file number inside a packed number and path id; null stays null."""
    return F.col(packed).bitwiseAND(F.lit(FILE_NUMBER_MASK)) if isinstance(packed, str) else packed.bitwiseAND(F.lit(FILE_NUMBER_MASK))
