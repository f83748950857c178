"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; a single file or a directory of part files.

    Catalyst prunes columns and pushes filters into this scan, so callers select late.
    """
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each text file, read whole."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")
