"""What several operators share: the shared folder's tables, and the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources.scratch import Scratch, scratch_root

__all__ = ["Scratch", "scratch_root", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
