"""The corpus pipeline: five stages, applied to the documents one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import pipeline_stages as stages
from quillgraph.llm.queries import shipped
from quillgraph.llm.scratch import Scratch, table

STAGES = [
    ("language", shipped(stages.language_stage)),
    ("simhash", shipped(stages.simhash_stage)),
    ("passages", shipped(stages.passage_stage)),
    ("benchmark", shipped(stages.benchmark_stage)),
    ("mixing", shipped(stages.mixing_stage)),
]
#: SQL can express none of the stages but by their brute-force versions, which the tests use.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, each stage written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
