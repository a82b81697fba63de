"""Whole flows as single lazy plans: notes to triples, questions to answers, chunks to replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import clean_markdown, prompt
from quillgraph.operators import chunking, notes, retrieval, triples
from quillgraph.sources import readers


def notes_to_triples(spark: SparkSession, path: str, iri: str, indent_mode: str = "dash") -> DataFrame:
    """Note files to OWL triples without a stop on disk."""
    concepts, relations = notes.parse_notes(readers.text_lines(spark, path), indent_mode)
    rows = concepts.select(F.xxhash64("file").alias("f"), "position", "id", "name", "type", "parent", F.transform_keys("props", lambda k, _: F.concat(k, F.lit(":LABEL"))).alias("props"))
    rows = rows.withColumn("row_no", F.struct("f", "position")).drop("f", "position")
    return triples.owl_triples(rows, relations, iri)


def chunk_replies(docs: DataFrame, template: str, complete: Callable[[str], str], max_length: int = 4096) -> DataFrame:
    """``(file, chunk_no, reply)``: documents cleaned, cut, put into prompts and completed.

    ``complete`` is called once for each chunk in the tasks; a task that is run
    again calls it again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["file"], "chunk_no": b["chunk_no"], "reply": b["prompt"].map(complete)})

    chunks = chunking.with_structural_chunks(docs.select("file", clean_markdown(F.col("text")).alias("text")), max_length=max_length)
    return chunks.select("file", "chunk_no", prompt(template, F.col("chunk")).alias("prompt")).mapInPandas(run, "file string, chunk_no int, reply string")


def retrieve(concepts: DataFrame, relations: DataFrame, query: list[float], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Concept and relation hits with their first details; both tables have text, embedding, row_no and their own columns."""
    out = []
    for df in (concepts, relations):
        hits = retrieval.top_k(df, query, k, id_col="row_no").select("text", "similarity", "row_no")
        out.append(retrieval.with_details(hits, retrieval.first_details(df.drop("embedding"), F.col("text"), "row_no")))
    return out[0], out[1]
