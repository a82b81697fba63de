"""The stages of the corpus pipeline, as functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, langid, mixing, passages, simhash_dedup
from quillgraph.llm.scratch import Scratch, table
from quillgraph.llm.toxicity import labelled_sample

#: Below this cosine with every language a text is in none.
LEAST_COSINE = 0.05
MIX_SAMPLE = 1000
TARGETS = {"clean": 0.9, "junk": 0.07, "toxic": 0.03}


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, else clean or junk by quality; unlabelled rows are none."""
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", named.alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, carry: list[str]) -> tuple[DataFrame, mixing.Domains, list[float]]:
    """``carry`` with n_tokens, posteriors, rate and copies; the model; the fitted shares."""
    named = domains(labels).where("domain is not null")
    shares = {r[0]: r[1] for r in named.where(langid.fold() != 1).groupBy("domain").count().collect()} or {"clean": 1}
    scratch = Scratch(docs.sparkSession, "domains")
    model = mixing.train(scratch.keep(labelled_sample(docs, named, "domain", most=MIX_SAMPLE), "sample"), shares)
    kept = docs.select("text", *[F.col(f"`{c}`") for c in carry if c.lower() != "text"])
    known = scratch.keep(mixing.with_posteriors(kept, model).select(*[F.col(f"`{c}`") for c in carry if c.lower() not in mixing.MADE], *mixing.MADE), "posteriors")
    rate, found = mixing.fit_rates(known, model, TARGETS)
    return mixing.with_rates(known, rate), model, found


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; the others (no text, no letters, no likeness) go.

    Where no document has a language to learn from, all texts with letters stay.
    """
    learn = docs.where((langid.fold() != 1) & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    model = langid.train(learn)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.prediction(model, F.col("text"))
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_COSINE))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.keep_one_per_group(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in several places."""
    return passages.cut_passages(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with tokens, posteriors, the fitted rate and the copies a reader takes."""
    return mixed(docs, table(spark, sf_dir, "labels"), docs.columns)[0]
