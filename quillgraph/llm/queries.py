"""The operators bound to the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import chat, decontamination, html_template, langid, media, passages, pipeline_stages, simhash_dedup, toxicity, urls
from quillgraph.llm.scratch import Scratch, table
from quillgraph.sources.session import bound_batches, ship_package


def shipped(f: Callable) -> Callable:
    """f(spark, ...) after executors have been given this package, with bounded batches."""

    @wraps(f)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return f(spark, *args)

    return run


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the components of those two or fewer bits apart."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules of the query's contract.
RULES = [urls.Rule("net/", True), urls.Rule("example.net/en/", False), urls.Rule("example.com/de/", True), urls.Rule("org/fr/", False)]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All urls judged: by rule where one fits, else by trees learned from the urls that rules decide."""
    rows = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, from the prototypes of the documents outside fold 1. A null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    learn = docs.where((langid.fold() != 1) & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    rows = langid.predict(docs, langid.train(learn), ["doc_id"])
    return rows.select("doc_id", F.coalesce(langid.fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens, posteriors over the labelled domains, rate and copies."""
    rows, model, _ = pipeline_stages.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return rows.select("doc_id", "n_tokens", *[F.col("posteriors")[i].alias(f"p_{n}") for i, n in enumerate(model.names)], "rate", "copies")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_template.extract_main_text(table(spark, sf_dir, "pages"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through a GIF file and back."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings every document would lose."""
    return passages.removal_report(table(spark, sf_dir, "documents"))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, one row for each document and item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from the labels outside fold 1. A null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    sample = Scratch(spark, "toxicity").keep(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    rows = toxicity.scores(docs, *toxicity.train(sample))
    return rows.select("doc_id", F.coalesce(langid.fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table marks no preferences: conversation 2k is taken as chosen, 2k+1 as rejected."""
    turns = table(spark, sf_dir, "conversations")
    return chat.preference_pairs(turns.select(F.shiftright("conv_id", 1).alias("pair"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: shipped(f) for f in (op1_simhash, op2_urls, op3_language, op4_mixing, op5_html, op6_gif, op7_suffix, op8_leaks, op9_toxicity, op10_chat)}
ORACLES: dict[str, str] = {"op5_html": html_template.ARTICLE_SQL, "op10_chat": chat.PAIRS_SQL}
