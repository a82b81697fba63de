"""Commands over files: ``python -m quillgraph COMMAND INPUT OUTPUT [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.labels import decode_spans
from quillgraph.functions.text import clean_markdown, clean_page
from quillgraph.functions.vectors import hashed_embedding
from quillgraph.operators import chunking, notes, pages, retrieval, sequences, tagger, tagger_training, triples
from quillgraph.sources import readers, writers
from quillgraph.sources.session import ship_package


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    """Placeholders for images and formulas."""
    step = clean_page if a.pages else clean_markdown
    docs = readers.whole_texts(spark, a.input, "*.txt" if a.pages else "*.md")
    writers.to_text(docs.select(F.element_at(F.split("file", "/"), -1).alias("file"), step(F.col("text")).alias("value")), a.output, ["file"])


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Markdown cut at blocks, other texts by length."""
    docs = readers.whole_texts(spark, a.input, "*.{md,txt}")
    writers.to_json(chunking.chunks_by_kind(docs, size=a.length), a.output)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Notes to concept and relation CSVs."""
    concepts, relations = notes.parse_notes(readers.text_lines(spark, a.input), a.indent)
    writers.to_csv(writers.wide_concepts(concepts), f"{a.output}/concepts")
    writers.to_csv(writers.wide_relations(relations), f"{a.output}/relations")
    writers.to_text(notes.dot_lines(concepts, relations).orderBy("part", "key").select(F.col("line").alias("value")), f"{a.output}/preview")


def _tables(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return readers.concept_table(spark, f"{a.input}/concepts", a.strict), readers.relation_table(spark, f"{a.input}/relations")


def owl(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.to_text(triples.rdfxml_parts(triples.owl_triples(*_tables(spark, a), a.iri)), a.output)


def ttl(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.to_text(triples.turtle_lines(triples.ttl_triples(*_tables(spark, a), a.iri, a.base)), a.output)


def jsonld(spark: SparkSession, a: argparse.Namespace) -> None:
    concepts, relations = _tables(spark, a)
    nodes = triples.merged_nodes(triples.jsonld_nodes(concepts, a.iri), triples.jsonld_relations(relations, concepts, a.iri))
    if a.merge:
        nodes = triples.merged_nodes(readers.jsonld_rows(spark, a.merge), nodes)
    writers.to_text(triples.jsonld_lines(nodes), a.output)


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    concepts, relations = _tables(spark, a)
    retrieval.embedded(concepts, retrieval.concept_texts(concepts)).write.mode("overwrite").parquet(f"{a.output}/concepts")
    retrieval.embedded(relations, retrieval.relation_texts(relations)).write.mode("overwrite").parquet(f"{a.output}/relations")


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prints the concepts and relations most like a question."""
    vector = spark.createDataFrame([(a.query,)], "t string").select(hashed_embedding(F.col("t"))).first()[0]
    for kind in ("concepts", "relations"):
        hits = retrieval.top_k(spark.read.parquet(f"{a.input}/{kind}"), vector, a.k, id_col="text")
        print(retrieval.answer(hits, kind.capitalize()).first()[0])


def links(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fields and links of saved pages."""
    saved = readers.whole_texts(spark, a.input, "*.html").withColumnRenamed("text", "html")
    writers.to_json(pages.with_fields(pages.without_challenges(saved)).drop("html"), a.output)


def conll(spark: SparkSession, a: argparse.Namespace) -> None:
    """Two-column label files to JSON."""
    rows = sequences.conll_sentences(readers.text_lines(spark, a.input, "*.txt"), exact_fields=True)
    writers.to_json(rows.select(F.array_join("tokens", "").alias("text"), "labels"), a.output)


def learn(spark: SparkSession, a: argparse.Namespace) -> None:
    """A tagger from two-column label files; prints each epoch's loss and scores."""
    rows = sequences.conll_sentences(readers.text_lines(spark, a.input, "*.txt")).withColumn("sent_id", F.xxhash64("file", "sent_id"))
    flat = rows.select("sent_id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("at", "x")).select(F.struct("sent_id", "at").alias("pos"), F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"))
    vocab = sequences.vocabulary(sequences.frequencies(flat.select("pos", "token"))).select("token", "id")
    vocab.write.mode("overwrite").parquet(f"{a.output}/vocabulary")
    vocab = spark.read.parquet(f"{a.output}/vocabulary")
    labels = sequences.label_ids(flat.select("pos", "label"))
    names = [r["label"] for r in labels.orderBy("id").collect()]
    numbered = sequences.encoded(rows, labels.withColumnRenamed("label", "token"), "labels", 0).withColumnRenamed("ids", "label_ids")
    split = sequences.shuffled_split(sequences.encoded(numbered, vocab), "sent_id", 0.1)
    start = tagger_training.fresh(vocab.count() + 2, len(names), a.width, 2 * a.width, 2)
    model, history = tagger_training.train(split, start, names, a.epochs, a.batch, a.rate, a.tasks)
    for n, e in enumerate(history, 1):
        print(f"{n}: loss {e.loss:.4f}, precision {e.precision:.4f}, recall {e.recall:.4f}, F1 {e.f1:.4f}")
    tagger.save(spark, model, names, f"{a.output}/tagger")


def tag(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entities of each line of text files, by a tagger that learn has saved."""
    model, names = tagger.load(spark, f"{a.model}/tagger")
    lines = readers.text_lines(spark, a.input, "*.txt").where("line <> ''").withColumn("sent_id", F.xxhash64("file", "line_no"))
    rows = lines.withColumn("tokens", F.filter(F.split("line", ""), lambda c: c != ""))
    found = tagger.tagged(sequences.encoded(rows, spark.read.parquet(f"{a.model}/vocabulary")), model, names)
    writers.to_json(found.select("file", "line_no", "line", "labels", decode_spans(F.col("tokens"), F.col("labels")).alias("entities")), a.output)


COMMANDS = {f.__name__: f for f in (clean, chunk, parse, owl, ttl, jsonld, embed, ask, links, conll, learn, tag)}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--indent", choices=("dash", "space"), default="dash")
    p.add_argument("--strict", action="store_true", help="read types from the column type:LABLE only")
    p.add_argument("--iri", default="http://www.example.org/ontology#")
    p.add_argument("--base", default="http://www.example.org/data/")
    p.add_argument("--merge", help="JSON-LD to merge into")
    p.add_argument("--query", "-q", default="")
    p.add_argument("-k", type=int, default=3)
    p.add_argument("--length", type=int, default=4096)
    p.add_argument("--epochs", type=int, default=10)
    p.add_argument("--batch", type=int, default=32)
    p.add_argument("--tasks", type=int, default=8, help="that train side by side")
    p.add_argument("--rate", type=float, default=0.001)
    p.add_argument("--width", type=int, default=128, help="of the tagger's word vectors; its layers have twice as much")
    p.add_argument("--model", help="folder that learn has written")
    p.add_argument("--pages", action="store_true", help="extracted page texts instead of Markdown")
    a = p.parse_args(args)
    if a.output is None and a.command != "ask":
        p.error("an output folder is needed")
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    ship_package(spark)
    COMMANDS[a.command](spark, a)


if __name__ == "__main__":
    main()
