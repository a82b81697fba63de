"""Sequence labels, vocabularies and scores."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quillgraph.functions import labels
from quillgraph.operators import sequences
from quillgraph.sources.writers import entity_report


def decode(spark, tokens, tags):
    rows = spark.createDataFrame([(tokens, tags)], "t array<string>, l array<string>")
    return [tuple(e) for e in rows.select(labels.decode_spans(F.col("t"), F.col("l"))).first()[0]]


def test_decode(spark):
    assert decode(spark, list("北京大学在海淀"), ["B-ORG", "I-ORG", "I-ORG", "E-ORG", "O", "B-LOC", "E-LOC"]) == [("北京大学", "ORG"), ("海淀", "LOC")]
    assert decode(spark, list("ABC"), ["B-ORG", "I-LOC", "I-ORG"]) == [("AC", "ORG")]
    assert decode(spark, list("AB"), ["B-X", "S-Y"]) == [("A", "X"), ("B", "Y")]
    assert decode(spark, [], []) == [] and decode(spark, ["a", "b"], ["S-X"]) == [("a", "X")]


def test_labels_of_entities_and_back(spark):
    rows = spark.createDataFrame([("苹果和苹果A", [("苹果", "F"), ("A", "L")])], "text string, e array<struct<entity:string,type:string>>")
    got = rows.select(labels.labels_of_entities(F.col("text"), F.col("e")).alias("l")).first()[0]
    assert got == ["B-F", "E-F", "O", "B-F", "E-F", "S-L"]
    assert decode(spark, list("苹果和苹果A"), got) == [("苹果", "F"), ("苹果", "F"), ("A", "L")]


def test_rendering(spark):
    rows = spark.createDataFrame([(list("abc"), ["B-X", "E-X", "O"])], "t array<string>, l array<string>")
    assert rows.select(labels.tagged_text(F.col("t"), F.col("l"))).first()[0] == "[a:B-X] [b:E-X] c"
    assert [tuple(r) for r in rows.select(labels.type_runs(F.col("t"), F.col("l"))).first()[0]] == [("X", "ab")]
    report = entity_report(rows.select(F.col("t").alias("tokens"), F.col("l").alias("labels"), labels.decode_spans(F.col("t"), F.col("l")).alias("entities")), ["X"]).first()[0]
    assert "ab</mark>" in report and "<td>ab</td><td>X</td>" in report


def test_viterbi_is_the_best_path(spark):
    emissions = [[0.1, 0.9, 0.3], [0.8, 0.2, 0.4], [0.3, 0.5, 0.9], [0.7, 0.1, 0.2]]
    moves = [[0.2, -0.5, 0.3], [0.6, 0.1, -0.2], [-0.3, 0.4, 0.0]]
    score = lambda p: sum(e[j] for e, j in zip(emissions, p, strict=True)) + sum(moves[a][b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(3), repeat=4), key=score)
    rows = spark.createDataFrame([(emissions, list(best))], "e array<array<double>>, p array<int>")
    path, own = rows.select(labels.viterbi(F.col("e"), moves), labels.path_score(F.col("e"), F.col("p"), moves)).first()
    assert tuple(path) == best and abs(own - score(best)) < 1e-9


def test_conll(spark):
    text = ["张 B-PER", "三 E-PER", "", "one", "a x O", "iPhone B-P"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no int, line string")
    got = sorted((r["tokens"], r["labels"]) for r in sequences.conll_sentences(rows).collect())
    assert got == [(["a", "iPhone"], ["O", "B-P"]), (["张", "三"], ["B-PER", "E-PER"])]
    assert sequences.conll_sentences(rows, exact_fields=True).count() == 2


def test_vocabulary_and_encoding(spark):
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate("baabc")], "pos long, token string")
    vocab = sequences.vocabulary(sequences.frequencies(tokens), 2)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"b": 2, "a": 3}
    rows = spark.createDataFrame([(0, ["a", "z"]), (1, ["b"])], "sent_id long, tokens array<string>")
    out = sequences.batches(sequences.encoded(rows, vocab), "sent_id", 2)
    assert {r["sent_id"]: (r["padded"], r["mask"]) for r in out.collect()} == {0: ([3, 1], [1, 1]), 1: ([2, 0], [1, 0])}


def test_scores(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("O", "B"), ("O", "O")], "gold string, predicted string")
    p, r, f = sequences.weighted_scores(rows).first()
    assert abs(p - (1 * 2 + 1 / 3) / 3) < 1e-9 and abs(r - 2 / 3) < 1e-9 and 0 < f < 1
    assert sequences.weighted_scores(rows.where("false")).first()[0] == 0


def test_split(spark):
    rows = spark.range(100).toDF("n")
    out = sequences.shuffled_split(rows, "n")
    assert out.where("is_val").count() == 10 and out.count() == 100
