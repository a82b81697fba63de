"""Labelled sequences: reading, vocabularies, encoding, splits and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch

PAD, UNK = "[PAD]", "[UNK]"


def sentence_ids(lines: DataFrame, partition: list[str], order: str, blank: Column, name: str = "sent_id") -> DataFrame:
    """Numbers sentences that blank lines end."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(F.when(blank, 1).otherwise(0)).over(w))


def conll_sentences(lines: DataFrame, exact_fields: bool = False) -> DataFrame:
    """``(file, sent_id, tokens, labels)`` of ``(file, line_no, line)``.

    A line's first field is the token and its last the label; lines of one field
    are skipped, and with ``exact_fields`` all but those of two.
    """
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = sentence_ids(lines.withColumn("line", line), ["file"], "line_no", F.col("line") == "")
    parts = F.split("line", r"(?U)\s+")
    fits = F.size(parts) == 2 if exact_fields else F.size(parts) >= 2
    rows = rows.where((F.col("line") != "") & fits).select("file", "sent_id", "line_no", F.element_at(parts, 1).alias("token"), F.element_at(parts, -1).alias("label"))
    sorted_ = F.sort_array(F.collect_list(F.struct("line_no", "token", "label")))
    return rows.groupBy("file", "sent_id").agg(sorted_.alias("rows")).select("file", "sent_id", F.col("rows.token").alias("tokens"), F.col("rows.label").alias("labels"))


def conll_lines(sentences: DataFrame) -> DataFrame:
    """Text of each sentence in two fields, up to the shorter of tokens and labels."""
    from quillgraph.functions.labels import zipped

    line = F.transform(zipped(F.col("tokens"), F.col("labels")), lambda x: F.concat(x["token"], F.lit(" "), x["label"]))
    return sentences.withColumn("value", F.concat(F.array_join(line, "\n"), F.lit("\n")))


def same_length(df: DataFrame, text: str = "text", labels: str = "labels") -> DataFrame:
    return df.where(F.length(text) == F.size(labels))


def frequencies(tokens: DataFrame) -> DataFrame:
    """``(token, freq, first_pos)`` of rows ``(pos, token)``; positions order all rows."""
    return tokens.groupBy("token").agg(F.count("*").alias("freq"), F.min("pos").alias("first_pos"))


def vocabulary(freqs: DataFrame, min_freq: int = 1) -> DataFrame:
    """Dense ids from 2 by first appearance for tokens frequent enough; 0 pads, 1 is unknown.

    Ids are found by sorting ranges and adding the sizes of the ranges before, not
    in one task.
    """
    kept = freqs.where((F.col("freq") >= min_freq) & ~F.col("token").isin(PAD, UNK))
    return dense_rank_ids(kept, ["first_pos", "token"], 2).select("token", "freq", "id")


def label_ids(labels: DataFrame) -> DataFrame:
    """Ids of labels ``(pos, label)`` by first appearance; O is 0."""
    first = labels.groupBy("label").agg(F.min("pos").alias("first_pos")).where("label <> 'O'")
    ids = dense_rank_ids(first, ["first_pos", "label"], 1).select("label", "id")
    return ids.unionByName(labels.sparkSession.createDataFrame([("O", 0)], "label string, id long"))


def dense_rank_ids(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """Adds ``id``: rows numbered from ``start`` in a total order, range by range.

    The sorted ranges are written once, each row with its range and its place in it.
    Sizes and numbers are both read from that table: planned twice, the ranges would
    be sampled and merged twice, and differently. Equal rows get neighbouring ids.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": place})
    ranged = Scratch(df.sparkSession, "ranks").keep(sorted_, "ranges")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    # One row for each range, whatever the rows.
    numbered = ranged.join(F.broadcast(offsets), "__p", "left")
    return numbered.withColumn("id", F.coalesce("__before", F.lit(0)) + F.col("__i") + start).drop("__p", "__i", "__before")


def encoded(sentences: DataFrame, vocab: DataFrame, tokens: str = "tokens", unknown: int = 1) -> DataFrame:
    """Adds ``ids``: each token's id, or the unknown's, in order. Rows need a ``sent_id``."""
    flat = sentences.select("sent_id", F.posexplode(tokens).alias("pos", "token")).join(vocab.select("token", "id"), "token", "left")
    ids = flat.groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).cast("int").alias("id")))), lambda x: x["id"]).alias("ids"))
    return sentences.join(ids, "sent_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def batches(df: DataFrame, row_no: str, size: int = 32, ids: str = "ids") -> DataFrame:
    """Adds batch, ids padded to the batch's longest, and the attention mask."""
    from quillgraph.functions.labels import attention_mask, padded

    rows = df.withColumn("batch", F.floor(F.col(row_no) / size))
    rows = rows.withColumn("__m", F.max(F.size(ids)).over(W.partitionBy("batch")))
    return rows.withColumns({"padded": padded(F.col(ids), F.col("__m")), "mask": attention_mask(F.col(ids), F.col("__m"))}).drop("__m")


def shuffled_split(df: DataFrame, id_col: str, ratio: float = 0.1, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Adds ``is_val``: the first ``int(n * ratio)`` rows by ``order``, by default a hash of id and seed.

    Only ids are sorted; ids must be unique. Other columns, an ``id`` too, stay.
    """
    n = int(df.count() * ratio)
    drawn = F.xxhash64(F.lit(seed), F.col(id_col)) if order is None else order
    ranked = dense_rank_ids(df.select(F.col(id_col).alias("__key"), drawn.alias("__h")), ["__h", "__key"], 0)
    return df.join(ranked.select(F.col("__key").alias(id_col), (F.col("id") < n).alias("is_val")), id_col, "left")


def shuffled_batches(df: DataFrame, id_col: str, size: int = 32, epoch: int = 0, seed: int = 42, ids: str = "ids", order: Column | None = None) -> DataFrame:
    """Batches in an order drawn anew for each epoch, by default by a hash; the same epoch and seed give the same batches."""
    drawn = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col)) if order is None else order
    ranked = dense_rank_ids(df.select(F.col(id_col).alias("__key"), drawn.alias("__h")), ["__h", "__key"], 0)
    rows = df.join(ranked.select(F.col("__key").alias(id_col), F.col("id").alias("__at")), id_col)
    return batches(rows, "__at", size, ids).drop("__at")


def weighted_scores(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", outside: str = "O") -> DataFrame:
    """Support-weighted precision, recall and F1 over labels other than ``outside``; 0 where undefined."""
    ends = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("support"), F.lit(0).alias("pred")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("support"), F.lit(1).alias("pred")))).alias("e"), (F.col(gold) == F.col(predicted)).alias("hit"))
    per = ends.where(F.col("e.label") != outside).groupBy("e.label").agg(F.sum("e.support").alias("support"), F.sum("e.pred").alias("pred"), F.sum(F.when(F.col("hit"), F.col("e.support")).otherwise(0)).alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide("tp", "pred")), zero(F.try_divide("tp", "support"))
    per = per.select("support", p.alias("p"), r.alias("r"), zero(F.try_divide(2 * p * r, p + r)).alias("f"))
    mean = lambda c: zero(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")))
    return per.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))
