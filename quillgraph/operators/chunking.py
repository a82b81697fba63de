"""Chunks of text, batches within a token budget, and capped histories."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import fixed_chunks

#: Fixed value: the block grammar, which decides where text may be cut.
BLOCKS = re.compile(
    r"(\n\#{1,6}\s+.*?)(?=\n\#|$)|(\n\*{3,})|(\n```.*?\n```)|(\n\|.*?\|)|(\n[-*+].*?(?:\n[ \t]+.*?)*)|(\n\d+\..*?(?:\n[ \t]+.*?)*)|(\n[ \t]+[-*+].*?)|(\n\n+)",
    re.DOTALL,
)


def structural_chunks(text: str | None, max_length: int = 4096, tolerance: int = 200) -> list[str]:
    """Pieces of a text, cut at blocks; joined again they are the text.

    A piece over ``max_length + tolerance`` UTF-8 bytes is cut at the last
    suitable block start among its last ``max_length + tolerance`` characters.
    Blank runs weigh 1 and other blocks 0; the lightest is cut at, of equally
    light ones the last. After a blank run only blank runs are suitable. A cut
    that leaves more than ``max_length`` characters behind it is not made.
    """
    if not text:
        return []
    chunks, done, after_blank = [], 0, None
    for block in BLOCKS.finditer(text):
        end = block.end()
        if len(text[done:end].encode("utf-8", "surrogatepass")) > max_length + tolerance:
            window = list(BLOCKS.finditer(text, max(done, end - max_length - tolerance), end))
            suitable = [m for m in window if not after_blank or m.group().startswith("\n\n")]
            lightest = [m for m in suitable if not m.group().startswith("\n\n")] or suitable
            cut = lightest[-1].start() if lightest else end
            if end - cut > max_length:
                cut = end
            if cut > done:
                chunks.append(text[done:cut])
                done = cut
        after_blank = block.group().startswith("\n\n")
    if done < len(text):
        chunks.append(text[done:])
    return chunks


def with_structural_chunks(docs: DataFrame, text_col: str = "text", max_length: int = 4096, tolerance: int = 200) -> DataFrame:
    """One row for each chunk: all columns but the text, ``chunk_no`` and ``chunk``."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: structural_chunks(t, max_length, tolerance))

    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(cut(F.col(text_col))).alias("chunk_no", "chunk"))


def chunks_by_kind(docs: DataFrame, file_col: str = "file", text_col: str = "text", size: int = 4096, tolerance: int = 200) -> DataFrame:
    """Chunks of Markdown files (``.md``) at blocks, of all others by ``size`` characters."""
    markdown = F.endswith(F.col(file_col), F.lit(".md"))
    rest = [c for c in docs.columns if c != text_col]
    slices = docs.where(~markdown).select(*rest, F.posexplode(fixed_chunks(F.col(text_col), size)).alias("chunk_no", "chunk"))
    return with_structural_chunks(docs.where(markdown), text_col, size, tolerance).unionByName(slices)


def budget_batches(items: DataFrame, index: str = "idx", length: str = "len", size: int = 16, tokens: int = 4096) -> DataFrame:
    """Items with their ``batch`` and whether they are ``kept`` within the token budget.

    A batch is ``size`` items in order. While its JSON text is over the budget
    (two characters to a token) its longest item goes, the first of equally long
    ones; so what stays is the shortest items whose running length fits.
    """
    batch = F.floor(F.col(index) / size)
    rows = items.withColumn("batch", batch)
    w = W.partitionBy("batch").orderBy(F.floor(F.col(length) / 2), F.desc(index)).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(length).over(w) + 2 * F.count("*").over(w)
    return rows.withColumn("kept", total <= 2 * tokens + 1)


def capped_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", keep: int = 5) -> DataFrame:
    """The messages in memory at each turn: the first, and the last ``keep - 1`` once there are more."""
    w = W.partitionBy(conv).orderBy(turn)
    recent = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w.rowsBetween(1 - keep, 0))
    first = F.first(F.struct("role", F.col("text").alias("content"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    n = F.row_number().over(w)
    history = F.when(n > keep, F.concat(F.array(first), F.slice(recent, 2, keep - 1))).otherwise(recent)
    return turns.withColumn("history", history)
