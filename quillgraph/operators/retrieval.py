"""Retrieval: exact cosine search over an embedding table and detail look-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import relation_phrase
from quillgraph.functions.vectors import cosine, dot, hashed_embedding, norm


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.where(F.size(vector) > 0)


def top_k(df: DataFrame, query: list[float], k: int = 5, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows most like one vector; ties by id. Rows without a direction never match."""
    scored = usable(df, vector).withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.where("similarity is not null").orderBy(F.desc("similarity"), id_col).limit(k)


def top_k_many(df: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", id_col: str = "vec_id", query_id: str = "query_id", at_once: int = 2000) -> DataFrame:
    """``(query_id, vec_id, similarity, rank)`` for each row of ``queries`` (query_id, embedding).

    Every task scores its rows against the queries and keeps the best k for each
    before anything is shuffled. Up to ``at_once`` queries are broadcast; more are
    taken in that many to a pass.
    """
    n = queries.count()
    parts = max(1, -(-n // at_once))
    out = None
    for part in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        # Norms are taken once a vector, not once a pair.
        rows = usable(df, vector).select(id_col, vector, norm(F.col(vector)).alias("__norm"))
        asked = some.select(query_id, F.col(vector).alias("__query"), norm(F.col(vector)).alias("__query_norm"))
        pairs = rows.crossJoin(F.broadcast(asked)).where(F.size(vector) == F.size("__query"))
        similarity = F.try_divide(dot(F.col(vector), F.col("__query")), F.col("__norm") * F.col("__query_norm"))
        scored = pairs.select(query_id, id_col, similarity.alias("similarity")).where("similarity is not null")
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("similarity"), id_col))).where(F.col("rank") <= k)
        out = ranked if out is None else out.union(ranked)
    return out


def embedded(df: DataFrame, text: Column, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Rows with text and embedding; ``embed`` may be a pandas UDF around any model."""
    return df.select(text.alias("text"), embed(text).alias("embedding"))


def concept_texts(concepts: DataFrame) -> Column:
    return F.col("name")


def relation_texts(relations: DataFrame) -> Column:
    return relation_phrase(F.col("source_name"), F.col("type"), F.col("target_name"))


def first_details(df: DataFrame, key: Column, order: str) -> DataFrame:
    """``(text, data)``: the first row for each key."""
    return df.select(key.alias("text"), F.struct(*df.columns).alias("data"), F.col(order).alias("__o")).groupBy("text").agg(F.min_by("data", "__o").alias("data"))


def with_details(hits: DataFrame, details: DataFrame) -> DataFrame:
    """Hits keep their rows where no detail is known."""
    return hits.join(details, "text", "left")


def answer(hits: DataFrame, kind: str) -> DataFrame:
    """One text: a line for each hit with its similarity, or that nothing was found."""
    line = F.format_string("%s (similarity: %.4f)", F.col("text"), F.col("similarity"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")
    return hits.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"{kind}:\n"), lines)).otherwise(F.lit(f"{kind}: not found")).alias("answer"))
