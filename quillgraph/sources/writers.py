"""Sinks: tables, triples, graphs and reports through Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.labels import palette, type_runs


def property_keys(df: DataFrame) -> list[str]:
    """All keys of ``props``, ascending. They become columns, so a table's keys must be few enough for that."""
    return [r[0] for r in df.select(F.explode(F.map_keys("props")).alias("k")).distinct().orderBy("k").collect()]


def wide_concepts(concepts: DataFrame) -> DataFrame:
    """A column for each property; rows that come from notes keep their order, which later readers go by."""
    keys = property_keys(concepts)
    concepts = concepts.orderBy("file", "position") if {"file", "position"} <= set(concepts.columns) else concepts
    core = [F.col("id").alias(":ID"), F.col("name"), F.col("type"), F.coalesce("parent", F.lit("")).alias("parent")]
    return concepts.select(*core, *[F.col("props")[k].alias(f"{k}:LABEL") for k in keys])


def wide_relations(relations: DataFrame) -> DataFrame:
    keys = property_keys(relations)
    core = [F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.coalesce("type", F.lit("RELATED")).alias(":TYPE"), F.col("source_name").alias("_o_source_"), F.col("target_name").alias("_o_target_")]
    return relations.select(*core, *[F.col("props")[k].alias(f"{k}:LABEL") for k in keys])


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, emptyValue="")


def to_text(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Rows of ``value``; with ``partition`` a folder for each of its values."""
    (df.write.mode("overwrite").partitionBy(*partition) if partition else df.write.mode("overwrite")).text(path)


def append_text(df: DataFrame, path: str) -> None:
    df.write.mode("append").text(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def embeddings_to_csv(df: DataFrame, path: str) -> None:
    to_csv(df.withColumn("embedding", F.to_json("embedding")), path)


def graph_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Nested rows: each vertex with its children and parents as (name, index)."""
    kids = edges.groupBy(F.col("src_idx").alias("idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("text").alias("name"), F.col("dst_idx").alias("index")))), lambda x: F.struct(x["name"].alias("name"), x["index"].alias("index"))).alias("children"))
    up = edges.join(vertices.select(F.col("idx").alias("src_idx"), F.col("name").alias("parent_name")), "src_idx").groupBy(F.col("dst_idx").alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("parent_name").alias("name"), F.col("src_idx").alias("index")))).alias("parents"))
    none = F.array().cast("array<struct<name:string,index:bigint>>")
    return vertices.join(kids, "idx", "left").join(up, "idx", "left").withColumns({"children": F.coalesce("children", none), "parents": F.coalesce("parents", none)})


def replies(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """One text for each file from its chunks' replies, in order, with blank lines between."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*by).agg(F.array_join(parts, "\n\n").alias("value"))


def entity_report(sentences: DataFrame, types: list[str]) -> DataFrame:
    """HTML of each sentence with highlighted entities and a table of them; ``sentences`` has tokens, labels, entities."""
    colours = palette(types)
    colour = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), t), F.lit("#cccccc")) if colours else F.lit("#cccccc")
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    marked = F.array_join(F.transform(type_runs(F.col("tokens"), F.col("labels")), lambda r: F.concat(F.lit('<mark style="background:'), colour(r["type"]), F.lit('">'), safe(r["text"]), F.lit("</mark>"))), " ")
    rows = F.array_join(F.transform("entities", lambda e: F.concat(F.lit("<tr><td>"), safe(e["entity"]), F.lit("</td><td>"), safe(e["type"]), F.lit("</td></tr>"))), "")
    return sentences.select(F.concat(F.lit("<section><p>"), safe(F.array_join("tokens", "")), F.lit("</p><p>"), marked, F.lit("</p><table>"), rows, F.lit("</table></section>")).alias("value"))


def layout(n: Column) -> Column:
    """Plot sizes for a graph of n vertices."""
    size = F.greatest(F.lit(12.0), n / 5)
    return F.struct(size.alias("figure"), F.greatest(F.lit(500.0), 3000 / (1 + n / 20)).alias("node"), F.greatest(F.lit(5.0), 10 / (1 + n / 50)).alias("font"), (F.lit(0.5) / F.sqrt(1 + n / 100)).alias("k"), (50 + F.floor(n / 10)).alias("iterations"))
