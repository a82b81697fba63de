"""Readers: texts, notes, tables, labelled sequences, JSON and page files as lazy DataFrames.

All go through Spark's own readers, so paths may lie in any store Spark knows.
Folders are read as one table; files without rows and folders without files give
empty tables where a schema is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillgraph.functions.vectors import parsed

CONCEPT_CORE = (":ID", "name", "type", "parent")
RELATION_CORE = (":START_ID", ":END_ID", ":TYPE", "_o_source_", "_o_target_")


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """``(file, text)``, a row for each file."""
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``(file, line_no, line)`` with lines numbered from 0; a last line break opens no line."""
    lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")
    return whole_texts(spark, path, glob).select("file", F.posexplode(lines).alias("line_no", "line"))


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file, content)``; a parser as a pandas UDF makes texts of it, null for files it can't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")


def page_texts(files: DataFrame, parse: Column) -> DataFrame:
    """Pages of parsed files: ``parse`` gives an array of page texts. Unreadable files are left out; pages join by newlines."""
    rows = files.withColumn("pages", parse).where("pages is not null")
    return rows.select("file", F.array_join("pages", "\n").alias("text"))


def headed_csv(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """A CSV with header, all strings, null for empty fields; quotes double and lines may break inside them."""
    return spark.read.option("pathGlobFilter", glob).csv(path, header=True, multiLine=True, escape='"', nullValue="")


def row_number() -> Column:
    """Orders rows as they stand: by file, and inside it (such files are not split)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))


def _props(df: DataFrame, core: tuple[str, ...]) -> Column:
    rest = [c for c in df.columns if c not in core]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in rest]) if rest else F.array().cast("array<struct<k:string,v:string>>")
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def concept_table(spark: SparkSession, path: str | list[str], strict_headers: bool = False) -> DataFrame:
    """``(row_no, id, name, type, parent, props)`` of concept CSVs; props keep their headers as keys.

    The type stands in ``type`` or ``type:LABLE``; ``strict_headers`` takes only the latter.
    """
    df = headed_csv(spark, path)
    typed = [c for c in ("type:LABLE", *([] if strict_headers else ["type"])) if c in df.columns]
    core = (":ID", "name", "parent", *typed)
    type_ = F.coalesce(*[F.col(f"`{c}`") for c in typed]) if typed else F.lit(None).cast("string")
    parent = F.col("parent") if "parent" in df.columns else F.lit(None).cast("string")
    return df.select(row_number().alias("row_no"), F.col("`:ID`").alias("id"), "name", type_.alias("type"), parent.alias("parent"), _props(df, core).alias("props"))


def relation_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(row_no, source, target, type, source_name, target_name, props)`` of relation CSVs; the type in ``:TYPE`` or ``type``."""
    df = headed_csv(spark, path)
    types = [c for c in (":TYPE", "type") if c in df.columns]
    name = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    core = (*RELATION_CORE, *types)
    return df.select(row_number().alias("row_no"), F.col("`:START_ID`").alias("source"), F.col("`:END_ID`").alias("target"), F.coalesce(*[F.col(f"`{c}`") for c in types]).alias("type"), name("_o_source_").alias("source_name"), name("_o_target_").alias("target_name"), _props(df, core).alias("props"))


def property_label(header: Column) -> Column:
    """A property's name without its ``:LABEL`` ending."""
    return F.regexp_replace(header, ":LABEL$", "")


def data_csv(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], glob: str = "*.csv") -> DataFrame:
    """A headed CSV that may be missing: a missing path, or a folder without such files, gives no rows of ``columns``."""
    try:
        df = headed_csv(spark, path, glob)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        df = None
    if df is None or not df.columns:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return df


def retrieval_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four kinds of files of a folder, each as one table: embeddings as ``(text, embedding)``, data as they are."""
    return {
        "concept_embeddings": embedding_csv(spark, folder, "concept_name", "*_concepts_embeddings.csv"),
        "relation_embeddings": embedding_csv(spark, folder, "relation_phrase", "*_relations_embeddings.csv"),
        "concepts": data_csv(spark, folder, CONCEPT_CORE, "*_concepts.csv"),
        "relations": data_csv(spark, folder, RELATION_CORE, "*_relations.csv"),
    }


def embedding_csv(spark: SparkSession, path: str | list[str], text_col: str, glob: str = "*.csv") -> DataFrame:
    """``(text, embedding)`` of CSVs with list literals; other rows are left out, a missing path gives no rows."""
    df = data_csv(spark, path, (text_col, "embedding"), glob)
    if not {text_col, "embedding"} <= set(df.columns):
        return spark.createDataFrame([], "text string, embedding array<double>")
    return df.select(F.col(text_col).alias("text"), parsed(F.col("embedding")).alias("embedding")).where("embedding is not null")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_pairs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files ``X_concepts.csv`` and ``X_relations.csv`` by X, and those without a partner. ``files`` has file."""
    named = files.select("file", F.regexp_extract("file", r"^(.*)_(concepts|relations)\.csv$", 1).alias("x"), F.regexp_extract("file", r"^(.*)_(concepts|relations)\.csv$", 2).alias("kind")).where("kind <> ''")
    side = lambda k: named.where(F.col("kind") == k).select("x", F.col("file").alias(k))
    pairs = side("concepts").join(side("relations"), "x")
    return pairs, named.join(pairs, "x", "left_anti").select("file")


def new_files(files: DataFrame, done: DataFrame, pattern: str) -> DataFrame:
    """Files whose names match from the start and that are not done yet."""
    return files.where(F.col("file").rlike(f"^(?:{pattern})")).join(done.select("file"), "file", "left_anti")


def json_rows(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def labelled_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(text, labels)``."""
    return json_rows(spark, path, "text string, labels array<string>")


def entity_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_rows(spark, path, "text string, entities array<struct<entity:string,type:string>>")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (idx, name, url) and edges (src, dst, pos, text) of a saved web graph, which is one array."""
    node = "struct<name:string,URL:string,children:array<struct<name:string,index:long>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{node}>").alias("g"))
    rows = whole.select(F.posexplode("g").alias("idx", "n"))
    vertices = rows.select("idx", "n.name", F.col("n.URL").alias("url"))
    edges = rows.select(F.col("idx").alias("src"), F.posexplode("n.children").alias("pos", "c")).select("src", F.col("c.index").alias("dst"), "pos", F.col("c.name").alias("text"))
    return vertices, edges.join(vertices.select(F.col("idx").alias("dst")), "dst", "left_semi")


def jsonld_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(id, key, values)`` of a saved JSON-LD array."""
    whole = spark.read.text(path, wholetext=True)
    nodes = whole.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("n"))
    members = nodes.select(F.col("n")["@id"].alias("id"), F.explode("n").alias("key", "v")).where("key <> '@id'")
    items = F.coalesce(F.from_json("v", "array<string>"), F.array("v"))
    ref = lambda x: F.get_json_object(x, "$.@id")
    return members.select("id", "key", F.transform(items, lambda x: F.struct(F.coalesce(F.when(F.startswith(x, F.lit("{")), ref(x)), x).alias("value"), F.startswith(x, F.lit("{")).alias("is_ref"))).alias("values"))
