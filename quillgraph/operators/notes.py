"""Structured notes to concept and relation tables.

A line state machine as windows over (file, line): the current concept is the
last one defined by a single dash since the last section heading; it becomes the
parent of what follows and owner of the properties on later lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.ids import short_id
from quillgraph.functions.text import key_values, relation_type, without_dashes

#: The note grammar.
SECTION = "## 【核心概念】"
CONCEPT = r"(?U)^(-+)\s*(.*?)\s*@(\w+)"
RELATION = r"(?U)^-+\s*(.*?)\s*-->\s*(.*?)\s*:\s*([^\s]+)(?:\s+(.*))?$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def with_state(lines: DataFrame, indent_mode: str = "dash") -> DataFrame:
    """Marks concept lines and carries the current concept along each file.

    ``lines`` has file, line_no, line. Depth is the number of dashes, or with
    ``indent_mode='space'`` one more than half the leading spaces.
    """
    if indent_mode not in ("dash", "space"):
        raise ValueError("indent_mode is dash or space")
    raw = F.col("line")
    rows = lines.withColumn("indent_spaces", F.length(raw) - F.length(F.ltrim(raw))).withColumn("line", strip(raw))
    line, in_file = F.col("line"), W.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("is_section", F.startswith(line, F.lit(SECTION)))
    rows = rows.withColumn("section", F.sum(F.col("is_section").cast("int")).over(in_file))
    rows = rows.withColumn("is_concept", ~F.col("is_section") & line.rlike(CONCEPT))
    depth = F.length(F.regexp_extract(line, CONCEPT, 1)) if indent_mode == "dash" else F.floor(F.col("indent_spaces") / 2) + 1
    name = strip(F.regexp_extract(line, CONCEPT, 2))
    rows = rows.withColumns({"depth": F.when(F.col("is_concept"), depth), "name": F.when(F.col("is_concept"), name)})
    rows = rows.withColumn("id", short_id(F.col("name")))
    opens = F.when(F.col("depth") == 1, F.col("id"))
    in_section = W.partitionBy("file", "section").orderBy("line_no")
    return rows.withColumns({"parent": F.last(opens, True).over(in_section.rowsBetween(W.unboundedPreceding, -1)), "current": F.last(opens, True).over(in_section.rowsBetween(W.unboundedPreceding, 0))})


def concepts(state: DataFrame, quoted_fix: bool = False) -> DataFrame:
    """``(file, position, id, name, type, parent, props)``: the last definition of an id, at its first place.

    A new definition drops the properties set before it; the last value of a key stays.
    """
    defined = state.where("is_concept").select("file", "line_no", "id", "name", F.regexp_extract("line", CONCEPT, 3).alias("type"), "parent")
    last = defined.groupBy("file", "id").agg(F.min("line_no").alias("position"), F.max("line_no").alias("defined_at"), F.max_by(F.struct("name", "type", "parent"), "line_no").alias("d"))
    given = state.where(~F.col("is_section") & F.col("current").isNotNull() & F.contains("line", F.lit("=")))
    given = given.select("file", F.col("current").alias("id"), "line_no", F.posexplode(key_values(F.col("line"), quoted_fix)).alias("pos", "kv"))
    kept = given.join(last.select("file", "id", "defined_at"), ["file", "id"]).where("line_no >= defined_at")
    by_key = kept.groupBy("file", "id", F.col("kv.key").alias("key")).agg(F.max_by("kv.value", F.struct("line_no", "pos")).alias("value"))
    props = by_key.groupBy("file", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("props"))
    none = F.create_map().cast("map<string,string>")
    return last.join(props, ["file", "id"], "left").select("file", "position", "id", "d.name", "d.type", "d.parent", F.coalesce("props", none).alias("props"))


def relations(state: DataFrame, quoted_fix: bool = False) -> DataFrame:
    """``(file, line_no, source, target, type, source_name, target_name, props)``, one row for each relation line."""
    rows = state.where(~F.col("is_section") & F.col("line").rlike(RELATION))
    part = lambda i: strip(F.regexp_extract("line", RELATION, i))
    source = without_dashes(part(1))
    pairs = key_values(part(4), quoted_fix)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return rows.select("file", "line_no", short_id(source).alias("source"), short_id(part(2)).alias("target"), relation_type(part(3)).alias("type"), source.alias("source_name"), part(2).alias("target_name"), F.map_from_entries(last).alias("props"))


def parse_notes(lines: DataFrame, indent_mode: str = "dash", quoted_fix: bool = False) -> tuple[DataFrame, DataFrame]:
    state = with_state(lines, indent_mode)
    return concepts(state, quoted_fix), relations(state, quoted_fix)


def dot_lines(concepts_: DataFrame, relations_: DataFrame) -> DataFrame:
    """Lines of a graphviz preview: nodes with labels, then labelled edges."""
    nodes = concepts_.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.format_string('\t"%s" [label="%s"]', "id", "name").alias("line"))
    edges = relations_.select(F.lit(2).alias("part"), F.col("source").alias("key"), F.format_string('\t"%s" -> "%s" [label="%s"]', "source", "target", "type").alias("line"))
    return nodes.unionByName(edges)
