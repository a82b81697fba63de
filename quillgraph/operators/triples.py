"""Concept and relation tables to triples.

A triple table has s, p, o, kind; kind is ``iri`` or ``literal``. Concepts have
row_no, id, name, type, parent and a map ``props`` keyed by column header;
relations have source, target, type. Triples are sets, so tables are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import base_iri, ontology_iri, predicate_name, property_name, short_id
from quillgraph.functions.text import filled

#: Vocabularies and the types that are classes.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
CLASSES_15 = ("概念", "元素", "类别", "模型", "组件", "现象", "类型", "目标", "方法", "算法", "属性", "操作", "主题", "任务", "组织")
CLASSES_5 = ("概念", "元素", "类别", "模型", "组件")
COMMENT_KEY = "描述:LABEL"


def _triple(s: Column, p: Column | str, o: Column | str, kind: str) -> list[Column]:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [s.alias("s"), col(p).alias("p"), col(o).alias("o"), F.lit(kind).alias("kind")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def typed_concepts(concepts: DataFrame, classes: tuple[str, ...] = CLASSES_15) -> DataFrame:
    """Valid rows, trimmed, with ``is_class``. A null type is no class."""
    rows = concepts.where((F.length("id") > 0) & (F.length("name") > 0))
    rows = rows.withColumns({"id": F.trim("id"), "name": F.trim("name"), "type": F.coalesce(F.trim("type"), F.lit("")), "parent": filled(F.col("parent"))})
    return rows.withColumn("is_class", F.col("type").isin(*classes))


def _property_rows(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode("props").alias("key", "value")).where(filled(F.col("value")).isNotNull()).withColumn("value", F.trim("value"))


def owl_triples(concepts: DataFrame, relations: DataFrame, iri: str, classes: tuple[str, ...] = CLASSES_15) -> DataFrame:
    """One namespace. A parent counts if a row with its id stands at or before the child, as a class if such a row is one."""
    ns = F.lit(ontology_iri(iri))
    rows = typed_concepts(concepts, classes).withColumn("uri", F.concat(ns, F.col("id")))
    seen = rows.groupBy(F.col("id").alias("parent")).agg(F.min(F.when(F.col("is_class"), F.col("row_no"))).alias("class_from"))
    above = rows.join(seen, "parent").where("class_from <= row_no")
    props = _property_rows(rows).withColumn("p", F.concat(ns, property_name(F.col("key"))))
    typed = rows.select("uri").union(props.select("p")).distinct()
    links = _resolved(relations, rows.select("id", "uri"))
    links = links.withColumn("p", F.concat(ns, predicate_name(F.col("type"))))
    new = links.select("p", "type").distinct().join(typed.withColumnRenamed("uri", "p"), "p", "left_anti")
    header = concepts.sparkSession.range(1).select(*_triple(F.lit(ontology_iri(iri)), f"{RDF}type", f"{OWL}Ontology", "iri"))
    return _union([
        header,
        rows.select(*_triple(F.col("uri"), f"{RDF}type", F.when(F.col("is_class"), F.lit(f"{OWL}Class")).otherwise(F.lit(f"{OWL}NamedIndividual")), "iri")),
        rows.select(*_triple(F.col("uri"), f"{RDFS}label", F.col("name"), "literal")),
        above.select(*_triple(F.col("uri"), F.when(F.col("is_class"), F.lit(f"{RDFS}subClassOf")).otherwise(F.lit(f"{RDF}type")), F.concat(ns, F.col("parent")), "iri")),
        props.select(*_triple(F.col("p"), f"{RDF}type", f"{OWL}AnnotationProperty", "iri")),
        props.select(*_triple(F.col("uri"), F.col("p"), F.col("value"), "literal")),
        new.select(*_triple(F.col("p"), f"{RDF}type", f"{OWL}ObjectProperty", "iri")),
        new.select(*_triple(F.col("p"), f"{RDFS}label", F.col("type"), "literal")),
        links.select(*_triple(F.col("s"), F.col("p"), F.col("o"), "iri")),
    ])


def ttl_triples(concepts: DataFrame, relations: DataFrame, iri: str, data_iri: str, classes: tuple[str, ...] = CLASSES_15) -> DataFrame:
    """Classes and properties in the ontology's namespace, individuals in the data's. A parent is its latest row at or before the child."""
    ont, data = F.lit(ontology_iri(iri)), F.lit(base_iri(data_iri))
    rows = typed_concepts(concepts, classes).withColumn("uri", F.concat(F.when(F.col("is_class"), ont).otherwise(data), F.col("id")))
    history = rows.groupBy(F.col("id").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("row_no", "uri", "is_class"))).alias("h"))
    above = rows.join(history, "parent").withColumn("up", F.try_element_at(F.filter("h", lambda x: x["row_no"] <= F.col("row_no")), F.lit(-1))).where("up.is_class")
    props = _property_rows(rows).withColumn("p", F.concat(ont, property_name(F.col("key"))))
    latest = rows.groupBy("id").agg(F.max_by("uri", "row_no").alias("uri"))
    links = _resolved(relations, latest).withColumn("p", F.concat(ont, predicate_name(F.col("type"))))
    typed = rows.select("uri").union(props.select("p")).distinct()
    new = links.select("p", "type").distinct().join(typed.withColumnRenamed("uri", "p"), "p", "left_anti")
    return _union([
        rows.select(*_triple(F.col("uri"), f"{RDF}type", F.when(F.col("is_class"), F.lit(f"{OWL}Class")).otherwise(F.lit(f"{OWL}NamedIndividual")), "iri")),
        rows.select(*_triple(F.col("uri"), f"{RDFS}label", F.col("name"), "literal")),
        above.select(*_triple(F.col("uri"), F.when(F.col("is_class"), F.lit(f"{RDFS}subClassOf")).otherwise(F.lit(f"{RDF}type")), F.col("up.uri"), "iri")),
        props.select(*_triple(F.col("p"), f"{RDF}type", f"{OWL}AnnotationProperty", "iri")),
        props.select(*_triple(F.col("p"), f"{RDFS}label", F.col("key"), "literal")),
        props.select(*_triple(F.col("uri"), F.col("p"), F.col("value"), "literal")),
        new.select(*_triple(F.col("p"), f"{RDF}type", f"{OWL}ObjectProperty", "iri")),
        new.select(*_triple(F.col("p"), f"{RDFS}label", F.col("type"), "literal")),
        links.select(*_triple(F.col("s"), F.col("p"), F.col("o"), "iri")),
    ])


def _resolved(relations: DataFrame, uris: DataFrame) -> DataFrame:
    """``(s, o, type)`` of complete relations whose ends are known."""
    uris = uris.distinct()
    rows = relations.select(filled(F.col("source")).alias("source"), filled(F.col("target")).alias("target"), filled(F.col("type")).alias("type")).where("type is not null")
    return rows.join(uris.select(F.col("id").alias("source"), F.col("uri").alias("s")), "source").join(uris.select(F.col("id").alias("target"), F.col("uri").alias("o")), "target").select("s", "o", "type")


def jsonld_nodes(concepts: DataFrame, iri: str, classes: tuple[str, ...] = CLASSES_5) -> DataFrame:
    """``(id, key, values)`` rows; values are structs (value, is_ref). Parents resolve in any order, the last row of an id counting."""
    base = iri.rstrip("#")
    node = lambda name: F.concat(F.lit(base + "#"), short_id(name))
    rows = concepts.where(filled(F.col("id")).isNotNull()).withColumns({"id": F.trim("id"), "name": F.trim(F.coalesce("name", F.lit(""))), "type": F.trim(F.coalesce("type", F.lit(""))), "parent": filled(F.col("parent"))})
    rows = rows.withColumns({"uri": node(F.col("name")), "is_class": F.col("type").isin(*classes)})
    names = rows.groupBy(F.col("id").alias("parent")).agg(F.max_by("name", "row_no").alias("parent_name"))
    value = lambda v, ref=False: F.array(F.struct(v.alias("value"), F.lit(ref).alias("is_ref")))
    key = lambda k: F.lit(k).alias("key")
    at = [F.col("uri").alias("id")]
    props = _property_rows(rows)
    parts = [
        concepts.sparkSession.range(1).select(F.lit(base).alias("id"), key("@type"), value(F.lit(f"{OWL}Ontology")).alias("values")),
        rows.select(*at, key("@type"), value(F.when(F.col("is_class"), F.lit(f"{OWL}Class")).otherwise(F.lit(f"{OWL}NamedIndividual"))).alias("values")),
        rows.select(*at, key(f"{RDFS}label"), value(F.col("name")).alias("values")),
        props.where(F.col("key") == COMMENT_KEY).select(*at, key(f"{RDFS}comment"), value(F.col("value")).alias("values")),
        rows.join(names, "parent").where("parent_name <> ''").select(*at, F.when(F.col("is_class"), F.lit(f"{RDFS}subClassOf")).otherwise(F.lit(f"{RDF}type")).alias("key"), value(node(F.col("parent_name")), True).alias("values")),
        props.select(*at, F.concat(F.lit(base + "#"), F.col("key")).alias("key"), value(F.col("value")).alias("values")),
    ]
    return reduce(DataFrame.unionByName, parts)


def jsonld_relations(relations: DataFrame, concepts: DataFrame, iri: str) -> DataFrame:
    """Rows (id, key, values) with each subject's objects once for each predicate."""
    base = iri.rstrip("#")
    rows = concepts.where(filled(F.col("id")).isNotNull()).groupBy(F.trim("id").alias("id")).agg(F.max_by(F.trim("name"), "row_no").alias("name"))
    uris = rows.select("id", F.concat(F.lit(base + "#"), short_id(F.col("name"))).alias("uri"))
    links = _resolved(relations, uris).select(F.col("s").alias("id"), F.concat(F.lit(base + "#"), predicate_name(F.col("type"))).alias("key"), "o").distinct()
    return links.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct(F.col("o").alias("value"), F.lit(True).alias("is_ref")))).alias("values"))


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of rows (id, key, values) by id and key: old values first, then new ones that are not there."""
    none = F.array().cast("array<struct<value:string,is_ref:boolean>>")
    return old.select("id", "key", F.col("values").alias("a")).join(new.select("id", "key", F.col("values").alias("b")), ["id", "key"], "full").select("id", "key", F.array_union(F.coalesce("a", none), F.coalesce("b", none)).alias("values"))


def json_triples(docs: DataFrame, base: str) -> DataFrame:
    """Triples of JSON lemma documents, given as ``(id, doc)`` with doc a JSON text.

    Scalar members become literals; members that are lists of objects give a
    node for each of the objects' scalars; classes of ``extData.classify`` give a
    node each with its name.
    """
    s = F.concat(F.lit(base), F.col("id"))
    members = docs.select("id", F.explode(F.from_json("doc", "map<string,string>")).alias("key", "value")).where("value is not null")
    is_list = F.col("value").rlike(r"(?s)^\s*\[\s*\{")
    scalar = members.where(~F.col("value").rlike(r"(?s)^\s*[\[{]"))
    nested = members.where(is_list).select("id", "key", F.explode(F.from_json("value", "array<map<string,string>>")).alias("item")).select("id", "key", F.explode("item").alias("sub", "value")).where("value is not null")
    classes = docs.select("id", F.explode(F.from_json(F.get_json_object("doc", "$.extData.classify"), "array<struct<id:string,name:string>>")).alias("c"))
    node = F.concat(F.lit(base), F.col("sub"), F.lit("/"), F.col("value"))
    class_node = F.concat(F.lit(base + "classify/"), F.col("c.id"))
    return _union([
        scalar.select(*_triple(s, F.concat(F.lit(base), F.col("key")), F.col("value"), "literal")),
        nested.select(*_triple(s, F.concat(F.lit(base), F.col("key")), node, "iri")),
        classes.select(*_triple(s, f"{base}classify", class_node, "iri")),
        classes.select(*_triple(class_node, f"{base}name", F.col("c.name"), "literal")),
    ])


def _escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def turtle_lines(triples: DataFrame) -> DataFrame:
    """One statement a line, with full IRIs."""
    o = F.when(F.col("kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"')))
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def rdfxml_parts(triples: DataFrame) -> DataFrame:
    """A description element for each subject; a sink puts the root element around them."""
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    cut = r"^(.*[#/])([^#/]*)$"
    space, local = F.regexp_extract("p", cut, 1), F.regexp_extract("p", cut, 2)
    start = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), xml(space), F.lit('"'))
    element = F.when(F.col("kind") == "iri", F.concat(start, F.lit(' rdf:resource="'), xml(F.col("o")), F.lit('"/>'))).otherwise(F.concat(start, F.lit(">"), xml(F.col("o")), F.lit("</p:"), local, F.lit(">")))
    body = F.array_join(F.sort_array(F.collect_list(element)), "")
    return triples.groupBy("s").agg(body.alias("b")).select(F.concat(F.lit('<rdf:Description rdf:about="'), xml(F.col("s")), F.lit('">'), F.col("b"), F.lit("</rdf:Description>")).alias("value"))


def jsonld_lines(nodes: DataFrame) -> DataFrame:
    """One JSON object for each node id."""
    text = F.transform("values", lambda v: F.when(v["is_ref"], F.concat(F.lit('{"@id":"'), _escaped(v["value"]), F.lit('"}'))).otherwise(F.concat(F.lit('"'), _escaped(v["value"]), F.lit('"'))))
    member = F.concat(F.lit('"'), _escaped(F.col("key")), F.lit('":['), F.array_join(text, ","), F.lit("]"))
    return nodes.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("m")).select(F.concat(F.lit('{"@id":"'), _escaped(F.col("id")), F.lit('",'), F.col("m"), F.lit("}")).alias("value"))
