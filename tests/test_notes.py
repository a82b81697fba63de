"""Hand-derived results for the note grammar and the identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillgraph.functions.ids import base_iri, link_url, ontology_iri, short_id
from quillgraph.operators import notes, triples

LINES = """## 【核心概念】
- 河流 @水体 说明="由高处流向低处的水" 出处="地理" 级别="2"
  - 支流 @水体 类型=小 说明="汇入另一条河流，水量较小"
- 湖泊 @水体 面积=大 别名="内陆的水域"
  - 盐湖 @湖 说明="含盐量高的湖" 出处="湖泊"
    - 干盐湖 @湖 常见=否
## 【关联关系】
- 河流 --> 支流 : 拥有
- 雨水 --> 地下水 : 类型=补给 程度=0.4
- 雨水 --> 蒸发 : 类型=经由
- 雨水 --> 蒸发 : 经由 时段="夏季\"""".split("\n")


def own_id(name):
    return hashlib.md5(name.encode()).hexdigest()[:8]


def lines(spark, text, file="a.md"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text)], "file string, line_no int, line string")


def test_concepts_chain_and_properties(spark):
    concepts, _ = notes.parse_notes(lines(spark, LINES))
    got = {r["name"]: (r["type"], r["parent"], r["props"]) for r in concepts.collect()}
    assert {r["id"] for r in concepts.collect()} == set(map(own_id, got))
    assert got["河流"] == ("水体", None, {"说明": "由高处流向低处的水", "出处": "地理", "级别": "2"})
    assert got["支流"] == ("水体", own_id("河流"), {"类型": "小", "说明": "汇入另一条河流，水量较小"})
    assert got["湖泊"][1:] == (own_id("支流"), {"面积": "大", "别名": "内陆的水域"})
    assert got["盐湖"][1] == own_id("湖泊")
    assert got["干盐湖"][1:] == (own_id("盐湖"), {"常见": "否", "类型": "经由", "程度": "0.4", "时段": "夏季"})


def test_relations(spark):
    _, relations = notes.parse_notes(lines(spark, LINES))
    got = [(r["source"], r["target"], r["type"], r["props"]) for r in relations.orderBy("line_no").collect()]
    rain, vapour = own_id("雨水"), own_id("蒸发")
    assert got == [(own_id("河流"), own_id("支流"), "拥有", {}), (rain, own_id("地下水"), "补给", {"程度": "0.4"}), (rain, vapour, "经由", {}), (rain, vapour, "经由", {"时段": "夏季"})]


def test_redefinition_resets_properties_and_is_its_own_parent(spark):
    concepts, _ = notes.parse_notes(lines(spark, ["- a @T x=1", "- a @U y=2", "-- b @T z=3"]))
    got = {r["name"]: r for r in concepts.collect()}
    assert got["a"]["props"] == {"y": "2", "z": "3"} and got["a"]["parent"] == got["a"]["id"] and got["a"]["position"] == 0
    assert got["b"]["props"] == {} and got["b"]["parent"] == got["a"]["id"]


def test_space_indent_and_sections(spark):
    concepts, _ = notes.parse_notes(lines(spark, ["- a @T", "  - b @T", "## 【核心概念】", "  - c @T", "@ 类型"]), "space")
    got = {r["name"]: r["parent"] for r in concepts.collect()}
    assert got == {"a": None, "b": concepts.where("name = 'a'").first()["id"], "c": None}


def test_short_ids(spark):
    names = ["河流", "a b", "", "Ünïcode"]
    rows = spark.createDataFrame([(k,) for k in names], "name string").select("name", short_id(F.col("name")).alias("id"))
    assert {r["name"]: r["id"] for r in rows.collect()} == {n: own_id(n) for n in names}


def test_iris(spark):
    assert ontology_iri("http://x") == "http://x#" and ontology_iri("http://x/") == "http://x/" and base_iri("http://x") == "http://x/"
    assert spark.range(1).select(link_url(F.lit("/item/a?b=1"), "https://h")).first()[0] == "https://h/item/a"


def concept_rows(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no long, id string, name string, type string, parent string, props map<string,string>")


RELATIONS = "source string, target string, type string"


def test_owl_parent_must_come_first(spark):
    rows = concept_rows(spark, [("b", "B", "概念", "a", {}), ("a", "A", "概念", None, {}), ("c", "C", "物", "a", {"k:LABEL": " v "}), (None, "x", "概念", None, {}), ("", "y", "概念", None, {})])
    rels = spark.createDataFrame([("a", "c", "k_LABEL"), ("a", "z", "t"), ("a", None, "t"), ("c", "a", "has it")], RELATIONS)
    got = {tuple(r)[:3] for r in triples.owl_triples(rows, rels, "http://o").collect()}
    o, sub, is_ = "http://o#", triples.RDFS + "subClassOf", triples.RDF + "type"
    assert (o + "b", sub, o + "a") not in got and (o + "c", is_, o + "a") in got
    assert (o + "c", o + "k_LABEL", "v") in got and (o + "a", o + "k_LABEL", o + "c") in got
    assert (o + "k_LABEL", is_, triples.OWL + "ObjectProperty") not in got
    assert (o + "has_it", triples.RDFS + "label", "has it") in got and not any("z" in x[2][-2:] for x in got)


def test_turtle_latest_parent_and_namespaces(spark):
    rows = concept_rows(spark, [("a", "A", "概念", None, {}), ("a", "A2", "物", None, {}), ("b", "B", "概念", "a", {})])
    got = {tuple(r)[:3] for r in triples.ttl_triples(rows, spark.createDataFrame([("a", "b", "t")], RELATIONS), "http://o", "http://d").collect()}
    assert not any(p.endswith("subClassOf") for _, p, _ in got)
    assert ("http://d/a", "http://o#t", "http://o#b") in got


def test_jsonld_comment_and_merge(spark):
    rows = concept_rows(spark, [("a", "A", "概念", "b", {"描述:LABEL": "text"}), ("b", "B", "物", None, {})])
    nodes = triples.jsonld_nodes(rows, "http://o").select("id", "key", "values")
    keys = [r["key"] for r in nodes.where("exists(values, v -> v.value = 'text')").collect()]
    assert sorted(keys) == ["http://o#描述:LABEL", triples.RDFS + "comment"]
    merged = triples.merged_nodes(nodes, nodes)
    assert merged.count() == nodes.count() and merged.where("size(values) <> 1").count() == 0
    assert triples.jsonld_lines(merged).count() == 3


def test_serialised_triples(spark):
    t = spark.createDataFrame([("http://s", "http://p#q", 'a"b\n<', "literal"), ("http://s", "http://p#r", "http://o", "iri")], "s string, p string, o string, kind string")
    assert {r[0] for r in triples.turtle_lines(t).collect()} == {'<http://s> <http://p#q> "a\\"b\\n<" .', "<http://s> <http://p#r> <http://o> ."}
    (xml,) = [r[0] for r in triples.rdfxml_parts(t).collect()]
    assert '<p:r xmlns:p="http://p#" rdf:resource="http://o"/>' in xml and "&lt;</p:q>" in xml
