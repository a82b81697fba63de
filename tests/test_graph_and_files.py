"""Graph, page, retrieval, file and stream operators on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine
from quillgraph.operators import graph, pages, retrieval
from quillgraph.plans import flows
from quillgraph.sources import readers, writers
from quillgraph.streaming import incremental


def test_discovery_order_and_limits(spark):
    links = spark.createDataFrame([("a", 0, "b", "B"), ("a", 1, "c", "C"), ("a", 2, "b", "again"), ("b", 0, "d", "D"), ("c", 0, "d", "D2"), ("c", 1, "e", "E"), ("d", 0, "f", "F")], "src string, pos int, dst string, text string")
    v, e = graph.discover(links, "a", 2)
    assert [(r["idx"], r["id"]) for r in v.orderBy("idx").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert sorted((r["src_idx"], r["dst_idx"]) for r in e.collect()) == [(0, 1), (0, 1), (0, 2), (1, 3), (2, 3), (2, 4)]
    assert graph.discover(links, "a", 2, 4)[0].count() == 4
    assert graph.discover(links, "zz", 2)[0].count() == 1


def test_tree_repeats_on_other_paths_only(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "c", 1), ("a", "c", 1)], "src string, dst string, pos int")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted("/".join(r["path"]) for r in graph.tree_paths(edges, start).collect()) == ["a", "a/b", "a/b/c", "a/c"]
    assert graph.tree_paths(edges, start, max_children=1).where("id = 'a' and more").count() == 1


def test_vertex_dedup(spark):
    v = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, name string")
    e = spark.createDataFrame([(1, 2, "t"), (2, 3, "t"), (1, 3, "t"), (3, 3, "s")], "src long, dst long, type string")
    kept, moved = graph.dedup_vertices(v, e, "name", "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    assert sorted(tuple(r) for r in moved.collect()) == [(1, 3, "t"), (3, 3, "s")]


def test_cosine_guards(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0, None]


def test_many_queries_in_parts(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id int, embedding array<double>")
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(retrieval.top_k_many(df, q, 3)) == rows(retrieval.top_k_many(df, q, 3, at_once=2))


PAGE = """<h1 class="lemmaTitle_iuBlp J-lemma-title">T</h1><div class="lemmaSummary_dhg1F J-summary"> S </div><div class="basicInfo_tLQSv J-basic-info">
<dl><dt class="basicInfoItem_iG0fH itemName_RXMP4">k</dt><dd class="basicInfoItem_iG0fH itemValue_oIfsW">v</dd></dl></div>
<ol class="catalogList_dUefQ"><li class="level1"><span class="catalogText_rCNjq"><a>one</a></span></li><li><span class="catalogText_rCNjq"><a>two</a></span></li></ol>
<div class="mainContent_MGLNI"><div class="para_WzwJ3">p &amp; q <a class="innerLink_KLXyc" href="/item/x?y">X</a></div><div class="para_WzwJ3"> </div><a href="/item/z">no</a></div>
<li class="referenceItem_Z9PAD J-ref-item"><a class="refLink_Pcdfd" href="/r">R</a><span>src</span><span>2020</span></li>"""


def test_page_fields(spark):
    row = pages.with_fields(spark.createDataFrame([(PAGE,), (None,)], "html string")).where("html is not null").first()
    info = row["info"].asDict(True)
    assert info["title"] == "T" and info["summary"] == "S" and info["basic_info"] == {"k": "v"} and info["catalog"] == ["one", "    two"] and info["content"] == ["p & q X"]
    assert info["references"] == [{"title": "R", "url": "https://baike.baidu.com/r", "source": "src", "date": "2020"}]
    assert [tuple(x) for x in row["links"]] == [("X", "https://baike.baidu.com/item/x")]


def test_note_files_to_triples_and_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("## 【核心概念】\n- a @概念 k=v\n- b @概念\n- a --> b : t\n")
    (tmp_path / "b.txt").write_text("- no @概念")
    got = flows.notes_to_triples(spark, str(tmp_path), "http://o")
    assert got.where("p like '%subClassOf'").count() == 1 and got.where("p = 'http://o#t'").count() == 1 and got.where("o = 'v'").count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'n "q"\nx', "概念", None, {"k": "v"}), ("2", "m", None, "1", {"j": "w"})], "id string, name string, type string, parent string, props map<string,string>")
    writers.to_csv(writers.wide_concepts(rows), str(tmp_path / "c"))
    back = readers.concept_table(spark, str(tmp_path / "c"))
    got = {r["id"]: (r["name"], r["type"], r["parent"], r["props"]) for r in back.collect()}
    assert got == {"1": ('n "q"\nx', "概念", None, {"k:LABEL": "v"}), "2": ("m", None, "1", {"j:LABEL": "w"})}
    assert readers.embedding_csv(spark, str(tmp_path / "none"), "t").count() == 0


def test_embedding_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.5]), ("b", None)], "t string, embedding array<double>")
    writers.embeddings_to_csv(rows, str(tmp_path / "e"))
    assert [tuple(r) for r in readers.embedding_csv(spark, str(tmp_path / "e"), "t").collect()] == [("a", [1.0, 2.5])]


def test_graph_json_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, "A", "u"), (1, "B", "w")], "idx long, name string, URL string")
    e = spark.createDataFrame([(0, 1, 0, "to b")], "src_idx long, dst_idx long, pos int, text string")
    nodes = writers.graph_nodes(v, e).orderBy("idx").drop("idx")
    (tmp_path / "g.json").write_text("[" + ",".join(nodes.toJSON().collect()) + "]")
    v2, e2 = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in v2.orderBy("idx").collect()] == [(0, "A", "u"), (1, "B", "w")]
    assert [(r["src"], r["dst"], r["text"]) for r in e2.collect()] == [(0, 1, "to b")]


def test_chunk_replies(spark):
    docs = spark.createDataFrame([("f", "x ![a](b) y")], "file string, text string")
    out = flows.chunk_replies(docs, "P", lambda s: s.split("\n")[-1].upper())
    assert [tuple(r) for r in out.collect()] == [("f", 0, "X [图片] Y")]
    assert writers.replies(out, ["file"], "chunk_no", "reply").first()["value"] == "X [图片] Y"


def test_streamed_notes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("- a @概念\n- a --> b : t")
    seen = []
    lines = incremental.note_lines(spark, str(tmp_path / "in"))
    writer = incremental.parsed_notes(lines, lambda c, r, n: seen.append((c.count(), r.count())), str(tmp_path / "cp"))
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert seen == [(1, 1)]
