"""Dense ids at size, discovery, chunks, selectors, retrieval tables and saved taggers."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import chunking, graph, pages, retrieval, sequences, tagger
from quillgraph.plans import catalog
from quillgraph.sources import readers


@pytest.mark.parametrize("partitions", ["4", "32"])
def test_dense_ids_of_wide_rows(spark, tmp_path, partitions):
    n = 200_000
    spark.range(n).select(F.col("id").alias("k"), F.xxhash64("id").alias("h"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide")).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = sequences.dense_rank_ids(df, ["h", "k"], 5)
        got = out.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.sum(F.length("wide"))).first()
        order = [r[0] for r in out.where("id < 25").orderBy("id").select("k").collect()]
        assert tuple(got) == (n, n, 5, n + 4, n * 256)
        assert order == [r[0] for r in df.orderBy("h", "k").limit(20).select("k").collect()]
        split = sequences.shuffled_split(df.select("k", "wide"), "k", 0.25)
        assert tuple(split.agg(F.count("*"), F.count_if("is_val")).first()) == (n, n // 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_epochs_are_shuffled_anew(spark):
    rows = spark.range(200).select("id", F.array(F.lit(1)).alias("ids"))
    batch = lambda e: {r["id"]: r["batch"] for r in sequences.shuffled_batches(rows, "id", 32, e).collect()}
    one = batch(1)
    assert one == batch(1) and one != batch(2) and sorted(one.values()) == [i // 32 for i in range(200)]


def test_discovery_stops_at_its_limit(spark):
    links = spark.createDataFrame([("s", i, f"p{i}", "t") for i in range(4)] + [(f"p{i}", k, f"q{i}{k}", "t") for i in range(4) for k in range(3)] + [("p0", 9, "s", "back")], "src string, pos int, dst string, text string")
    for limit, want in ((100, 17), (5, 5), (6, 8), (9, 11), (1, 1)):
        vertices, edges = graph.discover(links, "s", 2, limit)
        assert sorted(r["idx"] for r in vertices.collect()) == list(range(want))
        assert edges.count() == {100: 17, 5: 4, 6: 8, 9: 11, 1: 0}[limit]


def test_least_rows_and_deletion(spark):
    edges = spark.createDataFrame([("a", "b", "t", 2, {"k": "2"}), ("a", "b", "t", 1, {"k": "1"}), ("a", "c", "t", 1, None)], "src string, dst string, type string, w int, props map<string,string>")
    assert sorted((r["dst"], r["w"]) for r in graph.dedup_edges(edges).collect()) == [("b", 1), ("c", 1)]
    assert graph.merge_edges(edges.where("false"), edges).count() == 2
    vertices, none = graph.delete_all(edges.select(F.col("src").alias("id")), edges)
    assert vertices.count() == none.count() == 0 and none.columns == edges.columns


def slow_chunks(doc, size, tolerance):
    """The cut rule, from all blocks and cuts afresh at each block."""
    blocks = [(m.start(), m.end(), m.group().startswith("\n\n")) for m in chunking.BLOCKS.finditer(doc)]
    out, done = [], 0
    for n, (_, end, _) in enumerate(blocks):
        if len(doc[done:end].encode()) <= size + tolerance:
            continue
        low = max(done, end - size - tolerance)
        near = [(m.start(), m.group().startswith("\n\n")) for m in chunking.BLOCKS.finditer(doc, low, end)]
        if n and blocks[n - 1][2]:
            near = [x for x in near if x[1]]
        best = [x for x in near if not x[1]] or near
        cut = best[-1][0] if best and end - best[-1][0] <= size else end
        if cut > done:
            out.append(doc[done:cut])
            done = cut
    return out + [doc[done:]] * (done < len(doc))


def test_chunks(spark, sf_dir):
    rng = np.random.default_rng(1)
    piece = lambda: rng.choice(["\n# head", "\n\n", "\n- item", "\n1. one", "\n| a |", "\n```x\n```", "\n***"]) + "é w" * int(rng.integers(0, 30))
    docs = ["".join(piece() for _ in range(60)) for _ in range(60)] + ["", "no blocks " * 900]
    for d in docs:
        for size, tolerance in ((100, 20), (400, 50)):
            got = chunking.structural_chunks(d, size, tolerance)
            assert got == slow_chunks(d, size, tolerance) and "".join(got) == d
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.QUERIES["md_chunks"](spark, sf_dir).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in rows} == {k: len(slow_chunks(t, 4096, 200)) for k, t in whole.items() if t}


def test_chunks_by_kind(spark):
    docs = spark.createDataFrame([("a.md", "x" * 50), ("b.txt", "y" * 25), ("c.txt", None)], "file string, text string")
    rows = sorted((r["file"], r["chunk_no"], len(r["chunk"])) for r in chunking.chunks_by_kind(docs, size=10, tolerance=2).collect())
    assert rows == [("a.md", 0, 50), ("b.txt", 0, 10), ("b.txt", 1, 10), ("b.txt", 2, 5)]


def test_handlers(spark):
    row = spark.createDataFrame([("a ![i](u) b $x$ c",)], "t string")
    made = lambda m: F.concat(F.lit("<"), F.upper(m), F.lit(">"))
    assert row.select(text.clean_markdown(F.col("t"), made, made)).first()[0] == "a <![I](U)> b <$X$> c"
    assert row.select(text.clean_page(F.col("t"), F.upper)).first()[0] == "A ![I](U) B $X$ C"
    assert row.select(text.with_image_mark(F.col("t"), F.lit(True), F.upper)).first()[0] == "A ![I](U) B $X$ C"


PAGE = '<div id=a class="x y"><p>one<p class=y>two <a href="/q">link</a></div><ul><li>1</li><li data-k="v">2</li></ul>'


@pytest.mark.parametrize(("selector", "want"), [("p.y a", ["link"]), ("div.x.y > p", ["onetwo link"]), ("li", ["1", "2"]), ("li[data-k]", ["2"]), ('li[data-k="v"], #a a', ["link", "2"]), ("*.nope", []), ("li:first", []), ("", [])])
def test_css(selector, want):
    assert pages.select_css(PAGE, selector) == want


@pytest.mark.parametrize(("path", "want"), [("//li", ["1", "2"]), ("//li[2]", ["2"]), ("//a/@href", ["/q"]), ("//li[@data-k='v']", ["2"]), ("//li[", []), ("//none", [])])
def test_xpath(path, want):
    assert pages.select_xpath(PAGE, path) == want and pages.select_xpath(None, path) == []


def test_retrieval_tables(spark, tmp_path):
    assert all(df.count() == 0 for df in readers.retrieval_tables(spark, str(tmp_path / "none")).values())
    (tmp_path / "n_concepts_embeddings.csv").write_text('concept_name,embedding\na,"[1.0, 2.0]"\nb,broken\n')
    (tmp_path / "n_concepts.csv").write_text(":ID,name,type,parent\n1,a,T,\n")
    (tmp_path / "m_concepts.csv").write_text(":ID,name,type,parent\n2,b,T,1\n")
    got = readers.retrieval_tables(spark, str(tmp_path))
    assert [tuple(r) for r in got["concept_embeddings"].collect()] == [("a", [1.0, 2.0])]
    assert sorted(r["name"] for r in got["concepts"].collect()) == ["a", "b"] and got["relations"].count() == got["relation_embeddings"].count() == 0


def test_saved_taggers(spark, tmp_path):
    rng = np.random.default_rng(0)
    gates = lambda d: (rng.normal(size=(12, d)), rng.normal(size=(12, 3)), rng.normal(size=12))
    model = tagger.Tagger(rng.normal(size=(9, 4)), [(gates(4), gates(4)), (gates(6), gates(6))], rng.normal(size=(5, 6)), rng.normal(size=5), rng.normal(size=(5, 5)), rng.normal(size=5), rng.normal(size=5))
    tagger.save(spark, model, list("abcde"), str(tmp_path / "m"))
    back, names = tagger.load(spark, str(tmp_path / "m"))
    assert names == list("abcde") and np.array_equal(back.emissions([1, 2, 3]), model.emissions([1, 2, 3]))


def test_retrieval_answer(spark, sf_dir):
    """The hashed embedding, the cosine and the order, from their definitions."""
    names = {f"{r['p_name']} {r['p_type']}" for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    rows = [f"{r['p_name']} {r['p_type']}" for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]

    def vector(t):
        out = np.zeros(64)
        for g in t.lower().split() + [t.lower()[i : i + 2] for i in range(len(t) - 1)]:
            h = zlib.crc32(g.encode())
            out[h % 64] += -1 if h >> 31 else 1
        return out

    query = vector(min(names))
    score = lambda t: vector(t) @ query / np.linalg.norm(vector(t)) / np.linalg.norm(query)
    top = sorted(((-score(t), t) for t in rows if np.linalg.norm(vector(t))))[:3]
    answer = catalog.QUERIES["retrieval_answer"](spark, sf_dir).first()[0]
    lines = answer.split("\n")
    assert lines[0] == "Concepts:" and [float(re.search(r"similarity: ([\d.]+)", x)[1]) for x in lines[1:]] == [round(-s, 4) for s, _ in top]
    assert retrieval.answer(retrieval.top_k(spark.createDataFrame([], "text string, embedding array<double>"), [1.0], 3, id_col="text"), "None").first()[0] == "None: not found"
