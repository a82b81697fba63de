"""The pipeline's stages one by one against brute force, and the whole run."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS

from quillgraph.llm import decontamination, passages, pipeline_stages, queries, simhash_dedup


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, sf_dir).cache()
        out[name] = ({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in new.collect()}, new.columns)
        docs = new
    return out


def test_columns(stages):
    names = [x.split()[0] for x in DOCS.split(", ")]
    assert all(stages[n][2] == names for n in ("language", "simhash", "passages", "benchmark"))
    assert stages["mixing"][2] == [*names, "n_tokens", "posteriors", "rate", "copies"]


def test_language_keeps_prose(stages):
    before, after, _ = stages["language"]
    assert all(after[k] == v for k, v in before.items() if k in after) and len(after) >= 0.98 * len(before)


def slow_near(texts):
    """The least ids of the components of similarity 0.8 or more on bags of five words."""
    bags = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        bags[k] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    label = {k: k for k in bags}
    for a, b in combinations(sorted(bags), 2):
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return set(label.values())


def test_no_near_copies_stay(stages):
    before, after, _ = stages["simhash"]
    assert set(after) == slow_near({k: r["text"] for k, r in before.items()})


def test_near_copies_by_changed_words(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for size, changes in [(5, 0), (8, 0), (9, 1), (60, 1), (60, 2), (200, 1), (200, 4), (200, 6), (1000, 8)] * 6:
        base = [word() for _ in range(size)]
        copy = list(base)
        for at in rng.sample(range(size), changes):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy), " ".join(base[: size - size // 12])]
    texts += ["x y " * 40, "x y " * 44, "x y " * 60]
    hub = [word() for _ in range(80)]
    texts += [" ".join(w if i != at else word() for i, w in enumerate(hub)) for at in range(3, 80, 5)]
    kept = simhash_dedup.keep_one_per_group(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS))
    assert {r["doc_id"] for r in kept.collect()} == slow_near(dict(enumerate(texts)))


def test_cut_passages(stages):
    before, after, _ = stages["passages"]
    assert set(before) == set(after)
    raw = {k: r["text"].encode() for k, r in before.items()}
    counts = {}
    for b in raw.values():
        for i in range(len(b) - 199):
            counts[b[i : i + 200]] = counts.get(b[i : i + 200], 0) + 1
    for k, b in raw.items():
        spans = passages.merged([(i, i + 200) for i in range(len(b) - 199) if counts[b[i : i + 200]] > 1])
        text = passages.kept_bytes(b, spans).decode("utf-8", "ignore")
        assert (after[k]["text"], after[k]["n_chars"]) == (text, len(text))


def test_no_items_left(spark, sf_dir, stages):
    before, after, _ = stages["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    index = decontamination.Index(items)
    assert set(after) == {k for k, r in before.items() if not index.search(r["text"])}


def test_mixing_keeps_all(stages):
    before, after, _ = stages["mixing"]
    assert set(before) == set(after) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in after.values())


def test_odd_documents_pass(spark, tmp_path, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "12 34", "en", "s", 5), (None, "some plain words here", None, "s", 21), (4, "some plain words here", "en", "s", 21), (5, "le chat est la", "fr", "s", 14)]
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0 if name == "labels" else 3).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 4, 5}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert pipeline_stages.TARGETS["clean"] > 0.5


def test_clashing_columns_pass_unchanged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    extra = {"Score": "1.5", "lang_pred": "'mine'", "spans": "7", "row": "8", "packed": "9", "fp": "10", "component_id": "11", "similarity": "12", "item": "13", "u": "14"}
    for name, e in extra.items():
        docs = docs.withColumn(name, F.expr(e))
    want = tuple(docs.select(*extra).first())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns or name == "mixing"
        assert {tuple(r) for r in out.select(*extra).collect()} == {want}


def test_python_gets_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    spark.conf.unset(key)
    try:
        queries.shipped(lambda spark: None)(spark)
        got = spark.range(2000).selectExpr("repeat('x', 10000) t").coalesce(1).mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r[0] for r in got) == 2000 and max(r[1] for r in got) < 3 << 20
        spark.conf.set(key, "64k")
        queries.shipped(lambda spark: None)(spark)
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.unset(key)
