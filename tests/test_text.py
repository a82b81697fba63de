"""Scalars, chunks, batches and histories."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_formulas(spark):
    assert one(spark, "a $x$ b $y$", text.convert_latex) == "a \\(x\\) b \\(y\\)"
    assert [one(spark, s, text.is_formula) for s in ("", "∑∏", "a" * 50 + "∑", "x_{i}", r"\frac", "x^{2}")] == [False, True, False, True, True, False]
    assert one(spark, "∑∏", text.replace_formula_text) == text.FORMULA


def test_bullets_take_the_first_kind_in_a_line(spark):
    assert one(spark, "a\nb", text.replace_bullets) == "- ● a\n    - ◆ b"


def test_patterns(spark):
    assert one(spark, "a ![x](y) b", text.clean_markdown) == "a [图片] b"
    assert one(spark, "a $$1\n2\n3$$ b $c$", text.clean_markdown) == "a \n[公式]\n b [公式]"
    assert one(spark, r"\begin{figure}x\end{figure}\[y\]", text.clean_markdown) == "[图片][公式]"


def test_key_values(spark):
    pairs = lambda s, **kw: [(r["key"], r["value"]) for r in one(spark, s, lambda c: text.key_values(c, **kw))]
    assert pairs('k="a b" 名=值 z = 1') == [("k", '"a'), ("名", "值"), ("z", "1")]
    assert pairs('k="a b"', quoted_fix=True) == [("k", "a b")]
    assert pairs("none") == []


def test_fixed_chunks(spark):
    assert one(spark, "abcdefg", lambda c: text.fixed_chunks(c, 3)) == ["abc", "def", "g"]
    assert one(spark, "", lambda c: text.fixed_chunks(c, 3)) == []


def test_types(spark):
    assert one(spark, "类型=变体", text.relation_type) == "变体" and one(spark, "包含", text.relation_type) == "包含"
    assert one(spark, " - a-b", text.without_dashes) == "a-b"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\n# h ", "\n\n", "\n- item ", "\n1. x", "\n|a|b|", "word ", "字", "\n```c\n```", "\n***"]), max_size=80).map("".join))
def test_chunks_join_to_the_text(s):
    chunks = chunking.structural_chunks(s, 60, 10)
    assert "".join(chunks) == s and all(chunks)


def test_chunks_are_cut_at_blocks():
    s = "a" * 50 + "\n\n" + "b" * 50 + "\n- c" + "d" * 50
    assert chunking.structural_chunks(s, 60, 10)[0] == "a" * 50
    assert chunking.structural_chunks(None) == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=40))
def test_budget_matches_removal_one_by_one(spark, lengths):
    rows = spark.createDataFrame(list(enumerate(lengths)), "idx long, len long")
    got = {r["idx"] for r in chunking.budget_batches(rows).where("kept").collect()}
    want = set()
    for at in range(0, len(lengths), 16):
        batch = list(range(at, min(at + 16, len(lengths))))
        while batch and (sum(lengths[i] for i in batch) + 2 * len(batch)) // 2 > 4096:
            batch.remove(max(batch, key=lambda i: (lengths[i] // 2, -i)))
        want |= set(batch)
    assert got == want


def test_history(spark):
    rows = spark.createDataFrame([(1, i, "user", str(i)) for i in range(8)], "conv_id int, turn int, role string, text string")
    got = {r["turn"]: [h["content"] for h in r["history"]] for r in chunking.capped_history(rows).collect()}
    assert got[3] == ["0", "1", "2", "3"] and got[7] == ["0", "4", "5", "6", "7"]
