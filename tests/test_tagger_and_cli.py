"""The sequence tagger against a plain loop, and the commands over files."""

from __future__ import annotations

import json

import numpy as np

from quillgraph.__main__ import main
from quillgraph.operators import tagger


def model(rng, vocab=9, d=4, h=3, n=3):
    gates = lambda size: (rng.normal(size=(4 * h, size)), rng.normal(size=(4 * h, h)), rng.normal(size=4 * h))
    return tagger.Tagger(rng.normal(size=(vocab, d)), [(gates(d), gates(d)), (gates(2 * h), gates(2 * h))], rng.normal(size=(n, 2 * h)), rng.normal(size=n), rng.normal(size=(n, n)), rng.normal(size=n), rng.normal(size=n))


def slow_lstm(xs, w, u, b):
    h, c, out = [0.0] * u.shape[1], [0.0] * u.shape[1], []
    s = lambda v: 1 / (1 + np.exp(-v))
    for x in xs:
        z = [sum(w[r][k] * x[k] for k in range(len(x))) + sum(u[r][k] * h[k] for k in range(len(h))) + b[r] for r in range(len(b))]
        m = len(h)
        c = [s(z[m + k]) * c[k] + s(z[k]) * np.tanh(z[2 * m + k]) for k in range(m)]
        h = [s(z[3 * m + k]) * np.tanh(c[k]) for k in range(m)]
        out.append(list(h))
    return out


def test_emissions():
    m = model(np.random.default_rng(0))
    ids = [1, 4, 2, 8]
    x = [list(m.embedding[i]) for i in ids]
    for ahead, back in m.layers:
        a, b = slow_lstm(x, *ahead), slow_lstm(x[::-1], *back)[::-1]
        x = [p + q for p, q in zip(a, b, strict=True)]
    want = [[sum(m.out_weight[j][k] * r[k] for k in range(len(r))) + m.out_bias[j] for j in range(3)] for r in x]
    assert np.allclose(m.emissions(ids), want)


def test_tagged(spark):
    import itertools

    m = model(np.random.default_rng(1))
    rows = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [])], "sent_id int, ids array<int>")
    got = {r["sent_id"]: r["labels"] for r in tagger.tagged(rows, m, ["O", "B-X", "I-X"]).collect()}
    e = m.emissions([1, 2, 3, 4])
    score = lambda p: m.start[p[0]] + m.end[p[-1]] + sum(e[i, j] for i, j in enumerate(p)) + sum(m.transitions[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(3), repeat=4), key=score)
    assert got == {0: [["O", "B-X", "I-X"][j] for j in best], 1: []}


def test_fit_transitions(spark):
    rows = spark.createDataFrame([(["B", "E", "O"],), (["O"],), ([],)], "labels array<string>")
    moves, start, end = tagger.fit_transitions(rows, ["B", "E", "O"], 1e-9)
    assert moves[0].argmax() == 1 and moves[1].argmax() == 2 and np.allclose(np.exp(start), [0.5, 0, 0.5], atol=1e-6) and end.argmax() == 2


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("## 【核心概念】\n- graph @概念 use=search\n- node @组件\n- graph --> node : has\n")
    run = lambda *a: main([str(x) for x in a])
    run("parse", tmp_path / "notes", tmp_path / "t")
    for name in ("owl", "ttl", "jsonld"):
        run(name, tmp_path / "t", tmp_path / name)
    text = lambda name: "".join(p.read_text() for p in (tmp_path / name).glob("part-*"))
    assert "subClassOf" in text("ttl") and "rdf:resource" in text("owl") and all(json.loads(line)["@id"] for line in text("jsonld").splitlines())
    run("embed", tmp_path / "t", tmp_path / "e")
    run("ask", tmp_path / "e", "-q", "graph", "-k", 1)
    out = capsys.readouterr().out
    assert "graph (similarity: 1.0000)" in out and "graph has node" in out
    run("clean", tmp_path / "notes", tmp_path / "c")
    assert (tmp_path / "c/file=a.md").is_dir()
    run("chunk", tmp_path / "notes", tmp_path / "chunks")
    assert "graph" in text("chunks")
