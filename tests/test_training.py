"""The tagger's gradients against finite differences, and a training run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillgraph.__main__ import main
from quillgraph.functions.labels import log_partition, path_score
from quillgraph.operators import tagger, tagger_training


def test_slopes():
    model = tagger_training.fresh(6, 3, 4, 6, 2, seed=1)
    model.start[:] = [0.1, -0.2, 0.3]
    ids, labels = [1, 4, 1, 5], [0, 2, 2, 1]
    loss, slopes = tagger_training.loss_and_slopes(model, ids, labels)
    values = tagger_training.weights(model)
    rng = np.random.default_rng(0)
    for w, g in zip(values, slopes, strict=True):
        for at in rng.choice(w.size, min(w.size, 5), replace=False):
            at = np.unravel_index(at, w.shape)
            old = w[at]
            ends = []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                ends.append(tagger_training.loss_and_slopes(tagger_training.with_weights(values), ids, labels)[0])
            w[at] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-6
    assert loss > 0


def test_loss_is_partition_less_score(spark):
    model = tagger_training.fresh(6, 3, 4, 6, 1, seed=2)
    ids, labels = [1, 2, 3, 0], [2, 0, 1, 1]
    row = spark.createDataFrame([(model.emissions(ids).tolist(), labels)], "e array<array<double>>, p array<int>")
    args = model.transitions.tolist(), model.start.tolist(), model.end.tolist()
    want = row.select(log_partition(F.col("e"), *args) - path_score(F.col("e"), F.col("p"), *args)).first()[0]
    assert abs(tagger_training.loss_and_slopes(model, ids, labels)[0] - want) < 1e-9


def test_training(spark):
    names, rng = ["O", "B-X", "E-X"], np.random.default_rng(3)
    rows = []
    for i in range(120):
        ids = rng.integers(2, 8, int(rng.integers(3, 9))).tolist()
        at = int(rng.integers(0, len(ids) - 1))
        ids[at : at + 2] = [8, 9]
        labels = [0] * len(ids)
        labels[at : at + 2] = [1, 2]
        rows.append((i, ids, labels, [names[x] for x in labels], i % 5 == 0))
    rows.append((999, [], [], [], False))
    data = spark.createDataFrame(rows, "sent_id long, ids array<int>, label_ids array<int>, labels array<string>, is_val boolean")
    model, history = tagger_training.train(data, tagger_training.fresh(10, 3, 8, 8, 1), names, epochs=3, batch=4, rate=0.05, tasks=2)
    assert history[-1].loss < history[0].loss / 2 and max(h.f1 for h in history) > 0.95
    found = tagger.tagged(data.where("is_val").drop("labels"), model, names).join(data.select("sent_id", F.col("labels").alias("gold")), "sent_id")
    assert found.where("labels <> gold").count() <= 1
    assert tagger_training.train(data.where("false"), model, names, 2)[1] == []


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    block = "\n".join(["他 O", "在 O", "北 B-LOC", "京 E-LOC", "。 O", ""])
    (tmp_path / "in" / "a.txt").write_text("\n".join([block] * 12 + ["我 O", "去 O", "上 B-LOC", "海 E-LOC", ""] * 8))
    main(["learn", str(tmp_path / "in"), str(tmp_path / "model"), "--epochs", "4", "--rate", "0.05", "--width", "6", "--batch", "2", "--tasks", "1"])
    assert "4: loss" in capsys.readouterr().out
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "t.txt").write_text("他在北京。\n\n我去上海")
    main(["tag", str(tmp_path / "text"), str(tmp_path / "out"), "--model", str(tmp_path / "model")])
    rows = spark.read.json(str(tmp_path / "out")).orderBy("line_no").collect()
    assert [[e["entity"] for e in r["entities"]] for r in rows] == [["北京"], ["上海"]]
