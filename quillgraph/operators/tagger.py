"""A bidirectional LSTM with a CRF on top, applied in Arrow batches.

Weights are plain arrays, shipped with the tasks; training happens elsewhere, or
by :func:`fit_transitions` for the CRF's part on labelled sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.labels import viterbi

Gates = tuple[np.ndarray, np.ndarray, np.ndarray]  # input weights (4h x d), state weights (4h x h), bias (4h)


@dataclass
class Tagger:
    """Layers hold a forward and a backward direction; gates stand in the order input, forget, cell, output."""

    embedding: np.ndarray  # vocabulary x d
    layers: list[tuple[Gates, Gates]]
    out_weight: np.ndarray  # labels x 2h
    out_bias: np.ndarray
    transitions: np.ndarray  # from x to
    start: np.ndarray
    end: np.ndarray

    def emissions(self, ids: list[int]) -> np.ndarray:
        """Scores of each label for each token."""
        x = self.embedding[np.asarray(ids, int)]
        for ahead, back in self.layers:
            x = np.concatenate([_run(x, ahead), _run(x[::-1], back)[::-1]], axis=1)
        return x @ self.out_weight.T + self.out_bias


def save(spark: SparkSession, model: Tagger, names: list[str], path: str) -> None:
    """Weights and label names as one table: a row for each array, with its shape."""
    arrays = [("embedding", model.embedding), ("out_weight", model.out_weight), ("out_bias", model.out_bias), ("transitions", model.transitions), ("start", model.start), ("end", model.end)]
    arrays += [(f"layer/{i}/{way}/{part}", a) for i, both in enumerate(model.layers) for way, gates in enumerate(both) for part, a in enumerate(gates)]
    rows = [(n, list(np.shape(a)), np.asarray(a, float).ravel().tolist(), None) for n, a in arrays] + [("names", [len(names)], None, list(names))]
    spark.createDataFrame(rows, "name string, shape array<long>, numbers array<double>, texts array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Tagger, list[str]]:
    """What save wrote."""
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}
    array = lambda n: np.array(rows[n]["numbers"]).reshape(rows[n]["shape"])
    count = len({n.split("/")[1] for n in rows if n.startswith("layer/")})
    layers = [tuple(tuple(array(f"layer/{i}/{way}/{part}") for part in range(3)) for way in range(2)) for i in range(count)]
    return Tagger(layers=layers, **{n: array(n) for n in ("embedding", "out_weight", "out_bias", "transitions", "start", "end")}), rows["names"]["texts"]


def _run(x: np.ndarray, gates: Gates) -> np.ndarray:
    w, u, b = gates
    h = c = np.zeros(u.shape[1])
    inputs, out = x @ w.T + b, []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for step in inputs:
        i, f, g, o = np.split(step + u @ h, 4)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.array(out).reshape(len(x), u.shape[1])


def with_emissions(df: DataFrame, model: Tagger, ids: str = "ids") -> DataFrame:
    @F.pandas_udf("array<array<double>>")
    def score(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: model.emissions(list(r)).tolist())

    return df.withColumn("emissions", score(F.col(ids)))


def best_labels(model: Tagger, names: list[str], emissions: Column) -> Column:
    """Names of the best path's labels."""
    path = viterbi(emissions, model.transitions.tolist(), model.start.tolist(), model.end.tolist())
    table = F.array(*map(F.lit, names))
    return F.transform(path, lambda i: F.get(table, i))


def tagged(df: DataFrame, model: Tagger, names: list[str], ids: str = "ids") -> DataFrame:
    """Adds ``labels``; sentences without tokens get none."""
    rows = with_emissions(df, model, ids)
    return rows.withColumn("labels", best_labels(model, names, F.col("emissions"))).drop("emissions")


def fit_transitions(sentences: DataFrame, names: list[str], smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log rates of label pairs, first and last labels in ``labels`` arrays: (transitions, start, end). The counts are one aggregation."""
    at = {n: i for i, n in enumerate(names)}
    labels = F.concat(F.array(F.lit("<s>")), F.col("labels"), F.array(F.lit("</s>")))
    pairs = sentences.where(F.size("labels") > 0).select(F.explode(F.zip_with(F.slice(labels, F.lit(1), F.size(labels) - 1), F.slice(labels, F.lit(2), F.size(labels) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    moves, start, end = np.full((len(names),) * 2, smooth), np.full(len(names), smooth), np.full(len(names), smooth)
    for a, b, n in pairs.groupBy("p.a", "p.b").count().collect():
        if a == "<s>" and b in at:
            start[at[b]] += n
        elif b == "</s>" and a in at:
            end[at[a]] += n
        elif a in at and b in at:
            moves[at[a], at[b]] += n
    return np.log(moves / moves.sum(1, keepdims=True)), np.log(start / start.sum()), np.log(end / end.sum())
