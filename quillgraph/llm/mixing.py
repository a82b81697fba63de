"""Mixing to target weights: soft domain membership and fitted document rates.

A classifier learned from a labelled table gives each document posteriors over
domains. A document with n tokens, posteriors p and rate r adds n*r*p to the
domains' expected tokens. Nonnegative rates are fitted by accelerated projected
gradient on the squared gaps to the targets, each over its domain's own weight. All documents start at
rate 1, so a document's rate depends on its posteriors alone; posteriors are
rounded to a grid of 1/GRID, tokens are summed per grid point, and every step is
one aggregation over those sums, with the residuals of earlier steps folded
inside the plan. No rate is stored or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.scratch import Scratch

BUCKETS = 4096  # hashed four-byte strings
GRID = 255
PATIENCE = 20  # steps that may bring less than a hundredth of the gap
ROUNDS = 150  # of the classifier's descent
CLOSE = 1e-4  # of all tokens, summed over domains
PART = 1 << 20  # bytes handled at once
MADE = ("n_tokens", "posteriors")


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Square roots of the shares of hashed four-byte strings in the whole text, and its words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts, words, before = np.zeros(BUCKETS), 0, True
    for at in range(0, len(data), PART):
        part = data[at : at + PART + 3].astype(np.uint32)
        gram = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24 if len(part) > 3 else part[:0]
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
        own = data[at : at + PART]
        space = (own == 32) | ((own >= 9) & (own <= 13))
        words += int((~space & np.r_[before, space[:-1]]).sum())
        before = bool(space[-1])
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32), words


class Domains:
    """A softmax over the features; ``names`` in ascending order."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias = names, weights, bias

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """On the grid; each row's greatest entry takes what rounding leaves."""
        z = x @ self.weights + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p = np.rint(p / p.sum(1, keepdims=True) * GRID).astype(np.float64)
        p[np.arange(len(p)), p.argmax(1)] += GRID - p.sum(1)
        return p / GRID


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t)[0].astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "x"])


def train(rows: DataFrame, shares: dict[str, int]) -> Domains:
    """From a bounded sample of ``(text, label)`` rows; ``shares`` are the labels' counts in the whole table.

    Without rows every domain gets its share as posterior, for all documents.
    """
    names = sorted(shares)
    prior = np.log(np.array([shares[n] for n in names], float) / sum(shares.values()))
    got = rows.select("label", "text").mapInArrow(_feature_rows, "label string, x binary").toArrow()
    w = np.zeros((BUCKETS, len(names)))
    if not got.num_rows:
        return Domains(names, w, prior)
    label = np.array([names.index(v) for v in got.column(0).to_pylist()])
    x = np.empty((got.num_rows, BUCKETS), np.float32)
    for i, row in enumerate(v for chunk in got.column(1).chunks for v in chunk):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    del got
    order = np.lexsort((x @ np.linspace(0, 1, BUCKETS, dtype=np.float32), label))  # the same sums in any order of rows
    x, label = x[order], label[order]
    y = np.eye(len(names), dtype=np.float32)[label]
    share = np.maximum(y.mean(0), 1e-9)
    start = np.log(share)
    w = w.astype(np.float32)
    speed, b = np.zeros_like(w), start.copy()
    scale = (1 / share / len(names) / len(x)).astype(np.float32)
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gap = (p - y) * scale
        speed = np.float32(0.9) * speed - np.float32(4.0) * (x.T @ gap + np.float32(1e-5) * w)
        w = w + speed
        b = b - np.float32(0.5) * gap.sum(0)
    return Domains(names, w, (b - start + prior).astype(np.float32))


def with_posteriors(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """All columns, with ``n_tokens`` and ``posteriors`` in the order of the model's names (replaced if there).

    Null counts as empty. Only the text goes to Python.
    """
    carry = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            tokens, rows = [], []
            for at in range(0, len(whole), 256):
                found = [features(t.as_py()) for t in whole.slice(at, 256)]
                tokens += [f[1] for f in found]
                rows += model.posteriors(np.stack([f[0] for f in found])).tolist()
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=list(MADE))

    made = F.arrow_udf(run, "n_tokens long, posteriors array<double>")
    found = docs.select(*carry, made(F.col(text_col).cast("string")).alias("__found"))
    return found.select(*carry, *[f"__found.{c}" for c in MADE])


def _rate(residuals: list[list[float]], eta: float, at_extrapolation: bool = False) -> Column:
    """The rate after the steps whose residuals are given: a fold over them for each row."""
    if not residuals:
        return F.lit(1.0)
    steps = F.array(*[F.struct(F.array(*map(F.lit, e)).alias("e"), F.lit(k / (k + 3)).alias("b")) for k, e in enumerate(residuals)])

    def step(s: Column, x: Column) -> Column:
        slope = F.aggregate(F.zip_with("posteriors", x["e"], lambda p, e: p * e), F.lit(0.0), lambda a, v: a + v)
        new = F.greatest(F.lit(0.0), s["y"] - F.lit(eta) * slope)
        return F.struct(new.alias("r"), (new + x["b"] * (new - s["r"])).alias("y"))

    end = F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step)
    return end["y"] if at_extrapolation else end["r"]


def fit_rates(rows: DataFrame, model: Domains, targets: dict[str, float]) -> tuple[Column, list[float]]:
    """The rate as a column over ``posteriors``, and each domain's share of the fitted tokens.

    ``rows`` has n_tokens and posteriors; targets are weights of all tokens.
    Domains without a target get 0. Without tokens all rates are 1. Steps end when the
    targets are met to CLOSE, or when PATIENCE steps bring no gain: then no rates meet
    them better, and the returned shares tell by how much they are missed.
    """
    k = len(model.names)
    scratch = Scratch(rows.sparkSession, "mixing")
    points = scratch.keep(rows.groupBy("posteriors").agg(F.sum("n_tokens").cast("double").alias("tokens")), "points")
    entry = lambda i: F.col("posteriors")[i]
    sums = points.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * entry(i) * entry(j)) for i in range(k) for j in range(k)]).first()
    total = sums[0] or 0.0
    if not total:
        return F.lit(1.0), [0.0] * k
    gram = np.array(sums[1:], float).reshape(k, k) / total
    own = np.maximum(gram.diagonal(), 1e-12)
    eta = 1 / float(np.linalg.eigvalsh(gram / np.sqrt(np.outer(own, own))).max())
    weight = sum(targets.get(n, 0.0) for n in model.names) or 1.0
    wanted = np.array([targets.get(n, 0.0) / weight for n in model.names])
    mixed = lambda rate: np.array(points.agg(*[F.sum(F.col("tokens") * rate * entry(i)) for i in range(k)]).first(), float) / total
    residuals: list[list[float]] = []
    best, idle, size = np.inf, 0, np.inf
    while size >= CLOSE and idle < PATIENCE:
        gap = mixed(_rate(residuals, eta, True)) - wanted
        residuals.append((gap / own).tolist())
        size = float(np.abs(gap).sum())
        best, idle = (size, 0) if size < 0.99 * best else (best, idle + 1)
    rate = _rate(residuals, eta)
    return rate, mixed(rate).tolist()


def with_rates(rows: DataFrame, rate: Column, id_col: str = "doc_id") -> DataFrame:
    """Adds ``rate`` and ``copies``: the rate rounded up or down by a hash of the id, with the rate as mean."""
    share = F.pmod(F.xxhash64(F.lit(23), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + share).cast("int"))
