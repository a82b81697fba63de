"""Training the tagger: exact gradients, Adam in each task, weights averaged after each epoch.

An epoch deals the sentences anew to a fixed number of tasks. Each task starts from
the shared weights, takes its batches in a drawn order and sends back one set of
weights, so what the driver gathers is bounded by tasks times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.sequences import weighted_scores
from quillgraph.operators.tagger import Gates, Tagger, tagged


def fresh(vocabulary: int, labels: int, embedding: int = 128, hidden: int = 256, layers: int = 2, seed: int = 42) -> Tagger:
    """Small random weights; ``hidden`` counts both directions."""
    rng = np.random.default_rng(seed)
    half = hidden // 2
    draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(shape[-1])
    gates = lambda d: (draw(4 * half, d), draw(4 * half, half), np.zeros(4 * half))
    stack = [tuple(gates(embedding if i == 0 else 2 * half) for _ in range(2)) for i in range(layers)]
    return Tagger(rng.normal(size=(vocabulary, embedding)) * 0.1, stack, draw(labels, 2 * half), np.zeros(labels), rng.normal(size=(labels, labels)) * 0.1, np.zeros(labels), np.zeros(labels))


def weights(model: Tagger) -> list[np.ndarray]:
    own = [model.embedding, model.out_weight, model.out_bias, model.transitions, model.start, model.end]
    return own + [a for both in model.layers for gates in both for a in gates]


def with_weights(values: list[np.ndarray]) -> Tagger:
    embedding, *rest = values[:6]
    gates = [tuple(values[i : i + 3]) for i in range(6, len(values), 3)]
    return Tagger(embedding, list(zip(gates[::2], gates[1::2], strict=True)), *rest)


def _lstm(x: np.ndarray, gates: Gates) -> tuple[np.ndarray, list[tuple]]:
    w, u, b = gates
    h = c = np.zeros(u.shape[1])
    inputs, out, kept = x @ w.T + b, [], []
    for step in inputs:
        i, f, g, o = np.split(step + u @ h, 4)
        i, f, g, o = 1 / (1 + np.exp(-i)), 1 / (1 + np.exp(-f)), np.tanh(g), 1 / (1 + np.exp(-o))
        before = (h, c)
        c = f * c + i * g
        t = np.tanh(c)
        h = o * t
        out.append(h)
        kept.append((i, f, g, o, t, *before))
    return np.array(out).reshape(len(x), u.shape[1]), kept


def _lstm_slopes(x: np.ndarray, gates: Gates, kept: list[tuple], dout: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    w, u, _ = gates
    dz, du = np.zeros((len(x), len(w))), np.zeros_like(u)
    dh = dc = np.zeros(u.shape[1])
    for at in range(len(x) - 1, -1, -1):
        i, f, g, o, t, h, c = kept[at]
        dh = dh + dout[at]
        dc = dc + dh * o * (1 - t * t)
        z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * t * o * (1 - o)])
        dz[at], du = z, du + np.outer(z, h)
        dh, dc = u.T @ z, dc * f
    return dz @ w, [dz.T @ x, du, dz.sum(0)]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def loss_and_slopes(model: Tagger, ids: list[int], labels: list[int]) -> tuple[float, list[np.ndarray]]:
    """The negative log likelihood of a labelled sentence, and its slopes in the order of ``weights``."""
    tokens, path = np.asarray(ids, int), np.asarray(labels, int)
    x = model.embedding[tokens]
    passes = []
    for ahead, back in model.layers:
        (a, kept_a), (b, kept_b) = _lstm(x, ahead), _lstm(x[::-1], back)
        passes.append((x, kept_a, kept_b))
        x = np.concatenate([a, b[::-1]], axis=1)
    e, moves = x @ model.out_weight.T + model.out_bias, model.transitions
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0], beta[-1] = model.start + e[0], model.end
    for t in range(1, len(e)):
        alpha[t] = _log_sum(alpha[t - 1][:, None] + moves, 0) + e[t]
    for t in range(len(e) - 2, -1, -1):
        beta[t] = _log_sum(moves + (e[t + 1] + beta[t + 1])[None, :], 1)
    log_z = float(_log_sum(alpha[-1] + model.end, 0))
    rows = np.arange(len(path))
    score = e[rows, path].sum() + moves[path[:-1], path[1:]].sum() + model.start[path[0]] + model.end[path[-1]]
    de = np.exp(alpha + beta - log_z)
    dmoves = np.exp(alpha[:-1, :, None] + moves[None] + (e[1:] + beta[1:])[:, None, :] - log_z).sum(0)
    dstart, dend = de[0].copy(), de[-1].copy()
    de[rows, path] -= 1
    np.subtract.at(dmoves, (path[:-1], path[1:]), 1)
    dstart[path[0]] -= 1
    dend[path[-1]] -= 1
    dx, slopes = de @ model.out_weight, []
    for (ahead, back), (inner, kept_a, kept_b) in zip(reversed(model.layers), reversed(passes), strict=True):
        half = dx.shape[1] // 2
        da, own_a = _lstm_slopes(inner, ahead, kept_a, dx[:, :half])
        db, own_b = _lstm_slopes(inner[::-1], back, kept_b, dx[::-1, half:])
        dx, slopes = da + db[::-1], own_a + own_b + slopes
    dwords = np.zeros_like(model.embedding)
    np.add.at(dwords, tokens, dx)
    return log_z - float(score), [dwords, de.T @ x, de.sum(0), dmoves, dstart, dend, *slopes]


def _descend(model: Tagger, sentences: list[tuple[list[int], list[int]]], batch: int, rate: float) -> tuple[Tagger, float]:
    """One pass of Adam over the sentences in their order; the new weights and the summed loss."""
    now = [w.copy() for w in weights(model)]
    mean, square, total = [np.zeros_like(w) for w in now], [np.zeros_like(w) for w in now], 0.0
    for step, at in enumerate(range(0, len(sentences), batch), 1):
        part = sentences[at : at + batch]
        held, found = with_weights(now), None
        for ids, labels in part:
            loss, slopes = loss_and_slopes(held, ids, labels)
            total += loss
            found = slopes if found is None else [a + b for a, b in zip(found, slopes, strict=True)]
        for w, g, m, s in zip(now, found, mean, square, strict=True):
            g = g / len(part)
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return with_weights(now), total


@dataclass
class Epoch:
    loss: float  # mean over training sentences, before their batch's step
    precision: float
    recall: float
    f1: float


def train(sentences: DataFrame, model: Tagger, names: list[str], epochs: int = 10, batch: int = 32, rate: float = 0.001, tasks: int = 8, seed: int = 42) -> tuple[Tagger, list[Epoch]]:
    """The weights of the epoch with the best F1 on the validation rows, and what each epoch gave.

    ``sentences`` has sent_id, ids, label_ids (numbers into ``names``), labels and
    is_val; rows whose lengths differ or are 0 are left out. Without rows to validate
    the last epoch counts.
    """
    fits = sentences.where((F.size("ids") == F.size("label_ids")) & (F.size("ids") > 0))
    learn, check = fits.where(~F.col("is_val")), fits.where("is_val")
    best, history = (-1.0, model), []
    validated = not check.isEmpty()
    for epoch in range(1, epochs + 1):
        shapes, start = [w.shape for w in weights(model)], model

        def run(batches: Iterator[pa.RecordBatch], start: Tagger = start) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            if rows:
                new, loss = _descend(start, rows, batch, rate)
                flat = np.concatenate([w.ravel() for w in weights(new)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([loss]), pa.array([flat], pa.binary())], names=["n", "loss", "weights"])

        draw = F.xxhash64(F.lit(seed), F.lit(epoch), F.col("sent_id"))
        dealt = learn.withColumn("__d", draw).repartition(tasks, "__d").sortWithinPartitions("__d", "sent_id")
        parts = dealt.select("ids", "label_ids").mapInArrow(run, "n long, loss double, weights binary").collect()
        if not parts:
            break
        count = sum(p["n"] for p in parts)
        flat = sum(np.frombuffer(p["weights"]) * (p["n"] / count) for p in sorted(parts, key=lambda p: (p["n"], bytes(p["weights"]))))
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        model = with_weights([w.reshape(s) for w, s in zip(np.split(flat, cuts), shapes, strict=True)])
        precision = recall = f1 = 0.0
        if validated:
            pairs = tagged(check.withColumnRenamed("labels", "gold"), model, names).select(F.explode(F.arrays_zip("gold", "labels")).alias("p")).select("p.gold", F.col("p.labels").alias("predicted"))
            precision, recall, f1 = weighted_scores(pairs).first()
        history.append(Epoch(sum(p["loss"] for p in parts) / count, precision, recall, f1))
        best = (f1, model) if f1 > best[0] or not validated else best
    return best[1], history
