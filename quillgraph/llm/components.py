"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per vertex (partly aggregated before its shuffle) and a
join with it. The minima are written before they are joined, so that both sides
of the join are plain shuffles, which adaptive execution can split: a hub with
very many neighbours is never gathered in one task. Each round is written to the
shared folder; rounds grow with the logarithm of the longest chain, and end when all edges are stars.
At most IN_ONE_TASK edges, a few hundred kilobytes, are joined up in one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bktree import least_linked
from quillgraph.llm.scratch import Scratch

IN_ONE_TASK = 1 << 14


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    scratch.drop(edges, least)
    return out


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = scratch.keep(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    scratch.drop(edges, least)
    return out


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if rows:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = least_linked(len(ids), at[: len(u)], at[len(u) :])
        other = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[label[other]])], names=["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Whether no vertex has two lesser neighbours, or both a lesser and a greater one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low = 1 and top = 1)").isEmpty()


def star_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(u, v)`` of longs with ``u > v`` to ``(u, v)`` with v the least vertex of u's component.

    The least vertex itself has no row. There must be no self-loops. Repeated edges
    count once; without edges there are no rows.
    """
    now = scratch.keep(edges.distinct(), "edges")
    if now.count() <= IN_ONE_TASK:
        return scratch.keep(now.coalesce(1).mapInArrow(_joined_up, "u long, v long"), "stars")
    while not _settled(now):
        now = _small_star(_large_star(now, scratch), scratch)
    return now
