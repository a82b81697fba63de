"""Property graph operators over vertex and edge tables.

Vertices have ``id``; edges ``src``, ``dst``, ``type``. Keys are joined as they
are; Catalyst picks broadcast or shuffle joins, adaptive execution splits skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators.sequences import dense_rank_ids
from quillgraph.sources.scratch import Scratch


def least_rows(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the least by ``order``, else by all columns. Columns of map type are compared by their entries."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema]
    first = F.struct(*([F.col(order)] if order else []), *plain)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), first).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` with values of ``new`` laid over them by key, and the new keys.

    Null values of ``new`` keep the old ones. Of new rows with one key the least
    counts; columns missing on a side are null there.
    """
    new = least_rows(new.where(F.col(key).isNotNull()), [key])
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, df in (("n", new), ("o", old)) if c in df.columns]).alias(c)
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*map(pick, names))


def stub_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Ids that edges name and no vertex has."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).where("id is not null")
    return ends.distinct().join(vertices.select("id"), "id", "left_anti")


def with_stubs(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.unionByName(stub_vertices(edges, vertices), allowMissingColumns=True)


def merge_edges(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds only edges that are not there; of equal keys the least row stays."""
    keys = keys or ["src", "dst", "type"]
    return old.unionByName(least_rows(new, keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def append_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds all edges, repeated ones too."""
    return old.unionByName(new, allowMissingColumns=True)


def parent_edges(vertices: DataFrame) -> DataFrame:
    """``(src, dst)`` from parents to their children, each once."""
    child = vertices.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return child.join(vertices.select(F.col("id").alias("src")).distinct(), "src", "left_semi").distinct()


def resolved_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends are vertices."""
    ids = vertices.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def unresolved_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The other edges, with ``missing``: src, dst or both."""
    ids = vertices.select("id").distinct()
    rows = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    missing = F.when(F.col("has_src").isNull() & F.col("has_dst").isNull(), "both").when(F.col("has_src").isNull(), "src").when(F.col("has_dst").isNull(), "dst")
    return rows.withColumn("missing", missing).where("missing is not null").select(*edges.columns, "missing")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of two or more rows with their ``count``, most first."""
    rows = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1").orderBy(F.desc("count"), *keys)


def removal_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each repeated key how many rows a removal takes away."""
    return duplicate_report(df, keys).select(*keys, (F.col("count") - 1).alias("removed"))


def first_and_rest(df: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the other rows."""
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


def dedup_edges(edges: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One edge for each (src, dst, type): the least by ``order``, and by all columns."""
    return least_rows(edges, keys or ["src", "dst", "type"], order)


def delete_all(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without rows, for writers that overwrite a graph."""
    return vertices.where("false"), edges.where("false")


def dedup_vertices(vertices: DataFrame, edges: DataFrame, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """One vertex for each ``name``, the least by ``order``; edges move to it, once each, without new self-loops."""
    canon = vertices.groupBy(name).agg(F.min(F.struct(F.col(order).alias("o"), F.col("id").alias("i"))).alias("c")).select(name, F.col("c.i").alias("canon"))
    ids = vertices.join(canon, name).select("id", "canon")
    kept = vertices.join(ids.where("id = canon").select("id"), "id", "left_semi")
    to = lambda side: ids.select(F.col("id").alias(side), F.col("canon").alias(f"new_{side}"))
    moved = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    moved = moved.withColumns({"new_src": F.coalesce("new_src", "src"), "new_dst": F.coalesce("new_dst", "dst")})
    moved = moved.where((F.col("new_src") != F.col("new_dst")) | (F.col("src") == F.col("dst")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return kept, dedup_edges(moved.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest))


def delete_other_imports(vertices: DataFrame, edges: DataFrame, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """Vertices of one import only, and the edges that keep both ends. A null stamp is no import."""
    kept = vertices.where(F.col("imported_at") == stamp)
    return kept, resolved_edges(edges, kept)


def simple_digraph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct (src, dst) between known vertices."""
    return resolved_edges(edges.select("src", "dst"), vertices).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, n_out, n_in)`` for every id that an edge names."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def roots(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices that are no edge's end, self-loops aside."""
    return vertices.select("id").join(edges.where("src <> dst").select(F.col("dst").alias("id")), "id", "left_anti")


def tree_paths(edges: DataFrame, start: DataFrame, max_depth: int = 3, max_children: int = 6) -> DataFrame:
    """Paths from start ids: ``(path, id, depth, more)``, where a vertex returns on other paths but not on its own.

    Of a vertex's children, in order of ``pos`` then id, the first ``max_children``
    count; ``more`` tells that others were left out.
    """
    ranked = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    ranked = ranked.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("pos", "dst")))
    more = ranked.where(F.col("n") == max_children + 1).select(F.col("src").alias("id"), F.lit(True).alias("more"))
    shown = ranked.where(F.col("n") <= max_children)
    level = start.select(F.array("id").alias("path"), "id", F.lit(0).alias("depth"))
    levels = [level]
    for depth in range(1, max_depth + 1):
        step = level.join(shown, level["id"] == shown["src"]).where(~F.array_contains("path", F.col("dst")))
        level = step.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("id"), F.lit(depth).alias("depth"))
        levels.append(level)
    return reduce(DataFrame.union, levels).join(more, "id", "left").select("path", "id", "depth", F.coalesce("more", F.lit(False)).alias("more"))


def discover(links: DataFrame, start: str, max_depth: int = 2, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """Breadth-first discovery from one page.

    ``links`` has src, pos, dst, text. Vertices ``(idx, id, depth)`` are numbered
    in the order they are found: by parent's number, then link position. A page
    is expanded while fewer than ``max_nodes`` are known before its turn, and only
    above ``max_depth``. Edges ``(src_idx, dst_idx, pos, text)`` keep repeats.

    Known vertices are a table that each level adds to; only a level's count comes
    to the driver. Turns are summed over the expanded pages, of which there are at
    most ``max_nodes``.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "discover")
    vertices = spark.createDataFrame([(0, start, 0)], "idx long, id string, depth int")
    frontier, known, edges = vertices, 1, []
    for depth in range(max_depth):
        near = frontier.select(F.col("idx").alias("parent"), F.col("id").alias("src"))
        out = scratch.keep(links.join(near, "src").select("parent", "pos", "dst", "text"), "links")
        first = out.groupBy("dst").agg(F.min(F.struct("parent", "pos")).alias("at"))
        fresh = scratch.keep(first.join(vertices.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst", "at.parent", "at.pos"), "fresh")
        # Parents in turn until the known vertices reach the limit.
        found = near.select("parent").join(fresh.groupBy("parent").agg(F.count("*").alias("n")), "parent", "left")
        before = F.coalesce(F.sum("n").over(W.orderBy("parent").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        turns = scratch.keep(found.withColumn("before", before).where(F.col("before") + known < max_nodes).select("parent"), "turns")
        new = fresh.join(turns, "parent", "left_semi")
        edges.append(out.join(turns, "parent", "left_semi"))
        frontier = scratch.keep(dense_rank_ids(new, ["parent", "pos", "dst"], known).select("id", "dst").select(F.col("id").cast("long").alias("idx"), F.col("dst").alias("id"), F.lit(depth + 1).alias("depth")), "frontier")
        count = frontier.count()
        if not count:
            break
        known += count
        vertices = vertices.union(frontier)
    ids = vertices.select(F.col("idx").alias("dst_idx"), F.col("id").alias("dst"))
    none = links.where("false").select(F.lit(0).cast("long").alias("parent"), "pos", "dst", "text")
    found = reduce(DataFrame.union, edges, none).join(ids, "dst").select(F.col("parent").alias("src_idx"), "dst_idx", "pos", "text")
    return vertices, found


def carry_forward(df: DataFrame, value: Column, partition: list[str], order: list[str], name: str = "carried") -> DataFrame:
    """The last non-null value before each row."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, True).over(w))
