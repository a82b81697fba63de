"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

All in DataFrame functions. Trees grow level by level from histograms: one
aggregation of gradients over (node, feature, bin), whose few rows the driver
turns into splits. The labelled URLs are first summed over equal binned features,
in a table of bounded size. The trees become one SQL expression for scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.scratch import Scratch

BINS, TREES, DEPTH, RATE, RIDGE = 16, 12, 3, 0.4, 1.0
SAMPLE = 20_000  # labelled URLs learned from, about
WEIGHT = 20  # labelled URLs that the overall rate counts for in a suffix's rate
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix, like ``example.net/en/``."""

    text: str
    block: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def with_host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both empty for null and for urls without ``://``."""
    after = F.when(F.instr(url_col, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_of(rules: list[Rule]) -> Column:
    """The longest fitting rule's text over ``host`` and ``path``, or null; of equally long ones the lesser text."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def suffix() -> Column:
    return F.regexp_extract("host", r"([^.:]*)(:\d+)?$", 1)


def lexical(url_col: str = "url") -> dict[str, Column]:
    """Numbers read off a url and its host and path."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    share = lambda s, pattern: F.coalesce(F.try_divide(count(s, pattern), F.length(s)), F.lit(0.0))
    repeats = F.transform(F.array_distinct(F.split(host, "")), lambda c: F.length(host) - F.length(F.replace(host, c)))
    log_sum = F.aggregate(repeats, F.lit(0.0), lambda s, k: s + F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0))
    entropy = F.when(F.length(host) > 0, F.log2(F.length(host).cast("double")) - log_sum / F.length(host)).otherwise(0.0)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_depth": count(host, r"\."),
        "path_depth": count(path, "/"),
        "host_digits": share(host, "[0-9]"),
        "path_digits": share(path, "[0-9]"),
        "hyphens": count(host, "-"),
        "entropy": entropy,
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
    }


def _binned(edges: dict[str, list[float]]) -> dict[str, Column]:
    return {n: sum(((F.col(n) > F.lit(e)).cast("int") for e in es), F.lit(0)) for n, es in edges.items()}


class Trees:
    """Boosted trees: each maps a node (1 at the root, 2n and 2n+1 below n) to a split or a leaf."""

    def __init__(self, start: float, suffixes: DataFrame | None, overall: float, edges: dict[str, list[float]]):
        self.start, self.suffixes, self.overall, self.edges = start, suffixes, overall, edges
        self.trees: list[tuple[dict[int, tuple[str, int]], dict[int, float]]] = []

    def with_suffix_rate(self, df: DataFrame, half: Column | None = None) -> DataFrame:
        """Adds ``suffix_rate`` to rows with ``__suffix``; with ``half`` (0 or 1) the rate over the other half's labels.

        The suffixes are those of the labelled sample, so SAMPLE bounds what is broadcast.
        """
        if self.suffixes is None:
            return df.withColumn("suffix_rate", F.lit(self.overall)).drop("__suffix")
        one = lambda k: tuple(F.coalesce(c, F.lit(0)) for c in (f"n{k}", f"bad{k}"))
        (n0, bad0), (n1, bad1) = one(0), one(1)
        n, bad = (n0 + n1, bad0 + bad1) if half is None else (F.when(half == 0, n1).otherwise(n0), F.when(half == 0, bad1).otherwise(bad0))
        rows = df.join(F.broadcast(self.suffixes), "__suffix", "left")
        return rows.withColumn("suffix_rate", (bad + WEIGHT * self.overall) / (n + WEIGHT)).drop("__suffix", "n0", "bad0", "n1", "bad1")

    def _node(self, splits: dict[int, tuple[str, int]], leaves: dict[int, float], at: int = 1) -> Column:
        if at in splits:
            name, bin_ = splits[at]
            return F.when(F.col(name) <= bin_, self._node(splits, leaves, 2 * at)).otherwise(self._node(splits, leaves, 2 * at + 1))
        return F.lit(leaves.get(at, 0.0))

    def margin(self) -> Column:
        """Over binned features."""
        return sum((self._node(*t) for t in self.trees), F.lit(self.start))

    def place(self, splits: dict[int, tuple[str, int]], at: int = 1) -> Column:
        """The node that a row has come to in a growing tree."""
        if at not in splits:
            return F.lit(at)
        name, bin_ = splits[at]
        return F.when(F.col(name) <= bin_, self.place(splits, 2 * at)).otherwise(self.place(splits, 2 * at + 1))


def _grow(model: Trees, rows: DataFrame) -> None:
    """Adds a tree to the model, from rows of binned features with ``label`` and ``n``."""
    names = list(model.edges)
    p = 1 / (1 + F.exp(-F.col("margin")))
    rows = rows.withColumn("margin", model.margin()).withColumns({"g": F.col("n") * (p - F.col("label")), "h": F.col("n") * p * (1 - p)})
    splits: dict[int, tuple[str, int]] = {}
    leaves: dict[int, float] = {}
    for depth in range(DEPTH + 1):
        level = range(1 << depth, 2 << depth)
        features = F.posexplode(F.array(*[F.col(c) for c in names])) if depth < DEPTH else F.posexplode(F.array(F.lit(0)))
        parts = rows.select(model.place(splits).alias("node"), "g", "h", features.alias("feature", "bin")).where(F.col("node").isin(*level))
        found: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for node, feature, bin_, g, h in sorted(parts.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h")).collect()):
            found.setdefault(node, {}).setdefault(feature, {})[bin_] = (g, h)
        for node, by_feature in found.items():
            total_g, total_h = (math.fsum(v[i] for v in by_feature[0].values()) for i in (0, 1))
            best = (1e-6, None)
            for feature, bins in by_feature.items() if depth < DEPTH else ():
                left_g = left_h = 0.0
                for bin_, (g, h) in sorted(bins.items())[:-1]:
                    left_g, left_h = left_g + g, left_h + h
                    gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                    if gain > best[0] + 1e-9:
                        best = gain, (names[feature], bin_)
            if best[1]:
                splits[node] = best[1]
            else:
                leaves[node] = -RATE * total_g / (total_h + RIDGE)
        if not any(n in splits for n in level):
            break
    model.trees.append((splits, leaves))


def train(labelled: DataFrame, url_col: str = "url", id_col: str = "page_id") -> Trees:
    """From rows with host, path, url and a 0/1 ``label`` (1: block), about SAMPLE of them by a hash of the id.

    A row's suffix rate is learned from the other half of the sample, so that no
    label is among its own features.
    """
    counts = labelled.agg(F.count("*"), F.sum("label")).first()
    if not counts[0]:
        return Trees(-1.0, None, 0.0, {})
    scratch = Scratch(labelled.sparkSession, "urls")
    draw = F.xxhash64(F.lit(29), id_col, url_col)
    part = labelled.where(F.pmod(draw, F.lit(1_000_000)) < -(-1_000_000 * SAMPLE // counts[0]))
    overall = counts[1] / counts[0]
    odds = min(max(overall, 1e-3), 1 - 1e-3)
    half = F.pmod(F.shiftright(draw, 24), F.lit(2))
    rows = scratch.keep(part.select(*[c.alias(n) for n, c in lexical(url_col).items()], suffix().alias("__suffix"), half.alias("half"), "label"), "sample")
    count = lambda k, c: F.sum(F.when(F.col("half") == k, c).otherwise(0))
    suffixes = rows.groupBy("__suffix").agg(*[count(k, c).alias(f"{n}{k}") for k in (0, 1) for n, c in (("n", F.lit(1)), ("bad", F.col("label")))])
    model = Trees(math.log(odds / (1 - odds)), scratch.keep(suffixes.coalesce(1), "suffixes"), overall, {})
    plain = scratch.keep(model.with_suffix_rate(rows, F.col("half")).drop("half"), "features")
    names = [*lexical(url_col), "suffix_rate"]
    cuts = plain.agg(*[F.percentile_approx(n, [i / BINS for i in range(1, BINS)]) for n in names]).first()
    model.edges = {n: sorted(set(c or [])) for n, c in zip(names, cuts, strict=True)}
    binned = plain.select(*[c.alias(n) for n, c in _binned(model.edges).items()], "label")
    # At most SAMPLE rows, read by every level of every tree.
    bins = scratch.keep(binned.groupBy(*names, "label").agg(F.count("*").alias("n")).coalesce(1), "bins").coalesce(1).persist()
    for _ in range(TREES):
        _grow(model, bins)
    bins.unpersist()
    return model


def with_block_score(df: DataFrame, model: Trees, url_col: str = "url") -> DataFrame:
    """Adds ``block_score``, 0 to 1, to rows with host and path."""
    own = [F.col(f"`{c}`") for c in df.columns]
    raw = df.withColumn("__row", F.struct(*own)).select("__row", suffix().alias("__suffix"), *[c.alias(n) for n, c in lexical(url_col).items()])
    binned = model.with_suffix_rate(raw).select("__row", *[c.alias(n) for n, c in _binned(model.edges).items()])
    return binned.select("__row.*", (1 / (1 + F.exp(-model.margin()))).alias("block_score"))


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Adds host, path, rule, verdict and block_score. Urls that rules decide are the labels learned from.

    Null and empty urls have no rule and are scored like any other. Without any
    labelled url everything else is allowed. Columns of these names are replaced.
    """
    base = pages.drop("host", "path", "rule", "verdict", "block_score")
    rows = with_host_and_path(base, url_col).withColumn("rule", rule_of(rules))
    blocked = F.col("rule").isin([r.text for r in rules if r.block])
    model = train(rows.where(F.col("rule").isNotNull()).select(id_col, url_col, "host", "path", blocked.cast("int").alias("label")), url_col, id_col)
    verdict = F.when(F.coalesce(blocked, F.col("block_score") >= 0.5), "block").otherwise("allow")
    return with_block_score(rows, model, url_col).withColumn("verdict", verdict)
