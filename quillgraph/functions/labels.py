"""Sequence labels: spans, rendering, padding and Viterbi folds on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = "array<struct<entity:string,type:string>>"


def label_type(label: Column) -> Column:
    return F.substring(label, F.lit(3), F.length(label))


def zipped(tokens: Column, labels: Column) -> Column:
    """Pairs of tokens and labels up to the shorter length."""
    n = F.least(F.size(tokens), F.size(labels))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(labels, F.lit(1), n), lambda t, x: F.struct(t.alias("token"), x.alias("label")))


def decode_spans(tokens: Column, labels: Column) -> Column:
    """Entities of BIOES labels.

    B opens a span and closes an open one; I and E extend an open span of their
    type, E closing it, and are ignored otherwise; S is a span of its own; O
    closes; other labels are ignored.
    """
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(ENTITIES).alias("done"), none.alias("entity"), none.alias("type"))

    def closed(s: Column) -> Column:
        return F.when(s["type"].isNotNull(), F.array_append(s["done"], F.struct(s["entity"].alias("entity"), s["type"].alias("type")))).otherwise(s["done"])

    def state(done: Column, entity: Column, type_: Column) -> Column:
        return F.struct(done.alias("done"), entity.alias("entity"), type_.alias("type"))

    def step(s: Column, x: Column) -> Column:
        kind, type_ = F.substring(x["label"], 1, 2), label_type(x["label"])
        joined = F.concat(s["entity"], x["token"])
        extends = s["type"].isNotNull() & (s["type"] == type_)
        single = F.struct(x["token"].alias("entity"), type_.alias("type"))
        return (
            F.when(kind == "B-", state(closed(s), x["token"], type_))
            .when(kind == "S-", state(F.array_append(closed(s), single), none, none))
            .when((kind == "I-") & extends, state(s["done"], joined, s["type"]))
            .when((kind == "E-") & extends, state(F.array_append(s["done"], F.struct(joined.alias("entity"), type_.alias("type"))), none, none))
            .when(x["label"] == "O", state(closed(s), none, none))
            .otherwise(s)
        )

    return F.aggregate(zipped(tokens, labels), start, step, closed)


def tagged_text(tokens: Column, labels: Column) -> Column:
    """``[token:label] `` for labelled tokens, the token itself for O."""
    one = lambda x: F.when(x["label"] == "O", x["token"]).otherwise(F.concat(F.lit("["), x["token"], F.lit(":"), x["label"], F.lit("] ")))
    return F.array_join(F.transform(zipped(tokens, labels), one), "")


def type_runs(tokens: Column, labels: Column) -> Column:
    """Runs of neighbouring tokens of one type (B, I, E and S alike), with their text; O breaks."""
    kind = "array<struct<type:string,text:string>>"

    def step(s: Column, x: Column) -> Column:
        type_ = F.when(x["label"] != "O", label_type(x["label"]))
        last = F.element_at(s, F.lit(-1))
        same = (F.size(s) > 0) & (last["type"].eqNullSafe(type_))
        grown = F.struct(type_.alias("type"), F.concat(last["text"], x["token"]).alias("text"))
        return F.when(same, F.array_append(F.slice(s, F.lit(1), F.size(s) - 1), grown)).otherwise(F.array_append(s, F.struct(type_.alias("type"), x["token"].alias("text"))))

    grown = F.aggregate(zipped(tokens, labels), F.array().cast(kind), lambda s, x: F.when(F.size(s) == 0, F.array(F.struct(F.when(x["label"] != "O", label_type(x["label"])).alias("type"), x["token"].alias("text")))).otherwise(step(s, x)))
    return F.filter(grown, lambda r: r["type"].isNotNull())


def labels_of_entities(text: Column, entities: Column) -> Column:
    """BIOES labels per character: every occurrence of every entity, later entities over earlier ones.

    Occurrences of one entity do not overlap; an empty entity has none.
    """
    size = F.length(text)
    blank = F.when(size > 0, F.array_repeat(F.lit("O"), size)).otherwise(F.array().cast("array<string>"))

    def with_one(labels: Column, e: Column) -> Column:
        pieces = F.split(text, F.concat(F.lit("\\Q"), e["entity"], F.lit("\\E")), -1)
        n = F.length(e["entity"])
        inner = F.concat(F.array(F.concat(F.lit("B-"), e["type"])), F.array_repeat(F.concat(F.lit("I-"), e["type"]), F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.lit("E-"), e["type"])))
        mark = F.when(n == 1, F.array(F.concat(F.lit("S-"), e["type"]))).otherwise(inner)
        gap = lambda p: F.when(F.length(p) > 0, F.array_repeat(F.lit(""), F.length(p))).otherwise(F.array().cast("array<string>"))
        over = F.flatten(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, mark).otherwise(F.array().cast("array<string>")), gap(p))))
        return F.when(n > 0, F.zip_with(labels, over, lambda old, new: F.when(new == "", old).otherwise(new))).otherwise(labels)

    return F.aggregate(entities, blank, with_one)


def padded(ids: Column, size: Column, fill: int = 0) -> Column:
    return F.concat(ids, F.when(size > F.size(ids), F.array_repeat(F.lit(fill), size - F.size(ids))).otherwise(F.array().cast("array<int>")))


def attention_mask(ids: Column, size: Column) -> Column:
    return padded(F.transform(ids, lambda _: F.lit(1)), size)


def _ends(size: int, scores: list[float] | None) -> list[Column]:
    return [F.lit(float(scores[i]) if scores else 0.0) for i in range(size)]


def viterbi(emissions: Column, transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> Column:
    """Best tag sequence for an array of per-tag scores; transitions are [from][to].

    ``start`` and ``end`` score the first and last tag. Of equal scores the lesser
    tag wins. Empty input gives an empty path.
    """
    tags = range(len(transitions))
    opens, closes = _ends(len(tags), start), _ends(len(tags), end)
    path = "array<struct<score:double,path:array<int>>>"

    def best(options: list[Column]) -> Column:
        out = options[0]
        for o in options[1:]:
            out = F.when(o["score"] > out["score"], o).otherwise(out)
        return out

    def step(s: Column, e: Column) -> Column:
        new = []
        for j in tags:
            top = best([F.struct((s[i]["score"] + F.lit(float(transitions[i][j]))).alias("score"), s[i]["path"].alias("path")) for i in tags])
            new.append(F.struct((top["score"] + e[j]).alias("score"), F.array_append(top["path"], F.lit(j)).alias("path")))
        return F.array(*new)

    first = lambda e: F.array(*[F.struct((opens[j] + e[j]).alias("score"), F.array(F.lit(j)).alias("path")) for j in tags])
    last = lambda s: best([F.struct((s[i]["score"] + closes[i]).alias("score"), s[i]["path"].alias("path")) for i in tags])["path"]
    return F.aggregate(emissions, F.array().cast(path), lambda s, e: F.when(F.size(s) == 0, first(e)).otherwise(step(s, e)), lambda s: F.when(F.size(s) > 0, last(s)).otherwise(F.array().cast("array<int>")))


def path_score(emissions: Column, path: Column, transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> Column:
    """Emissions and transitions along a given path."""
    flat = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in transitions])
    own = F.zip_with(emissions, path, lambda e, j: F.get(e, j))
    moves = F.transform(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), lambda j, i: F.get(F.get(flat, F.get(path, i)), j))
    n = len(transitions)
    ends = F.when(F.size(path) > 0, F.get(F.array(*_ends(n, start)), F.get(path, F.lit(0))) + F.get(F.array(*_ends(n, end)), F.element_at(path, F.lit(-1)))).otherwise(0.0)
    return F.aggregate(F.concat(own, moves), F.lit(0.0), lambda s, x: s + x) + ends


def log_partition(emissions: Column, transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> Column:
    """Log of the summed exponentials of all paths' scores; a path's loss is this less its score."""
    tags = range(len(transitions))
    opens, closes = _ends(len(tags), start), _ends(len(tags), end)

    def log_sum(xs: list[Column]) -> Column:
        top = F.greatest(*xs) if len(xs) > 1 else xs[0]
        return top + F.log(sum((F.exp(x - top) for x in xs), F.lit(0.0)))

    first = lambda e: F.array(*[opens[j] + e[j] for j in tags])
    step = lambda s, e: F.array(*[log_sum([s[i] + F.lit(float(transitions[i][j])) for i in tags]) + e[j] for j in tags])
    return F.aggregate(emissions, F.array().cast("array<double>"), lambda s, e: F.when(F.size(s) == 0, first(e)).otherwise(step(s, e)), lambda s: F.when(F.size(s) > 0, log_sum([s[i] + closes[i] for i in tags])).otherwise(F.lit(0.0)))


def palette(types: list[str]) -> dict[str, str]:
    """Evenly spaced hues, as hex colours, for entity types in ascending order."""
    import colorsys

    names = sorted(types)
    return {t: "#" + "".join(f"{round(v * 255):02x}" for v in colorsys.hls_to_rgb(i / max(1, len(names)), 0.6, 0.65)) for i, t in enumerate(names)}
