"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

Texts are lower-cased words; shingles are five words, with repeats as weights.
Each document is searched in windows of the items' own sizes. A window and an
item of the same size whose similarity reaches 0.8 share a shingle, so windows
are taken around shingles that some item has; no window elsewhere can match.
A text with fewer words than an item is one window, compared as a whole.
Fingerprints are compared through eight blocks of eight bits: two that differ in
at most RADIUS bits differ in at most RADIUS // 8 in some block, so looking up
each block's neighbours finds every item within the radius. What is found is
verified by the weighted Jaccard similarity of the shingles themselves.

At similarity 0.8 about ten bits differ, with a standard deviation of three;
RADIUS lies four deviations above.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.llm.scratch import Scratch

WIDTH = 5
LEAST = 0.8
RADIUS = 22
BLOCKS = 8
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 1 << 25  # items that are broadcast, and their characters; more are joined by shingles
SIEVE = 22  # bits

WORDS = re.compile(r"\w+").findall
_near = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= RADIUS // BLOCKS) for v in range(256)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the word shingles in order, valid in this process only; of the whole list if it is shorter."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1 if words else 0, len(words) if len(words) < WIDTH else WIDTH, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)]
    return _mixed(out)


def window_fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


class Index:
    """Items by shingle, and by the blocks of their fingerprints within each size."""

    def __init__(self, items: list[tuple]):
        self.items = [(i, words, shingles(words)) for i, text in items if (words := WORDS((text or "").lower()))]
        self.with_shingle: dict[int, set[int]] = defaultdict(set)
        members: dict[int, list[int]] = defaultdict(list)
        for n, (_, words, h) in enumerate(self.items):
            members[len(words)].append(n)
            if len(words) >= WIDTH:
                for x in h.tolist():
                    self.with_shingle[x].add(len(words))
        self.sieve = np.zeros(1 << SIEVE, bool)
        if self.with_shingle:
            self.sieve[np.fromiter(self.with_shingle, np.uint64) >> np.uint64(64 - SIEVE)] = True
        self.sizes = {}
        self.short: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for size, own in members.items():
            if size < WIDTH:
                for n in own:
                    self.short[size][" ".join(self.items[n][1])].append(n)
                continue
            prints = np.concatenate([window_fingerprints(self.items[n][2], len(self.items[n][2])) for n in own])
            self.sizes[size] = np.array(own), prints, [self._buckets(prints[:, b]) for b in range(BLOCKS)]

    @staticmethod
    def _buckets(values: np.ndarray) -> dict[int, np.ndarray]:
        exact = defaultdict(list)
        for at, v in enumerate(values.tolist()):
            exact[v].append(at)
        near: dict[int, list[int]] = defaultdict(list)
        for v, ats in exact.items():
            for w in _near[v].tolist():
                near[w] += ats
        return {v: np.array(ats) for v, ats in near.items()}

    def candidates(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for every item of that size within the radius of the window's fingerprint."""
        own, theirs, blocks = self.sizes[size]
        for at, p in enumerate(prints):
            found = [b[v] for b, v in zip(blocks, p.tolist(), strict=True) if v in b]
            if found:
                ats = np.unique(np.concatenate(found))
                yield from ((at, int(own[k])) for k in ats[np.bitwise_count(theirs[ats] ^ p).sum(1) <= RADIUS])

    def search(self, text: str | None) -> list[tuple]:
        """(item id, similarity, first word, words) of the best window for each item found."""
        words = WORDS((text or "").lower())
        best: dict[int, tuple[float, int]] = {}
        if not words:
            return []
        for size in self.short:
            self._short(words, size, best)
        if len(words) >= WIDTH:
            h = shingles(words)
            hits = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE)])
            places: dict[int, list[int]] = defaultdict(list)
            for at in hits.tolist():
                for size in self.with_shingle.get(int(h[at]), ()):
                    places[size].append(at)
            for size, ats in places.items():
                self._around(h, size, ats, best)
        return [(self.items[n][0], sim, at, min(len(self.items[n][1]), len(words))) for n, (sim, at) in sorted(best.items())]

    def _short(self, words: list[str], size: int, best: dict) -> None:
        """Items shorter than a shingle match as a whole or not at all."""
        for at in range(len(words) - size + 1):
            for n in self.short[size].get(" ".join(words[at : at + size]), ()):
                best.setdefault(n, (1.0, at))

    def _around(self, h: np.ndarray, size: int, ats: list[int], best: dict) -> None:
        """Windows of ``size`` words that hold one of the shingles at ``ats``; the whole of a shorter text."""
        n, start = size - WIDTH + 1, 0
        if len(h) < LEAST * n:
            return
        n = min(n, len(h))
        while start < len(ats):
            end = start + 1
            while end < len(ats) and ats[end] - ats[end - 1] < n and end - start < 1 << 14:
                end += 1
            low, high = max(0, ats[start] - n + 1), min(len(h) - n, ats[end - 1])
            start = end
            if high < low:
                continue
            part = h[low : high + n]
            for at, item in self.candidates(size, window_fingerprints(part, n)):
                sim = similarity(part[at : at + n], self.items[item][2])
                if sim >= LEAST and sim > best.get(item, (0.0, 0))[0]:
                    best[item] = sim, low + at


_indexes: dict[str, Index] = {}


def _index_of(name: str, items: Callable[[], list[tuple]]) -> Index:
    """The index of a broadcast, built once in each worker; only the last one is held."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items())
    return _indexes[name]


def _hit_rows(rows: list[tuple], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*kinds, pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc", "item", "similarity", "first_word", "n_words"])


def _search(docs: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """With broadcast items: one pass over the documents, nothing shuffled."""
    kind = to_arrow_type(items.schema[0].dataType)
    shared, name = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(name, lambda: shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield _hit_rows([(doc, *hit) for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for hit in index.search(text)], (batch.column(0).type, kind))

    return docs.mapInArrow(run, schema)


def _grams(words: list[str], widths: list[int]) -> list[int]:
    """Distinct hashes of the word shingles of given widths, the same in every process."""
    found = {(" ".join(words[at : at + k])) for k in widths for at in range(len(words) - k + 1)}
    return [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) for g in found)]


def _joined(docs: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """With items beyond the bound: pairs that share enough shingles are joined, and each is searched by itself.

    A window as alike as LEAST lacks at most 1 - LEAST of an item's shingles, so it
    has all but that many of its distinct ones; the pairs with fewer are left out.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    number = lambda df, names: scratch.keep(df.toDF(*names).withColumn("no", F.monotonically_increasing_id()), names[0])
    rows, known = number(docs, ["doc", "text"]), number(items, ["item", "item_text"])
    kinds = to_arrow_type(docs.schema[0].dataType), to_arrow_type(items.schema[0].dataType)

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(no, h, max(1, len(own) - int((1 - LEAST) * max(1, len(words) - WIDTH + 1) + 1e-9))) for no, text in zip(*[c.to_pylist() for c in b.columns], strict=True) if (words := WORDS((text or "").lower())) for own in [_grams(words, [min(WIDTH, len(words))])] for h in own]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_no", "gram", "need"])

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = _grams(WORDS((text or "").lower()), list(range(1, WIDTH + 1)))
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(own), pa.int64()), pa.array(own, pa.int64())], names=["doc_no", "gram"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield _hit_rows([(doc, *hit) for doc, text, item, item_text in zip(*[c.to_pylist() for c in whole.slice(at, 256).columns], strict=True) for hit in Index([(item, item_text)]).search(text)], kinds)

    theirs = scratch.keep(known.select("no", "item_text").mapInArrow(item_grams, "item_no long, gram long, need long"), "grams")
    shared = rows.select("no", "text").mapInArrow(doc_grams, "doc_no long, gram long").join(theirs, "gram")
    pairs = scratch.keep(shared.groupBy("doc_no", "item_no").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("doc_no", "item_no"), "pairs")
    both = pairs.join(rows.withColumnRenamed("no", "doc_no"), "doc_no").join(known.withColumnRenamed("no", "item_no"), "item_no")
    return both.select("doc", "text", "item", "item_text").mapInArrow(verify, schema)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: each item a document holds, with its best window.

    Null, empty and wordless texts hold nothing, and such items are in nothing.
    A text with fewer words than an item matches as a whole; n_words is then its own.
    Items of fewer than five words match exactly. The first of equally good
    windows counts. Repeated rows give repeated results. Items are broadcast where
    they are at most ITEMS_AT_ONCE with at most CHARS_AT_ONCE characters; more are
    joined with the documents by their shingles, and none come to the driver.
    """
    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    theirs = items.select(F.col(item_col), F.col(item_text).cast("string"))
    schema = f"doc {docs.schema[id_col].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, similarity double, first_word long, n_words long"
    n, chars = theirs.agg(F.count("*"), F.sum(F.length(theirs[1]))).first()
    small = n <= ITEMS_AT_ONCE and (chars or 0) <= CHARS_AT_ONCE
    found = (_search if small else _joined)(own, theirs, schema)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "similarity", "first_word", "n_words")


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item; rows with a null id stay."""
    return docs.join(contaminated(docs, items, id_col, text_col).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
