"""SimHash near-duplicates: fingerprints, BK-tree shards and components.

Two fingerprints at most two bits apart agree on at least six of eight bytes, so
each distinct fingerprint goes to the 28 shards named by six of its bytes, and
every link has a shard that holds both ends. A shard fixes 48 bits: it never has
more than 65,536 distinct fingerprints, and each has at most 136 neighbours in
it, however large a group of copies is. Each shard gets a BK-tree whose search
follows only the edges within the radius. The trees live in the tasks that hold
their shards: broadcasting trees over every fingerprint of the corpus would have
no size bound.

The pipeline's stage asks for more than the query: five-word shingles alike by
0.8 or more, where some ten bits differ and no block of bits need agree, so
there the shards are named by MinHash bands. Again each shard gets BK-trees, and
only pairs that their search finds within NEAR_RADIUS are verified on the
shingles themselves. A search of that radius follows most edges of a tree, so a
large shard is dealt to trees of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bktree import Forest, least_linked, ranges
from quillgraph.llm.components import star_forest
from quillgraph.llm.scratch import Scratch

SEED = 42
RADIUS = 2
BLOCK = 1 << 16
SHARDS_AT_ONCE = 1 << 18
WIDTH = 5  # words, of the stage's shingles
LEAST = 0.8
NEAR_RADIUS = 31  # a pair alike by 0.8 lies beyond it with a chance of 2e-8 (four shingles and five), of 4e-10 for all others
STAR_TEXTS = 64  # texts of a band in one tree of the first round
TREE_TEXTS = 2048  # and of the second, without those that ask
TREES_AT_ONCE = 1 << 13  # rows, about, of the stage's trees that are searched together
FEW = 32  # texts of a band outside its largest component whose pairs are emitted; more are compared in blocks
BLOCK_TEXTS = 512
BANDS, ROWS = 32, 4  # a pair alike by 0.8 shares no band with a chance of 5e-8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; 0 for null or wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        spaced = join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(part) - width + 1].tolist()
        h = np.array([digest(spaced[s:e], SEED) for s, e in zip(start, end[width - 1 :].tolist(), strict=True)], np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, fp)`` for each row; fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string")).mapInArrow(_fingerprints, f"doc {kind}, fp long")


def _linked(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
    alone = np.ones(len(shard), bool)
    same = (shard[1:] == shard[:-1]).all(axis=1)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    fp, shard = fp[~alone], shard[~alone]
    if not len(fp):
        return None
    of = np.cumsum(np.r_[True, (shard[1:] != shard[:-1]).any(axis=1)])
    forest = Forest(fp.view(np.uint64), of)
    a, b = [], []
    for at in range(0, len(fp), BLOCK):
        x, y = forest.within(np.arange(at, min(at + BLOCK, len(fp))), RADIUS)
        a.append(x)
        b.append(y)
    label = least_linked(len(fp), np.concatenate(a), np.concatenate(b))
    other = np.flatnonzero(label != np.arange(len(fp)))
    x, y = fp[other], fp[label[other]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first two columns, as columns of about ``most`` rows that part no group of these two."""
    rest: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest else cols
        if len(rest[0]) < most:
            continue
        last = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
        cut = int(np.argmax(last))
        if cut:
            yield [c[:cut] for c in rest]
        rest = [c[cut:] for c in rest]
    if rest and len(rest[0]):
        yield rest


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; whole shards are searched, about SHARDS_AT_ONCE rows at a time."""
    for k, block, fp in _whole(batches, SHARDS_AT_ONCE):
        if out := _linked(np.stack([k, block], 1), fp):
            yield out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` longs to links ``(u, v)``, u > v, that join what lies within the radius.

    Each shard gives a star of at most one link per fingerprint, not its pairs.
    """
    masks = [sum(0xFF << 8 * b for b in bytes_) for bytes_ in combinations(range(8), 6)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shards = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("block")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(shards).alias("s")).select("s.k", "s.block", "fp")
    return rows.repartition("k", "block").sortWithinPartitions("k", "block", "fp").mapInArrow(_search_shards, "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    Texts whose fingerprints differ in RADIUS or fewer bits are linked;
    component_id is the least id reachable. Null and wordless texts have the
    fingerprint zero and link like any other. Repeated rows give repeated rows.
    A null id never names a component unless its members have no other id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(with_fingerprints(docs, id_col, text_col), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    stars = star_forest(fingerprint_links(least.select("fp")), scratch)
    rooted = least.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    class_of = scratch.keep(rooted.join(named, "root").select("fp", "component_id"), "classes")
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(class_of, "fp").select(F.col("doc").alias(id_col), hex_.alias("fingerprint"), "component_id")


def near_shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the five-word shingles, those that repeat told apart by number; none for wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    width = min(WIDTH, len(words))
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = np.full(len(words) - width + 1 if words else 0, width, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k : k + len(out)])
    out.sort()
    first = np.r_[True, out[1:] != out[:-1]] if len(out) else np.zeros(0, bool)
    if not first.all():
        at = np.arange(len(out))
        out = np.sort(_mixed(out + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _print_of(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        total += np.unpackbits(h[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def _key(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes(), SEED)


_factors = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(h: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 1 << 12):
        least = np.minimum(least, (h[at : at + (1 << 12)] * _factors).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out + least[k::ROWS])
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            rows = []
            for x in batch.column(1):
                h = near_shingles(x.as_py())
                rows.append((_key(h), _print_of(h), len(h), _bands(h)))
            keys, prints, sizes, bands = zip(*rows, strict=True)
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64).ravel())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(keys), signed(prints), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, signed(bands))], names=["doc", "key", "fp", "size", "bands"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct shingles have a similarity of LEAST or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, text)`` to the key's shingles; a row whose text is another one of the same id is left out."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            keys, found = [], []
            for key, text in zip(*whole.slice(at, 1024).columns, strict=True):
                h = near_shingles(text.as_py())
                if np.uint64(_key(h)).astype(np.int64) == key.as_py():
                    keys.append(key.as_py())
                    found.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["key", "shingles"])


def near_pairs(tree: np.ndarray, fp: np.ndarray, size: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (q, n), n < q, of one tree: fingerprints within the radius, as BK-trees find them, and sizes that fit 0.8.

    ``asks`` marks the q to search for. A tree holds each of its fingerprints once.
    """
    order = np.lexsort((fp, tree))
    first = np.r_[True, (np.diff(tree[order]) != 0) | (fp[order][1:] != fp[order][:-1])]
    start = np.flatnonzero(first)
    count = np.diff(np.r_[start, len(order)])
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(first) - 1
    forest = Forest(fp[order[start]].view(np.uint64), tree[order[start]])
    asked, found = forest.within(np.unique(node[asks]), radius, every=True)
    q, found = order[ranges(start[asked], count[asked])], np.repeat(found, count[asked])
    q, found = q[asks[q]], found[asks[q]]
    q, n = np.repeat(q, count[found]), order[ranges(start[found], count[found])]
    ok = (n < q) & (np.minimum(size[q], size[n]) >= LEAST * np.maximum(size[q], size[n]))
    return q[ok], n[ok]


def _search_trees(batches: Iterator[pa.RecordBatch], radius: int, once: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``(band, part, asks, key, fp, size[, label])`` sorted by the first four to pairs of keys that differ in label.

    A part of a band is a tree; ``once`` gives each row that asks its first pair only.
    """
    for band, part, asks, key, fp, size, *label in _whole(batches, TREES_AT_ONCE):
        tree = np.cumsum(np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])])
        q, n = near_pairs(tree, fp, size, asks, radius)
        of = label[0] if label else key
        apart = of[q] != of[n]
        q, n = q[apart], n[apart]
        if once:
            order = np.lexsort((n, q))
            q, n = q[order], n[order]
            first = np.r_[True, q[1:] != q[:-1]][: len(q)]
            q, n = q[first], n[first]
        x, y = key[q], key[n]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])


def _tree_pairs(rows: DataFrame, everywhere: Column, asks: Column, texts: int, once: bool) -> DataFrame:
    """``(u, v)``, u > v, that BK-trees find among the rows ``(band, key, fp, size, total[, label])`` of each band.

    A band is dealt to trees of about ``texts`` rows; rows that are ``everywhere`` stand in each of them.
    """
    parts = F.ceil(F.col("total") / texts).cast("int")
    dealt = F.when(everywhere, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), parts).cast("int")))
    own = rows.select("band", F.explode(dealt).alias("part"), asks.alias("asks"), "key", "fp", "size", *[c for c in rows.columns if c == "label"])
    trees = own.repartition("band", "part").sortWithinPartitions("band", "part", "asks", "key")
    return trees.mapInArrow(partial(_search_trees, radius=NEAR_RADIUS, once=once), "u long, v long").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def block_links(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left, in right) of all pairs with a similarity of LEAST or more, by counts of shared shingles.

    ``near`` marks the pairs to count, all by default.
    """
    size = np.array([len(h) for h in right], np.int64)
    owner = np.repeat(np.arange(len(right)), size)
    every = np.concatenate([*right, np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for at, h in enumerate(left):
        if near is not None and not near[at].any():
            continue
        both = np.zeros(len(right), np.int64)
        for part in range(0, len(h), 1 << 12):
            low, high = (np.searchsorted(every, h[part : part + (1 << 12)], side) for side in ("left", "right"))
            n = high - low
            both += np.bincount(owner[np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())], minlength=len(right))
        like = both >= LEAST * (len(h) + size - both)
        hit = np.flatnonzero(like if near is None else like & near[at])
        found.append((np.full(len(hit), at), hit))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _verify_blocks(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(band, i, j, block, key, fp, shingles)`` sorted by the first three: a star of links for each pair of blocks.

    A BK-tree over both blocks finds the pairs within the radius, their shingles decide.
    """
    now, sides = None, ([], [])

    def done() -> pa.RecordBatch:
        one = now[1] == now[2]
        texts = sides[0] + sides[1]
        keys, prints = (np.array([t[k] for t in texts], np.int64) for k in (0, 1))
        h = [t[2] for t in texts]
        mid = 0 if one else len(sides[0])
        q, n = near_pairs(np.zeros(len(h), np.int64), prints, np.array([len(x) for x in h]), np.arange(len(h)) >= mid, radius)
        near = np.zeros((len(h) if one else mid, len(h) - mid), bool)
        across = n < len(near)
        near[n[across], q[across] - mid] = True
        a, b = block_links(h[: len(near)], h[mid:], near)
        label = least_linked(len(keys), a, b + mid)
        other = np.flatnonzero(label != np.arange(len(keys)))
        x, y = keys[other], keys[label[other]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            for band, i, j, block, key, fp, shingles in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (band, i, j) != now:
                    if now:
                        yield done()
                    now, sides = (band, i, j), ([], [])
                sides[block != i].append((key, fp, np.frombuffer(shingles, np.uint64)))
    if now:
        yield done()


class _Linker:
    """Verifies pairs of text keys, and names the components of the links found so far."""

    def __init__(self, own: DataFrame, classes: DataFrame, scratch: Scratch):
        self.own, self.classes, self.scratch = own, classes, scratch
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        """``(u, v)``, u > v, without repeats, as the trees found them: those not yet tested are compared on their shingles."""
        # Pairs and shingles are written before they are joined, so that a hub's rows can be split.
        open_ = self.scratch.keep(pairs if self.tested is None else pairs.join(self.tested, ["u", "v"], "left_anti"), "pairs")
        self.tested = open_ if self.tested is None else self.tested.union(open_)
        shingles = self._shingles(open_.select(F.col("u").alias("key")).union(open_.select(F.col("v").alias("key"))))
        side = lambda name: shingles.select(F.col("key").alias(name), F.col("shingles").alias(f"{name}_shingles"))
        both = open_.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_shingles", "v_shingles")
        self._keep(both.mapInArrow(_verify, "u long, v long"))
        self.scratch.drop(shingles)

    def add_blocks(self, members: DataFrame) -> None:
        """All pairs of the members ``(band, key, fp, total)`` of each band: in blocks of about BLOCK_TEXTS texts, two to a task."""
        blocks = F.ceil(F.col("total") / BLOCK_TEXTS).cast("int")
        own = members.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = self.scratch.keep(own.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "fp"), "blocks")
        shingles = self._shingles(members.select("key"))
        rows = dealt.join(shingles, "key").select("band", "i", "j", "block", "key", "fp", "shingles").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        self._keep(rows.mapInArrow(partial(_verify_blocks, radius=NEAR_RADIUS), "u long, v long").distinct())
        self.scratch.drop(shingles, dealt)

    def _shingles(self, keys: DataFrame) -> DataFrame:
        # Written, its size is known: Spark broadcasts it below its threshold, and shuffles texts only beyond.
        wanted = self.scratch.keep(self.classes.join(keys.distinct(), "key").select(F.col("least").alias("doc"), "key"), "wanted")
        texts = self.own.join(wanted, "doc").select("key", "text")
        return self.scratch.keep(texts.mapInArrow(_shingle_rows, "key long, shingles binary").dropDuplicates(["key"]), "shingles")

    def _keep(self, found: DataFrame) -> None:
        links = self.scratch.keep(found, "links")
        self.links = links if self.links is None else self.links.union(links)

    def labels(self) -> DataFrame:
        """``(key, label)`` for keys that are not the least of their component."""
        return star_forest(self.links, self.scratch).select(F.col("u").alias("key"), F.col("v").alias("label"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, component_id)``, one row for each distinct text of an id; rows with a null id have none.

    Texts whose bags of five-word shingles are alike by LEAST or more (weighted
    Jaccard) are linked. Candidates share a shard, named by a MinHash band, and are found
    by BK-trees over the shard's fingerprints with a search of radius NEAR_RADIUS; each
    is verified on the shingles. A band's texts are never gathered, but dealt to trees:

    1. trees of about STAR_TEXTS, which all hold the band's least text; each text is
       verified with the first that its search finds;
    2. in bands that still hold several components, the texts outside the band's largest
       one search all trees of the band, of about TREE_TEXTS; what they find in other
       components is verified. Bands with more than FEW such texts are searched and
       verified in blocks, which emit a row per text and block, not pairs.

    After the second round every pair of a band that lies within the radius is compared or
    in one component, and a large group of copies costs a pair or two for each text. Only
    a band of many texts that are not alike (0.5 to 0.8, say) costs comparisons by the
    square of its size; they are spread over its blocks.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep(own.mapInArrow(_sketches, f"doc {kind}, key long, fp long, size long, bands array<long>"), "sketches")
    classes = scratch.keep(rows.groupBy("key").agg(F.min("doc").alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")]), "texts")
    shards = classes.select("key", "fp", "size", F.explode("bands").alias("band"))
    least = scratch.keep(shards.groupBy("band").agg(F.min("key").alias("m"), F.count("*").alias("total")).where("total > 1"), "shards")
    shared = scratch.keep(shards.join(least, "band"), "shared")
    linker = _Linker(own, classes, scratch)
    linker.add(_tree_pairs(shared, F.col("key") == F.col("m"), F.col("key") != F.col("m"), STAR_TEXTS, once=True))
    tagged = shared.join(linker.labels(), "key", "left").withColumn("label", F.coalesce("label", "key"))
    parts = scratch.keep(tagged.groupBy("band", "label").agg(F.count("*").alias("n")), "parts")
    mixed = parts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), (F.sum("n") - F.max("n")).alias("few")).where("labels > 1").drop("labels")
    apart = scratch.keep(tagged.join(mixed, "band"), "apart")
    wide, narrow = apart.where(F.col("few") > FEW), apart.where(F.col("few") <= FEW)
    if not wide.isEmpty():
        linker.add_blocks(wide.select("band", "key", "fp", "total"))
    if not narrow.isEmpty():
        few = F.col("label") != F.col("most")
        linker.add(_tree_pairs(narrow, few, few, TREE_TEXTS, once=False))
    label = linker.labels()
    rooted = classes.select("key", "least").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = scratch.keep(rooted.groupBy("label").agg(F.min("least").alias("component_id")), "names")
    return rows.select("doc", "key").distinct().join(rooted.join(named, "label").select("key", "component_id"), "key").select("doc", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's least (see near_components); of rows that share it, the least by all columns.

    Rows with a null id stay. Columns are unchanged. Ids that go, and ids of several
    rows, are written and joined, by broadcast where Spark finds them small.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    named = near_components(docs, id_col, text_col).groupBy(F.col("doc").alias(id_col)).agg(F.bool_or(F.col("doc") == F.col("component_id")).alias("stays"))
    gone = scratch.keep(named.where("not stays").select(id_col), "gone")
    again = scratch.keep(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "again")
    rows = docs.join(gone, id_col, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = rows.join(again, id_col, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min(F.struct(*columns)).alias("__row")).select("__row.*")
    return rows.join(again, id_col, "left_anti").select(*columns).unionByName(first)
