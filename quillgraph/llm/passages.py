"""Repeated passages: suffix buckets refined on the bucket pointers of later offsets.

A byte goes if some LENGTH-byte string that covers it also starts elsewhere. Each
LENGTH-byte window has an anchor: its leftmost GRAM-byte string of least hash.
Equal windows have equal anchors at equal places, so an anchor's string is the
first bucket of the suffixes that start near it:

1. Buckets of one suffix are finished: nothing in them repeats. Only counts are
   shuffled for this, no text.
2. Anchors whose whole surroundings (all windows that chose them) are equal in
   two places are finished too: all those windows repeat.
3. A bucket of more than WIDEST classes of surroundings is split, not gathered:
   its windows are quartered by how far they start before the anchor. All windows
   of a quarter share more bytes than the anchor, and the hash of these is the
   next bucket. Quarters that are still too wide are quartered again; after four
   times a bucket is one string, so no task ever holds a wide one.
4. The other buckets are refined with their bytes in one task each, by bucket
   pointers (see refine), and strings are compared as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.scratch import Scratch

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # places of an anchor in its window
SEGMENT = 1 << 20  # window starts handled at once in a long text
WIDEST = 1024  # classes of a bucket refined in one task, about 400 kB of text; wider ones are split
REFINED_AT_ONCE = 1 << 18  # bytes
TURNS = 4  # parts of a pass over the buckets; each part sees the pointers that those before it renewed
ENDED = 1 << 14  # added to the depth of suffixes that are compared up to their text's end

_rng = np.random.default_rng(7001)
SIGNS = _rng.integers(1, 1 << 63, (2, 256), np.uint64)
BASES = [int(x) | 5 for x in _rng.integers(1 << 40, 1 << 62, 2)]


_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of a base and of its inverse. A worker holds as many as its longest text needed."""
    if which not in _powers_of or len(_powers_of[which][0]) < size:
        size, base, both = min(1 << size.bit_length(), SEGMENT + LENGTH + 1), BASES[which], []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers_of[which] = both[0], both[1]
    return _powers_of[which]


class Hashes:
    """Hashes of any substring of at most SEGMENT + LENGTH bytes, from running sums modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SIGNS[which][data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """For each anchor: hash of its string, hash of its surroundings, its place, first and last window start."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8)[at : at + SEGMENT + LENGTH - 1]
        grams = len(data) - GRAM + 1
        place = np.arange(grams)
        hashes = Hashes(data, 0)
        gram = hashes.of(place, place + GRAM)
        least = (gram & np.uint64(0xFFFFFFFFFF000000)) | place.astype(np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := SPAN - width:
            least = np.minimum(least[:-rest], least[rest:])
        chosen = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        high = np.r_[low[1:], len(chosen)] - 1
        out.append((gram[chosen[low]], Hashes(data, 1).of(low, high + LENGTH), at + chosen[low], at + low, at + high))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 3))


def _first_buckets(data: np.ndarray, room: np.ndarray, spare: int) -> tuple[np.ndarray, int]:
    """The first bytes at each place as a number of at most 63 - ``spare`` bits, and how many bytes these are.

    Bytes are numbered in order over those at hand; a text's end comes before all of them.
    """
    there = np.bincount(data, minlength=256) > 0
    rank = np.cumsum(there).astype(np.uint64)[data]
    bits = int(there.sum()).bit_length()
    width = max(1, (63 - spare) // bits)
    key = np.zeros(len(data), np.uint64)
    for k in range(width):
        n = max(0, len(data) - k)
        key <<= np.uint64(bits)
        key[:n] |= np.where(room[:n] > k, rank[k:], np.uint64(0))
    return key, width


def _turned(key: np.ndarray, spare: int, used: int) -> np.ndarray:
    """An order that sorts keys of ``used`` bits; packed with their places (``spare`` bits), where both fit in one number."""
    if spare + used > 63:
        return np.argsort(key)
    packed = key.astype(np.uint64) << np.uint64(spare) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << spare) - 1)).astype(np.int64)


def refine(data: np.ndarray, starts: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at each start also stand at another start.

    Bucket-pointer refinement. ``data`` holds texts end to end, ``text_of`` the number
    of each byte's text. A suffix's pointer is the first place of its bucket in the
    order, so pointers compare as suffixes do. A bucket of depth d is sorted by the
    pointers of its suffixes' offsets d; a part that shares one pointer gains the depth
    of the bucket pointed to. Pointers are renewed in place, TURNS times in each pass,
    and later buckets sort by the renewed ones. Buckets of LENGTH bytes or more are
    done. Neighbours of different buckets that may still share LENGTH bytes are
    compared as bytes. A suffix never reaches into the next text.
    """
    size = len(data)
    repeated = np.zeros(size, bool)
    if not size:
        return repeated[starts]
    last = np.flatnonzero(np.r_[text_of[1:] != text_of[:-1], True])
    room = ((last + 1)[np.searchsorted(last, np.arange(size))] - np.arange(size)).astype(np.int32)  # bytes to the end of the text
    spare = size.bit_length()
    key, width = _first_buckets(data, room, spare)
    order = _turned(key, spare, 63 - spare).astype(np.int32)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    pointer, depth = np.empty(size, np.int32), np.where(room >= width, width, ENDED + room).astype(np.int16)
    pointer[order] = np.flatnonzero(first).astype(np.int32)[np.cumsum(first) - 1]
    known = np.zeros(size, np.int16)  # bytes that neighbours of different buckets share at least, and at most
    most = np.full(size, width - 1, np.int16)
    while True:
        inside = ~(first & np.r_[first[1:], True])
        live = np.flatnonzero(inside & (depth[order] < LENGTH))
        if not len(live):
            break
        heads = np.flatnonzero(first[live])
        cuts = sorted({0, len(live)} | {int(heads[i]) for i in np.searchsorted(heads, np.arange(1, TURNS) * len(live) // TURNS) if i < len(heads)})
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            at = live[low:high]
            own = order[at]
            d = depth[own]
            later = own + d
            there = room[own] > d
            later[~there] = 0
            key = pointer[own].astype(np.int64) << spare | np.where(there, pointer[later].astype(np.int64) + 1, 0)
            gained = np.minimum(d + np.where(there, depth[later], ENDED), ENDED + LENGTH).astype(np.int16)
            turn = _turned(key, spare, 2 * spare)
            own, key, d = own[turn], key[turn], d[turn]
            order[at] = own
            head = np.r_[True, key[1:] != key[:-1]]
            gained = gained[turn]
            fresh = np.flatnonzero(head & ~first[at])
            known[at[fresh]] = d[fresh]
            most[at[fresh]] = np.minimum(gained[fresh], gained[fresh - 1]) - 1
            first[at] = head
            pointer[own] = at[head].astype(np.int32)[np.cumsum(head) - 1]
            depth[own] = gained
    same = np.flatnonzero(~first)
    same = same[room[order[same]] >= LENGTH]
    repeated[order[same]] = repeated[order[same - 1]] = True
    near = np.flatnonzero(first[1:] & (most[1:] >= LENGTH)) + 1
    near = near[(room[order[near]] >= LENGTH) & (room[order[near - 1]] >= LENGTH)]
    near = near[np.argsort(known[near], kind="stable")]
    for low in range(0, len(near), 1 << 12):
        at = near[low : low + (1 << 12)]
        a, b = order[at].astype(np.int64), order[at - 1].astype(np.int64)
        along = np.arange(int(known[at[0]]), LENGTH)
        equal = (data[a[:, None] + along] == data[b[:, None] + along]).all(axis=1)
        repeated[a[equal]] = repeated[b[equal]] = True
    return repeated[starts]


def _runs(low: np.ndarray, flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners and byte ranges of the runs of flagged window starts."""
    at = np.flatnonzero(flags)
    first = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])] if len(at) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(at) else first
    return owner[at[first]], low[at[first]], low[at[last]] + LENGTH


def _windows(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low to high: the range of each start, and the start's number in it."""
    n = high - low + 1
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner]


def _batch(cols: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols.values()], names=list(cols))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grow = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            found = [anchors(grow.decompress(x.as_py())) for x in b.column(1)]
            gram, around, place, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = np.repeat(b.column(0).to_numpy(), [len(x[0]) for x in found])
            yield _batch({"gram": (gram.view(np.int64), pa.int64()), "around": (around.view(np.int64), pa.int64()), "row": (rows, pa.int64()), "lead": ((place - low).astype(np.int16), pa.int16()), "low": (low.astype(np.int32), pa.int32()), "high": (high.astype(np.int32), pa.int32())})


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text and its open anchors to one row of bytes for each anchor."""
    grow = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            out: list[tuple] = []
            for row, packed, places in zip(*[c.to_pylist() for c in whole.slice(at, 256).columns], strict=True):
                text = grow.decompress(packed)
                out += [(p["gram"], p["wide"], row, p["low"] + p["lead"], p["low"], p["high"], p["open"], text[p["low"] : p["high"] + LENGTH]) for p in places]
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield _batch(dict(zip(("gram", "wide", "row", "place", "low", "high", "open", "bytes"), zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True), strict=True)))


def _refine_rows(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(rows)
    row, low, high = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "low", "high"))
    parts = t.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = high - low + LENGTH
    begin = np.cumsum(size) - size
    owner, number = _windows(low, high)
    repeated = refine(data, begin[owner] + number, np.repeat(np.arange(len(size)), size))
    of, start, end = _runs(low[owner] + number, repeated & t.column("open").to_numpy()[owner], owner)
    return _batch({"row": (row[of], pa.int64()), "start": (start, pa.int64()), "end": (end, pa.int64())})


def _refine_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; whole buckets are refined, about REFINED_AT_ONCE bytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        gram = batch.column("gram").to_numpy()
        bytes_ = np.cumsum([len(x) for x in batch.column("bytes").to_pylist()])
        ends = [*(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist()]
        if held and len(gram) and held[-1].column("gram")[-1].as_py() != gram[0]:
            ends.insert(0, 0)
        done = 0
        for end in ends:
            if size + int(bytes_[end - 1] if end else 0) - int(bytes_[done - 1] if done else 0) >= REFINED_AT_ONCE:
                if rows := [*held, *([batch.slice(done, end - done)] if end > done else [])]:
                    yield _refine_rows(rows)
                held, size, done = [], 0, end
        if done < len(gram):
            held.append(batch.slice(done))
            size += int(bytes_[-1]) - int(bytes_[done - 1] if done else 0)
    if held:
        yield _refine_rows(held)


def _quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of wide buckets to one row for each quarter of their windows.

    ``nearest`` and ``farthest`` bound how far a bucket's windows start before the
    anchor. The bytes that all windows of a quarter share name its bucket.
    """
    names = ("gram", "around", "row", "place", "nearest", "farthest", "low", "high", "open", "bytes")
    types = (*[pa.int64()] * 3, *[pa.int32()] * 5, pa.bool_(), pa.binary())
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            out: list[tuple] = []
            for r in whole.slice(at, 1024).to_pylist():
                step = (r["farthest"] - r["nearest"]) // 4 + 1
                for near in range(r["nearest"], r["farthest"] + 1, step):
                    far = min(near + step - 1, r["farthest"])
                    low, high = max(r["low"], r["place"] - far), min(r["high"], r["place"] - near)
                    if low > high:
                        continue
                    own = r["bytes"][low - r["low"] : high - r["low"] + LENGTH]
                    shared = r["bytes"][r["place"] - near - r["low"] : r["place"] - far - r["low"] + LENGTH]
                    name = xxhash.xxh3_64_intdigest(shared, near << 16 | far)
                    out.append((_signed(name), _signed(xxhash.xxh3_64_intdigest(own)), r["row"], r["place"], near, far, low, high, r["open"], own))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield _batch({n: (c, t) for n, c, t in zip(names, cols, types, strict=True)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of byte ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def repeated_spans(packed: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, spans)`` for each text of ``(row, packed)`` with repeats: byte ranges, not yet merged."""
    seen = scratch.keep(packed.mapInArrow(_anchor_rows, "gram long, around long, row long, lead short, low int, high int"), "anchors")
    most = seen.count()
    counts = seen.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b"))
    # Counts are written before they are joined: a join whose sides are plain shuffles can split a bucket that holds very many rows.
    buckets = scratch.keep(counts.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")), "buckets", most // 2)
    shared = scratch.keep(seen.join(buckets, "gram"), "shared", most)
    scratch.drop(seen, buckets)
    mixed = shared.where("mixed").drop("mixed")
    most = shared.count()
    classes = scratch.keep(mixed.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min("row").alias("first")), "members", most)
    wide = scratch.keep(classes.groupBy("gram").agg((F.count("*") > WIDEST).alias("wide")), "wide", classes.count())
    placed = scratch.keep(mixed.join(classes.join(wide, "gram"), ["gram", "around"]), "classes", most)
    span = lambda df: df.select("row", F.col("low").cast("long").alias("start"), (F.col("high") + LENGTH).cast("long").alias("end"))
    found = [span(shared.where("not mixed")), span(placed.where("n > 1"))]
    wanted = placed.where("n = 1 or row = first").groupBy("row").agg(F.collect_list(F.struct("gram", "wide", "lead", "low", "high", (F.col("n") == 1).alias("open"))).alias("places"))
    around = scratch.keep(packed.join(wanted, "row").select("row", "packed", "places").mapInArrow(_surroundings, "gram long, wide boolean, row long, place int, low int, high int, open boolean, bytes binary"), "bytes")
    small = [around.where("not wide")]
    rows = around.where("wide").withColumns({"nearest": F.lit(0), "farthest": F.lit(SPAN - 1)})
    if not wide.where("wide").isEmpty():
        whole, narrow = _split_wide(rows, scratch)
        found, small = found + [span(df) for df in whole], small + narrow
    small = [df.select("gram", "row", "low", "high", "open", "bytes") for df in small]
    found.append(reduce(DataFrame.union, small).repartition("gram").sortWithinPartitions("gram").mapInArrow(_refine_buckets, "row long, start long, end long"))
    spans = scratch.keep(reduce(DataFrame.union, found).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop(shared, classes, wide, placed, around)
    return spans


def _split_wide(rows: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Wide buckets quartered until none is wide: rows whose windows all repeat, and rows of narrow buckets."""
    whole, narrow = [], []
    while True:
        quarters = scratch.keep(rows.mapInArrow(_quarters, "gram long, around long, row long, place int, nearest int, farthest int, low int, high int, open boolean, bytes binary"), "quarters")
        most = quarters.count()
        classes = scratch.keep(quarters.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "low")).alias("first")), "members", most)
        sizes = scratch.keep(classes.groupBy("gram").agg(F.count("*").alias("k")), "sizes", most)
        placed = scratch.keep(quarters.join(classes.join(sizes, "gram"), ["gram", "around"]), "classes", most)
        scratch.drop(quarters, classes)
        whole.append(placed.where("n > 1 and open"))
        kept = placed.where((F.col("n") == 1) | (F.struct("row", "low") == F.col("first"))).withColumn("open", F.col("open") & (F.col("n") == 1))
        narrow.append(kept.where(F.col("k").between(2, WIDEST)))
        rows = kept.where(F.col("k") > WIDEST).drop("around", "n", "first", "k")
        if sizes.where(F.col("k") > WIDEST).isEmpty():
            return whole, narrow


def without_repeats(docs: DataFrame, finish: Callable[[bytes, list[tuple[int, int]]], tuple], out: list[tuple[str, str, pa.DataType]], text_col: str = "text") -> DataFrame:
    """Adds the ``out`` columns (name, Spark type, Arrow type) that ``finish`` makes of each text and its merged spans.

    Null counts as empty. Texts under LENGTH bytes repeat nothing. All rows stay,
    repeated rows too (each is elsewhere for the other), with all their columns
    but those that ``out`` replaces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    replaced = {text_col.lower(), *(o[0].lower() for o in out)}
    others = [c for c in docs.columns if c.lower() not in replaced]
    # One table holds both, so that a row keeps its number however often it is read.
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(3)
        for b in batches:
            texts = b.column(1).to_pylist()
            small = [shrink.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary()), pa.array([t is not None for t in texts]), *b.columns[2:]], names=["__row", "__packed", "__there", *others])

    packed = scratch.keep(rows.select("__row", F.col(text_col).cast("string").alias("__text"), *others).mapInArrow(pack, ", ".join(["__row long, __packed binary, __there boolean", *[kinds] * bool(kinds)])), "texts")
    texts = packed.select(F.col("__row").alias("row"), F.col("__packed").alias("packed"))
    spans = repeated_spans(texts, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [finish(grow.decompress(x.as_py()) if there.as_py() else None, merged([(s["start"], s["end"]) for s in found.as_py() or []])) for x, there, found in zip(*b.columns[:3], strict=True)]
                cols = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[3:], *[pa.array(c, o[2]) for c, o in zip(cols, out, strict=True)]], names=[*others, *[o[0] for o in out]])

    joined = packed.join(spans.select(F.col("row").alias("__row"), F.col("spans").alias("__spans")), "__row", "left").select("__packed", "__there", "__spans", *[F.col(f"`{c}`") for c in others])
    return joined.mapInArrow(run, ", ".join([*[kinds] * bool(kinds), *[f"`{n}` {t}" for n, t, _ in out]]))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[x for s in spans for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""

    def finish(text: bytes | None, spans: list[tuple[int, int]]) -> tuple:
        text = text or b""
        return len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()

    out = [(n, "long", pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")] + [("kept_sha256", "string", pa.string())]
    return without_repeats(docs.select(id_col, text_col), finish, out, text_col)


def cut_passages(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with repeated passages cut out of their texts.

    A cut that splits a character loses the rest of it. ``length_col`` gets the new
    length in characters; null texts stay null. Columns and their order stay.
    """

    def finish(text: bytes | None, spans: list[tuple[int, int]]) -> tuple:
        if text is None:
            return None, None
        kept = kept_bytes(text, spans).decode("utf-8", "ignore" if spans else "surrogatepass")
        return kept, len(kept)

    out = [(text_col, "string", pa.string()), (length_col or "__length", "long", pa.int64())]
    return without_repeats(docs, finish, out, text_col).select(*docs.columns)
