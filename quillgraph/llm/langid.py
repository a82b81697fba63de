"""Language identification by hyperdimensional letter trigram profiles.

Every letter has a random vector of signs. A trigram's vector binds its letters,
rotated by their place, by multiplication; a text's vector bundles its trigrams
by addition. A language's prototype is the bundle of its training texts, and a
text gets the language whose prototype has the greatest cosine with it.

Memory is bounded by PART texts, CHUNK characters and CODES trigrams at a time,
whatever the lengths of the texts; only a text's letters are held whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
SEED = 20240229
COMMON = 4096  # letters whose vectors are drawn together
CHUNK = 1 << 19  # characters handled at once
PART = 512  # texts handled at once
CODES = 2048  # trigrams per product
TABLE = 1 << 20  # most entries of a table of all trigrams over the letters at hand
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to code point + 1 of its lower-case letter, 0 for what is not a letter."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0]) + 1
    return out


@lru_cache(1)
def _common_signs() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (COMMON + 1, DIM), np.int8) * 2 - 1).astype(np.int8)


@lru_cache(1 << 14)
def _signs(slot: int) -> np.ndarray:
    """The sign vector of a letter (0: the gap between words), the same in every process."""
    if slot <= COMMON:
        return _common_signs()[slot]
    return (np.random.default_rng([SEED, slot]).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)


def _add(vecs: np.ndarray, slot: np.ndarray, doc: np.ndarray) -> None:
    """Adds the vectors of the trigrams of a run of letters and gaps to the rows of their texts."""
    mark = np.zeros(len(_letters()) + 1, bool)
    mark[slot] = True
    used = np.flatnonzero(mark)
    local = np.zeros(len(mark), np.int32)
    local[used] = np.arange(len(used))
    ids, k = local[slot].astype(np.int64), len(used)
    code = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    ok = (doc[:-2] == doc[2:]) & (slot[1:-1] > 0)
    code, doc = code[ok], doc[:-2][ok]
    if k**3 <= TABLE:
        present = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(k**3, np.int32)
        place[present] = np.arange(len(present))
        at = place[code]
    else:
        present, at = np.unique(code, return_inverse=True)
    base = np.array([_signs(s) for s in used.tolist()])
    for low in range(0, len(present), CODES):
        part = present[low : low + CODES]
        v = np.roll(base, 2, 1)[part // (k * k)] * np.roll(base, 1, 1)[part // k % k] * base[part % k]
        mine = (at >= low) & (at < low + len(part))
        counts = np.bincount(doc[mine] * len(part) + at[mine] - low, minlength=len(vecs) * len(part)).reshape(len(vecs), len(part))
        vecs += counts.astype(np.float32) @ v.astype(np.float32)


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One row of summed trigram vectors for each text, and whether it has a letter."""
    vecs, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 + 2 for r in raw])
    gap = " ".encode("utf-32-le")
    slot = _letters()[np.frombuffer(b"".join(gap + r + gap for r in raw), np.uint32)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    del raw
    keep = (slot > 0) | np.r_[True, slot[:-1] > 0] | np.r_[True, doc[1:] != doc[:-1]]
    slot, doc = slot[keep], doc[keep]
    has[doc[slot > 0]] = True
    for low in range(0, len(slot) - 2, CHUNK):
        _add(vecs, slot[low : low + CHUNK + 2], doc[low : low + CHUNK + 2].astype(np.int64))
    return vecs, has


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Runs of at most PART texts of about CHUNK characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= CHUNK or i + 1 - start >= PART:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def bounded_sample(rows: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of the id; the label counts cover all rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    rate = F.lit(0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1_000_000, -(-1_000_000 * most // n)))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1_000_000)) < rate)


def train(rows: DataFrame, most: int = 400) -> dict[str, np.ndarray]:
    """Unit prototypes from ``(id, text, lang)`` rows, from about ``most`` texts of each language."""
    sample = bounded_sample(rows.where("lang is not null"), "lang", "id", most)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for part in _parts(texts):
                vecs, _ = bundle(texts[part])
                for lang in np.unique(langs[part]):
                    total[str(lang)] = total.get(str(lang), 0) + vecs[langs[part] == lang].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()])], names=["lang", "v"])

    parts = sample.select("text", "lang").mapInArrow(sums, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, pos, x in summed.collect():
        out.setdefault(lang, np.zeros(DIM))[pos] = x
    return {k: v / norm for k, v in sorted(out.items()) if (norm := np.linalg.norm(v))}


def prediction(model: dict[str, np.ndarray], text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` of a text column; other columns stay in the JVM.

    ``und`` with score 0 for null texts, texts without letters, and any text if
    nothing was learned. Ties go to the lesser language. Scores lie in 0 to 1.
    """
    langs, protos = [*model, UNKNOWN], np.array([*model.values(), np.zeros(DIM)], np.float32).T

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            best, score = np.full(len(batch), len(langs) - 1), np.zeros(len(batch))
            for at in range(0, len(batch), PART):
                texts = batch.slice(at, PART).to_pylist()
                for part in _parts(texts):
                    vecs, has = bundle(texts[part])
                    cos = vecs @ protos / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-9)
                    cos[:, -1] = -2
                    top = cos.argmax(1)
                    top[~has | (len(langs) == 1)] = len(langs) - 1
                    own = slice(at + part.start, at + part.stop)
                    best[own], score[own] = top, np.where(has, np.clip(cos.max(1), 0, 1), 0)
            yield pa.StructArray.from_arrays([pa.array([langs[i] for i in best], pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text.cast("string"))


def predict(docs: DataFrame, model: dict[str, np.ndarray], carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns with ``lang_pred`` and ``score`` (which replace columns of these names); see prediction.

    One row per input row; repeated rows give repeated rows, an empty table none.
    """
    carry = [c for c in carry if c.lower() not in ("lang_pred", "score")]
    found = docs.select(*[F.col(f"`{c}`") for c in carry], prediction(model, F.col(text_col)).alias("__found"))
    return found.select(*[F.col(f"`{c}`") for c in carry], "__found.lang_pred", "__found.score")


def fold(id_col: str = "doc_id") -> Column:
    """Null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
