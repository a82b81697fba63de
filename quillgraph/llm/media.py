"""Media columns: GIF files to timed frames, and texts stored losslessly as GIF samples."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import gif

WIDE = 192
FRAMES = "array<struct<delay_ms:int,width:int,height:int,rgba:binary,histogram:array<int>>>"


def decode_gifs(df: DataFrame, gif_col: str, out_col: str = "frames") -> DataFrame:
    """Adds the frames of a binary GIF column, as shown, with delays and octant histograms.

    Null files give null, and so do files that are malformed, break off or are too
    large (see gif.frames); columns of the same name are replaced.
    """

    def frames(data: bytes | None) -> list[dict] | None:
        try:
            return None if data is None else [{"delay_ms": f.delay_ms, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "rgba": f.canvas.tobytes(), "histogram": f.histogram.tolist()} for f in gif.frames(bytes(data))]
        except ValueError:
            return None

    return df.withColumn(out_col, F.udf(frames, FRAMES, useArrow=True)(gif_col))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(WIDE, -(-len(raw) // WIDE) * WIDE), b" ")


def to_gif(payload: bytes) -> bytes:
    """A payload of whole rows as frames of at most MAX_ROWS rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDE)
    return gif.encode([rows[i : i + gif.MAX_ROWS] for i in range(0, len(rows), gif.MAX_ROWS)], gif.palette332())


def from_gif(media: bytes) -> tuple[bytes, str]:
    """The payload as stored, and the feature: frames, milliseconds and shown pixels per octant."""
    parts, delay, counts = [], 0, np.zeros(8, np.int64)
    for f in gif.frames(media):
        parts.append(f.indices.tobytes())
        delay += f.delay_ms
        counts += f.histogram
    return b"".join(parts), f"{len(parts)}|{delay}|{','.join(map(str, counts.tolist()))}"


def _digest(text: str | None) -> tuple:
    n, payload = padded(text)
    media = to_gif(payload)
    back, feature = from_gif(media)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text through a GIF and back: sizes, digests, the feature, and the file itself if asked for.

    A text is its UTF-8 bytes, with spaces up to a positive multiple of 192, as
    the samples of 192-wide frames. Null counts as empty. One row per input row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x.as_py() for x in batch.column(1)]
                cols = list(zip(*map(_digest, texts), strict=True))
                out = [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]]
                if with_media:
                    out.append(pa.array([to_gif(padded(t)[1]) for t in texts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, *names, *["media"] * with_media])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
