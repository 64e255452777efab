"""Media columns: PNG images in binary columns, read back by numpy, with low-frequency cosine-transform hashes.

Writing makes an 8-bit grey PNG of fixed width whose rows are filtered by Up, which suits columns of text bytes
as well as pictures, and deflated. Reading walks the chunks, tests every checksum, inflates, and undoes any of
the five row filters. The hash compares the lowest frequencies of a 32 x 32 block mean with their median.

Defined cases: null bytes or text count as empty; empty content still makes one row of zeros; repeated rows stay, with
equal values; very long content is an image of many rows, whole; further columns are ignored; an empty table gives an
empty result; a broken image raises ValueError from ``decode_png``, and ``image_features`` gives null features and the message in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.png import SIGNATURE, Image, decode_png
from fieldmark.llm.common import map_rows

WIDTH, LEVEL, SIDE, LOW = 64, 4, 32, 8


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data with zero bytes up to a positive multiple of width."""
    return data + bytes(-len(data) % width if data else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of the samples, a multiple of width; the same samples give the same bytes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    filtered = np.empty((len(rows), width + 1), np.uint8)
    filtered[:, 0] = 2
    filtered[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=filtered[1:, 1:])
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(low), np.arange(n) + 0.5))


_COSINES = _cosines(SIDE, LOW)


def cosine_hash(image: Image) -> bytes:
    """8 bytes: which of the 64 lowest frequencies, without the mean, lie above their median."""
    grey = image.samples.reshape(image.height, image.width, image.channels).mean(axis=2) if image.channels > 1 else image.samples.astype(np.float64)
    for axis in (0, 1):
        edges = np.arange(SIDE) * grey.shape[axis] // SIDE
        sums = np.add.reduceat(grey, edges, axis=axis)
        counts = np.maximum(1, np.diff(np.append(edges, grey.shape[axis])))
        grey = sums / (counts[:, None] if axis == 0 else counts[None, :])
    low = (_COSINES @ grey @ _COSINES.T).round(6).ravel()
    low[0] = 0
    return np.packbits(low > np.median(low[1:])).tobytes()


def image_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each text's UTF-8 bytes, padded, as a PNG."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            raw = [(t.as_py() or "").encode() for t in batch.column(text)]
            return {key: batch.column(key), "n_bytes": [len(x) for x in raw], "media": [encode_png(padded(x)) for x in raw]}

        return work

    return map_rows(df, [key, text], f"{key} long, n_bytes long, media binary", make, text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def image_features(df: DataFrame, key: str = "doc_id", media: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Read stored images back: their samples' digest, the checksum of the last 64, and the cosine hash as hex digits."""
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def make():
        def read(data: bytes) -> tuple:
            stored = (len(data), hashlib.sha256(data).hexdigest())
            try:
                image = decode_png(data)
            except ValueError as error:
                return (None, None, None, *stored, None, str(error))
            samples = image.samples.tobytes()
            return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), *stored, cosine_hash(image).hex(), None)

        def work(batch: pa.RecordBatch) -> dict:
            rows = [read(x.as_py() or b"") for x in batch.column(media)]
            return {key: batch.column(key)} | {c: batch.column(c) for c in keep} | dict(zip(names, zip(*rows)))

        return work

    carried = "".join(f", {c} {kinds[c]}" for c in keep)
    return map_rows(df, [key, *keep, media], f"{key} long{carried}, {FEATURES}", make, media)


def text_images(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an image and return what the stored images give."""
    return image_features(image_column(df, key, text), key).select(key, "n_bytes", *[F.col(x.split()[0]) for x in FEATURES.split(", ")[:-1]])
