"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

Each vocabulary entry becomes a BPE piece: its bytes mapped to printable characters, its score the negated
rank, so that the best-scored merge is the lowest rank; the normaliser is the identity and adds no prefix.
Texts are split by the vocabulary's pattern, and each pre-token is encoded by itself: a pre-token that is an
entry is that entry, any other goes through sentencepiece. Decoding maps ids to pieces and characters back to
bytes. Piece ids are the ranks; the unknown piece, which no text reaches, has the id after the last.

Defined cases: a null text is the empty text, as is an empty one: no ids; very long texts are encoded whole, pre-token by
pre-token; repeated rows stay; further columns are ignored, also where their names are those of the result; an empty table
gives an empty result. Pre-token results are kept in a cache of bounded size in each worker.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmark.llm.common import map_rows

#: Most pre-tokens that a worker's cache holds before it starts anew, and the longest that it holds.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 40


def byte_chars() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: bytes, float or int."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE whose piece ids are the ranks."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    chars = byte_chars()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


@dataclass(frozen=True)
class Coder:
    """What a worker needs: the serialised model and the pre-token pattern."""

    model: bytes
    pattern: str

    def start(self):
        """(encode, decode): text to little-endian uint32 bytes, and back to bytes."""
        import numpy as np
        import regex
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        size = processor.get_piece_size() - 1
        chars = byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        table = {b: c for b, c in enumerate(chars)}
        pieces = [bytes(to_byte[c] for c in processor.id_to_piece(i)) for i in range(size)]
        whole = {piece: struct.pack("<I", i) for i, piece in enumerate(pieces)}
        split = regex.compile(self.pattern).findall
        cache: dict[str, bytes] = {}

        def miss(token: str) -> bytes:
            raw = token.encode()
            ids = whole.get(raw)
            if ids is None:
                found = processor.encode(raw.decode("latin-1").translate(table))
                if size in found:
                    raise ValueError("the vocabulary lacks a byte")
                ids = struct.pack(f"<{len(found)}I", *found)
            if len(token) <= CACHE_CHARS:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                cache[token] = ids
            return ids

        def encode(text: str) -> bytes:
            get = cache.get
            return b"".join([get(t) or miss(t) for t in split(text)])

        def decode(ids: bytes) -> bytes:
            return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])

        return encode, decode


def coder(path: str, pattern: str) -> Coder:
    return Coder(serialise_model(read_ranks(path)), pattern)


def encode_column(df: DataFrame, how: Coder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (binary: little-endian uint32) of every text."""
    shared = df.sparkSession.sparkContext.broadcast(how)  # bounded by the vocabulary file

    def make():
        encode, _ = shared.value.start()

        def work(batch: pa.RecordBatch) -> dict:
            ids = [encode(t or "") for t in batch.column(text).to_pylist()]
            return {key: batch.column(key), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return work

    return map_rows(df, [key, text], f"{key} long, n_tokens long, ids binary", make, text, 500)


def digest(df: DataFrame, how: Coder, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text, decode its ids and give digests of both; keep: integer or string columns to carry along."""
    shared = df.sparkSession.sparkContext.broadcast(how)  # bounded by the vocabulary file
    kinds = dict(df.dtypes)
    extra = "".join(f", {c} {kinds[c]}" for c in keep)

    def make():
        encode, decode = shared.value.start()

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {key: batch.column(key), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | {c: batch.column(c) for c in keep}
            for t in batch.column(text):
                ids = encode(t.as_py() or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decode(ids)).hexdigest())
            return out

        return work

    return map_rows(df, list(dict.fromkeys([key, text, *keep])), f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", make, text, 500)
