"""Cards as images: drawn into binary columns, with the boxes of what is printed, and found again in pixels.

A glyph is a block as wide as a table of widths says, so drawing takes no fonts and a box follows from a text in the JVM.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.schemas import ARABIC, CARD_KEYS, FIELDS
from fieldmark.sources.readers import scan_images

# Characters that are narrower or wider than the others, and the widths of all, in pixels.
NARROW, WIDE = "!'(),.:;I[]`fijlrt|1 -", "MWmw@%&"
NARROW_WIDTH, PLAIN_WIDTH, WIDE_WIDTH = 7, 12, 17
#: Pixels between glyphs, and around a text in its box.
GAP, MARGIN = 2, 4


@dataclass(frozen=True)
class Layout:
    """Where a card's fields are printed: Latin values from ``left``, Arabic ones up to ``right``, a field a row."""

    width: int = 640
    height: int = 330
    left: int = 150
    right: int = 620
    top: int = 70
    row: int = 42
    glyph: int = 18
    paper: int = 244
    ink: int = 18
    head: int = 48

    def rows(self) -> dict[str, int]:
        return {f: self.top + self.row * i for i, f in enumerate(FIELDS)}


def printed_width(text: Column) -> Column:
    """A text's width in pixels, without the gap behind its last glyph."""
    all_of, without = F.char_length(text), lambda some: F.char_length(F.translate(text, some, ""))
    narrow, wide = all_of - without(NARROW), all_of - without(WIDE)
    return all_of * (PLAIN_WIDTH + GAP) - narrow * (PLAIN_WIDTH - NARROW_WIDTH) + wide * (WIDE_WIDTH - PLAIN_WIDTH) - GAP


def stated_boxes(layout: Layout = Layout(), value=F.col) -> Column:
    """field -> [x1, y1, x2, y2] around each Latin value of a card's columns; a field without a visible character has none.

    Values beyond the card's edge are cut there, as they are when drawn.
    """
    def box(f: str) -> Column:
        y, text = layout.rows()[f], F.rtrim(value(f))
        begins = layout.left + F.when(F.char_length(F.ltrim(text)) == F.char_length(text), 0).otherwise(printed_width(text) - printed_width(F.ltrim(text)))
        ends = F.least(F.lit(layout.left) + printed_width(text), F.lit(layout.width))
        edge = F.array(begins - MARGIN, F.lit(y - MARGIN), ends + MARGIN, F.lit(y + layout.glyph + MARGIN)).cast("array<int>")
        return F.when((text != "") & (begins < layout.width), F.struct(F.lit(f).alias("key"), edge.alias("value")))

    return F.map_from_entries(F.array_compact(F.array(*[box(f) for f in FIELDS])))


def _runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each glyph that is printed; a space leaves its place blank."""
    runs, x = [], 0
    for c in text:
        w = NARROW_WIDTH if c in NARROW else WIDE_WIDTH if c in WIDE else PLAIN_WIDTH
        if c != " ":
            runs.append((x, x + w))
        x += w + GAP
    return runs


@lru_cache(64)
def _bands(layout: Layout) -> list[tuple[int, bytes, list[str]]]:
    """(lines, the pixels of a blank one, the fields that are printed there) of the parts of a card, each of equal lines, from its top."""
    tops = layout.rows()
    edges = (0, layout.height, layout.head, *tops.values(), *(y + layout.glyph for y in tops.values()))
    cuts = sorted({min(max(0, y), layout.height) for y in edges})
    ground = lambda y: bytes([layout.ink if y < layout.head else layout.paper]) * layout.width
    return [(b - a, ground(a), [f for f, y in tops.items() if y <= a < y + layout.glyph]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(16384)
def _printed(blank: bytes, layout: Layout, *values: tuple[str, str]) -> bytes:
    """A line of pixels with what is printed there: a Latin and an Arabic value of each field."""
    line = np.array(bytearray(blank))
    for latin, arabic in values:
        for a, b in _runs(arabic):
            # a shade of its own, so that a Latin value's pixels can be told from it
            line[max(0, layout.right - b) : max(0, layout.right - a)] = layout.ink + 60
        for a, b in _runs(latin.rstrip(" ")):
            line[layout.left + a : layout.left + b] = layout.ink
    return line.tobytes()


def drawn_lines(card: dict, layout: Layout = Layout()) -> list[tuple[bytes, int]]:
    """A card in grey as lines and how often each is repeated below itself: a dark head, Latin values on the left and
    Arabic ones, from right to left, on the right."""
    values = {f: (card.get(f) or "", (card.get(f"{f}_ar") or "") if f in ARABIC else "") for f in FIELDS}
    return [(_printed(blank, layout, *[values[f] for f in fields]) if fields else blank, times) for times, blank, fields in _bands(layout)]


def drawn(card: dict, layout: Layout = Layout()) -> np.ndarray:
    """drawn_lines as a page of pixels."""
    lines, times = zip(*drawn_lines(card, layout))
    return np.repeat(np.frombuffer(b"".join(lines), np.uint8).reshape(-1, layout.width), times, axis=0)


@lru_cache(16384)
def _deflated(line: bytes, times: int) -> tuple[bytes, int]:
    """A line behind its filter, none: so many times as a piece of a deflate stream that stands for itself, with its checksum."""
    piece, raw = zlib.compressobj(1, wbits=-zlib.MAX_WBITS), (b"\0" + line) * times
    return piece.compress(raw) + piece.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw)


def png_of_lines(lines: list[tuple[bytes, int]], width: int) -> bytes:
    """A grey image as a PNG file, from lines and how often each is repeated: these are deflated together, and once while they recur."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pieces, low, high = [], 1, 0
    for line, times in lines:
        piece, checksum = _deflated(line, times)
        pieces.append(piece)
        # of Adler's two sums the second also counts the first for each byte
        high = (high + (checksum >> 16) + times * (width + 1) * (low - 1)) % 65521
        low = (low + (checksum & 0xFFFF) - 1) % 65521
    packed = b"\x78\x01" + b"".join(pieces) + b"\x03\x00" + struct.pack(">HH", high, low)  # the last block is empty
    head = struct.pack(">IIBBBBB", width, sum(times for _, times in lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def png(grey: np.ndarray) -> bytes:
    """png_of_lines of a page of pixels, where equal lines below each other are found."""
    grey = grey.astype(np.uint8, copy=False)
    height, width = grey.shape
    runs = [0, *(np.flatnonzero((grey[1:] != grey[:-1]).any(axis=1)) + 1).tolist(), height]
    return png_of_lines([(grey[a].tobytes(), b - a) for a, b in zip(runs, runs[1:])], width)


def draw_cards(cards: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """cards with ``content``, each row's card as a PNG file, and ``boxes``; null values are left blank.

    cards: the card's keys as columns, or some of them.
    """
    keys = [k for k in CARD_KEYS if k in cards.columns]

    @F.pandas_udf("binary")
    def content(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in parts:
            yield pd.Series([png_of_lines(drawn_lines(dict(zip(keys, row)), layout), layout.width) for row in frame.itertuples(index=False)], dtype=object)

    value = lambda f: F.col(f) if f in keys else F.lit(None).cast("string")
    return cards.withColumns({"boxes": stated_boxes(layout, value), "content": content(F.struct(*keys))})


def boxes_in(page: np.ndarray, layout: Layout = Layout()) -> dict[str, list[int]]:
    """field -> box of the Latin value's pixels with its margin, in a grey page."""
    boxes, half = {}, layout.glyph // 2
    around = {f: (max(0, y - half), y + layout.glyph + half) for f, y in layout.rows().items()}
    top, end = min(a for a, _ in around.values()), max(b for _, b in around.values())
    part = page[top:end, layout.left :]
    # eight pixels are a word, so that many are looked at together; what fills the last word is light
    words = np.zeros((len(part), -(-part.shape[1] // 8)), np.uint64)
    # decoders may turn grey into colours and back, so that a shade moves a little
    np.less(part, layout.ink + 30, out=words.view(np.bool_)[:, : part.shape[1]])
    inked = np.bitwise_or.reduce(words, axis=1) > 0
    for f, (a, b) in around.items():
        across = np.bitwise_or.reduce(words[a - top : b - top], axis=0).tobytes()
        if (x := across.find(1)) >= 0:
            down = inked[a - top : b - top].tobytes()
            boxes[f] = [layout.left + x - MARGIN, a + down.find(1) - MARGIN, layout.left + across.rfind(1) + 1 + MARGIN, a + down.rfind(1) + 1 + MARGIN]
    return boxes


def found_boxes(images: DataFrame, layout: Layout = Layout(), image: str = "image") -> DataFrame:
    """images with ``found``: field -> box of the Latin value's pixels with its margin; null for images that can't be read."""
    @F.pandas_udf("map<string, array<int>>")
    def found(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or h <= 0 or w <= 0 else boxes_in(np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, 0], layout) for d, h, w, c in zip(data, height, width, channels)])

    i = F.col(image)
    return images.withColumn("found", found(i["data"], i["height"], i["width"], i["nChannels"]))


def scan_boxes(files: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """name, image (height, width, nChannels, found) of rows of PNG files, as readers.scan_images gives them with found_boxes' map."""
    boxes = pa.map_(pa.string(), pa.list_(pa.int32()))
    find = lambda pages: pa.array([None if p is None else list(boxes_in(p[:, :, 0], layout).items()) for p in pages], boxes)
    return scan_images(files, find, "map<string, array<int>>")
