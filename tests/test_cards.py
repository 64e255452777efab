"""Cards as images: drawn, written as files, read back by the image source and found in pixels."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldmark.functions.png import decode_png
from fieldmark.schemas import CARD_KEYS, FIELDS
from fieldmark.sources import cards, readers, writers

VALUES = ["MARY WIM", "il.|1", None, "", "   ", "  X", "A" * 60, "Ünï çödé", "1950-01-31", "W", "a  b "]


def frame(spark):
    rows = [(f"c{i}.png", *[VALUES[(i + k) % len(VALUES)] if not key.endswith("_ar") else ["عماني", None, "ذكر"][i % 3] for k, key in enumerate(CARD_KEYS)]) for i in range(len(VALUES))]
    return spark.createDataFrame(rows, "image string, " + ", ".join(f"{k} string" for k in CARD_KEYS))


def test_pixels_lie_where_they_are_stated(spark, tmp_path):
    drawn = cards.draw_cards(frame(spark))
    writers.write_files(drawn.select(F.col("image").alias("name"), "content"), str(tmp_path / "cards"))
    images = readers.read_written_images(spark, str(tmp_path / "cards"))
    found = {r["name"]: (r["image"]["width"], r["image"]["height"], r["found"]) for r in cards.found_boxes(images).collect()}
    stated = {r["image"]: r["boxes"] for r in drawn.select("image", "boxes").collect()}
    assert len(found) == len(VALUES)
    edge = cards.Layout().width + cards.MARGIN
    for name, boxes in stated.items():
        width, height, seen = found[name]
        assert (width, height) == (640, 330) and set(seen) == set(boxes)
        for f, box in boxes.items():
            # a value that runs over the edge may end in a gap there
            assert seen[f][:2] == box[:2] and seen[f][3] == box[3] and (seen[f][2] == box[2] or box[2] == edge and box[2] - seen[f][2] <= cards.GAP)
    assert {len(b) for b in stated.values()} != {len(FIELDS)}


def test_some_keys_and_no_rows(spark):
    one = cards.draw_cards(spark.createDataFrame([("x", "JO")], "image string, full_name string")).first()
    assert one["content"][:8] == b"\x89PNG\r\n\x1a\n" and set(one["boxes"]) == {"full_name"}
    assert cards.draw_cards(frame(spark).limit(0)).count() == 0


def test_files_that_cant_be_read(spark, tmp_path):
    good = cards.png(np.full((3, 5), 9, np.uint8))
    rows = [("a.png", bytearray(good)), ("b.png", bytearray(good[:25])), ("c.png", None), ("d 1%/é.png", bytearray(good)), ("a.png", bytearray(good)), ("007", bytearray(good))]
    writers.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "f"), tasks=3)
    images = readers.read_written_images(spark, str(tmp_path / "f"))
    assert {r["name"] for r in readers.rejects(images).collect()} >= {"b.png"}
    fine = [r["name"] for r in readers.readable(images).select("name", "image.width").where("width = 5").collect()]
    assert sorted(set(fine)) == sorted({"a.png", "d 1%/é.png", "007"})
    data = readers.readable(images).select("image.data", "image.nChannels").first()
    assert set(data["data"]) == {9}


def test_manifest_lines(spark, tmp_path):
    drawn = cards.draw_cards(frame(spark)).select("image", F.create_map(*[x for k in CARD_KEYS for x in (F.lit(k), F.col(k))]).alias("fields"), "boxes")
    writers.write_manifest_lines(drawn.repartition(3), str(tmp_path / "m"))
    back = readers.read_manifest(spark, str(tmp_path / "m"), lines=True)
    plain = lambda df: sorted((r["image"], sorted((k, v) for k, v in r["fields"].items() if v is not None), sorted(r["boxes"].items())) for r in df.collect())
    assert plain(back) == plain(drawn) and plain(readers.read_manifest(spark, str(tmp_path / "m"))) == plain(drawn)
    with pytest.raises(Exception, match="no file for"):
        readers.manifest_images(back, readers.read_images(spark, str(tmp_path / "m"), "*.png")).collect()


def test_nothing_stays_after_the_session(spark):
    path = writers.passing(spark, "gone")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(at) and system.cancelDeleteOnExit(at)
    system.delete(at, True)


def test_rows_are_scanned_as_files_are(spark, tmp_path):
    grey = np.add.outer(np.arange(40) // 7, np.arange(60) % 3).astype(np.uint8)
    good = cards.png(grey)
    rows = [("a.png", bytearray(good)), ("b.png", bytearray(good[:45])), ("c.png", None), ("d.png", bytearray(b"hello")), ("e.png", bytearray(good[:20]))]
    files = spark.createDataFrame(rows, "name string, content binary")
    for name, content in rows:
        (tmp_path / name).write_bytes(bytes(content or b"\n"))  # the image source leaves out files of no bytes
    size = lambda df: sorted(tuple(r) for r in df.select("name", "image.width", "image.height", "image.nChannels").where("width > 0").collect())
    scanned, read = readers.scan_images(files), readers.read_images(spark, str(tmp_path))
    assert size(scanned) == size(read) == [("a.png", 60, 40, 1)]
    assert {r["name"] for r in readers.rejects(scanned).collect()} == {r["name"] for r in readers.rejects(read).collect()} == {"b.png", "c.png", "d.png", "e.png"}
    assert bytes(readers.readable(read).select("image.data").first()[0]) == grey.tobytes()
    # stricter than the image source, which gives an image whose end is missing
    (tmp_path / "a.png").write_bytes(good[:-20])
    cut = spark.createDataFrame([("a.png", bytearray(good[:-20]))], "name string, content binary")
    assert size(readers.read_images(spark, str(tmp_path))) and [r[0] for r in readers.rejects(readers.scan_images(cut)).collect()] == ["a.png"]
    with pytest.raises(Exception, match="x.gif: not a PNG"):
        readers.scan_images(spark.createDataFrame([("x.gif", bytearray(b"GIF89a"))], "name string, content binary")).collect()


def test_boxes_of_rows_are_those_of_files(spark, tmp_path):
    drawn = cards.draw_cards(frame(spark)).select(F.col("image").alias("name"), "content")
    writers.write_files(drawn, str(tmp_path / "cards"))
    by_file = {r["name"]: r["found"] for r in cards.found_boxes(readers.read_written_images(spark, str(tmp_path / "cards"))).collect()}
    assert {r["name"]: r["image"]["found"] for r in cards.scan_boxes(drawn).collect()} == by_file and len(by_file) == len(VALUES)


@pytest.mark.parametrize("name", ["image_scan", "image_rejects"])
def test_no_file_for_each_image(spark, sf, monkeypatch, name):
    """Each file and folder costs milliseconds, so many images are rows of few files."""
    made, passing = [], writers.passing
    monkeypatch.setattr(writers, "passing", lambda *a: made.append(passing(*a)) or made[-1])
    entry.queries()[name](spark, sf).collect()
    files = [f for p in made for _, _, found in os.walk(p.removeprefix("file:").replace("///", "/")) for f in found]
    assert 0 < len(files) < 60 and spark.read.parquet(f"{sf}/customer.parquet").count() > 100


def plain_page(card, layout):
    """A card painted value by value over a whole page, with no line drawn once for others."""
    page = np.full((layout.height, layout.width), layout.paper, np.uint8)
    page[: layout.head] = layout.ink
    for f, y in layout.rows().items():
        for a, b in cards._runs(card.get(f"{f}_ar") or ""):
            page[y : y + layout.glyph, max(0, layout.right - b) : max(0, layout.right - a)] = layout.ink + 60
        for a, b in cards._runs((card.get(f) or "").rstrip(" ")):
            page[y : y + layout.glyph, layout.left + a : layout.left + b] = layout.ink
    return page


def test_pages_are_drawn_line_by_line():
    """A page's pixels cost far more than its few different lines, so that no page is painted to be written."""
    layouts = [cards.Layout(), cards.Layout(row=10), cards.Layout(head=120), cards.Layout(width=333, height=201), cards.Layout(top=300), cards.Layout(glyph=50, row=30), cards.Layout(right=160)]
    for i in range(70):
        card = {key: VALUES[(i * 7 + k) % len(VALUES)] if not key.endswith("_ar") else ["عماني", None, "ع" * 80][i % 3] for k, key in enumerate(CARD_KEYS)}
        layout = layouts[i % len(layouts)]
        page, written = plain_page(card, layout), cards.png_of_lines(cards.drawn_lines(card, layout), layout.width)
        image = decode_png(written)  # tests all checksums
        assert (cards.drawn(card, layout) == page).all() and (image.samples == page).all() and (decode_png(cards.png(page)).samples == page).all()
        assert cards.boxes_in(image.samples, layout) == cards.boxes_in(page, layout)
    assert len(cards.drawn_lines(dict.fromkeys(CARD_KEYS, "A"))) <= 2 * len(FIELDS) + 2


def test_boxes_of_pages_of_other_sizes():
    page = cards.drawn({"full_name": "JO", "sex": "M"})
    whole = cards.boxes_in(page)
    assert set(whole) == {"full_name", "sex"}
    assert [set(cards.boxes_in(page[:h, :w])) for h, w in ((0, 0), (330, 0), (0, 640), (330, 150), (60, 640), (120, 640))] == [set()] * 5 + [{"full_name"}]
    large = np.full((700, 901), 244, np.uint8)
    large[:330, :640] = page
    assert cards.boxes_in(large) == whole
    # part of a value's first and last rows and columns only
    dots = np.full((330, 640), 244, np.uint8)
    for y, x in ((72, 639), (80, 200), (87, 151)):
        dots[y, x] = 18
    assert cards.boxes_in(dots) == {"full_name": [147, 68, 644, 92]}


def test_pages_are_scanned_one_after_the_other(spark):
    """No batch of decoded pages is held: what looks at them gets each when it asks for it."""
    files = spark.createDataFrame([(f"{i}", bytearray(cards.png(np.full((2, 3), i, np.uint8)))) for i in range(5)] + [("x", None)], "name string, content binary").coalesce(1)

    def look(pages):
        assert not hasattr(pages, "__len__")
        return pa.array([None if p is None else int(p[0, 0, 0]) for p in pages], pa.int32())

    rows = {r["name"]: (r["image"]["width"], r["image"]["found"]) for r in readers.scan_images(files, look, "int").collect()}
    assert rows == {str(i): (3, i) for i in range(5)} | {"x": (-1, None)}


def test_manifest_and_images_meet_once(spark, sf):
    plan = entry.queries()["image_scan"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_width_of_odd_texts(spark):
    texts = ["", " ", "a-b.c", "W W", "😀é", "il1|MW%"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cards.printed_width(F.col("t"))).collect()
    widths = {t: sum(7 if c in cards.NARROW else 17 if c in cards.WIDE else 12 for c in t) + 2 * len(t) - 2 for t in texts}
    assert {r[0]: r[1] for r in got} == widths
