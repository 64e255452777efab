"""Sources: images, manifests, line lists, replies, synthetic cards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.png import OtherForm, decode_png
from fieldmark.schemas import ARABIC, CARD_KEYS, FIELDS

MANIFEST = "map<string, struct<fields: map<string, string>, boxes: map<string, array<int>>>>"
#: File names that are images; others in a folder aren't read.
IMAGE_GLOB = "*.{png,jpg,jpeg,bmp,gif,PNG,JPG,JPEG,BMP,GIF}"


def read_images(spark: SparkSession, path: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """name, image of every file; one that can't be decoded has a width of -1."""
    images = spark.read.format("image").option("pathGlobFilter", glob).load(path)
    return images.select(F.substring_index("image.origin", "/", -1).alias("name"), "image")


def read_written_images(spark: SparkSession, path: str) -> DataFrame:
    """name, image of the files that writers.write_files wrote; if all names are numbers, they lose leading zeros."""
    folders = spark.read.format("image").option("pathGlobFilter", "part-*").load(path)
    return folders.select(F.col("name").cast("string").alias("name"), "image")


def scan_images(files: DataFrame, look: Callable[[Iterator[np.ndarray | None]], pa.Array] | None = None, kind: str = "boolean") -> DataFrame:
    """name, image of rows of PNG files (name, content): height, width, nChannels, and found, what ``look`` makes of the pixels.

    Many images are rows of a table, not files of their own, each of which costs more than its bytes. They are decoded
    where ``look`` takes them, one after the other (height x width x channels, red first, not to be written to), and no pixels leave a task. As in the image source, one
    that can't be decoded, or a null, has a height and width of -1; ``look`` meets None for it. Checksums are tested, so
    one whose end is missing isn't decoded here, where the image source gives what is left. Images that numpy doesn't decode
    though they may be sound (JPEG, GIF, BMP; palettes, interlace, 16 bits) are an error when they are met: read_images decodes these.
    """
    def decoded(name: str, content: bytes | None) -> np.ndarray | None:
        try:
            image = decode_png(content or b"")
        except OtherForm as error:
            raise ValueError(f"{name}: {error}") from error
        except ValueError:
            return None
        return image.samples.reshape(image.height, image.width, image.channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: list[tuple[int, ...]] = []

            def pages() -> Iterator[np.ndarray | None]:
                for name, content in zip(batch.column("name"), batch.column("content")):
                    page = decoded(name.as_py(), content.as_py())
                    sides.append((-1, -1, -1) if page is None else page.shape)
                    yield page

            found = look(pages()) if look else pa.nulls(sum(1 for _ in pages()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("name"), *[pa.array([s[i] for s in sides], pa.int32()) for i in range(3)], found], ["name", "height", "width", "nChannels", "found"])

    rows = files.select("name", "content").mapInArrow(run, f"name string, height int, width int, nChannels int, found {kind}")
    return rows.select("name", F.struct("height", "width", "nChannels", "found").alias("image"))


def readable(images: DataFrame) -> DataFrame:
    return images.where("image.width > 0")


def rejects(images: DataFrame) -> DataFrame:
    """Files that were given as images but can't be decoded."""
    return images.where("image IS NULL OR image.width <= 0").select("name", F.lit("not an image that can be read").alias("error"))


def require_content(df: DataFrame, column: str) -> DataFrame:
    """df; a row without content is an error when it is met."""
    lost = F.raise_error(F.lit(f"a row has no {column}"))
    return df.where(F.when(F.col(column).isNull(), lost.cast("boolean")).otherwise(True))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """image, fields, boxes from JSON objects of images, in UTF-8: one over any number of lines, or several below each other.

    lines: each object is a line, so that a file of any size is read in parts.
    """
    if lines:
        return spark.read.text(path).select(F.explode(F.from_json("value", MANIFEST)).alias("image", "t")).select("image", "t.fields", "t.boxes")
    text = spark.read.text(path, wholetext=True)
    # inside an object, a comma stands between "}" and "{"
    objects = text.select(F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
    return objects.select(F.explode(F.from_json("value", MANIFEST)).alias("image", "t")).select("image", "t.fields", "t.boxes")


def manifest_truth(manifest: DataFrame) -> DataFrame:
    """image, field, want, want_ar, true_box for every field of every image."""
    def box(f):
        b = F.col("boxes")[f]
        return F.when(b.isNotNull(), F.struct(*[b[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))

    rows = [F.struct(F.lit(f).alias("field"), F.col("fields")[f].alias("want"), (F.col("fields")[f"{f}_ar"] if f in ARABIC else F.lit(None).cast("string")).alias("want_ar"), box(f).alias("true_box")) for f in FIELDS]
    return manifest.select("image", F.explode(F.array(*rows)).alias("r")).select("image", "r.*")


def manifest_images(manifest: DataFrame, images: DataFrame, *keep: str) -> DataFrame:
    """The manifest's images, with those of its columns that are to be kept; one whose file is absent is an error when it is met."""
    joined = manifest.select("image", *keep).join(images.withColumnRenamed("image", "pixels"), F.col("image") == F.col("name"), "left")
    lost = F.raise_error(F.concat(F.lit("no file for "), F.col("image")))
    return joined.where(F.when(F.col("name").isNull(), lost.cast("boolean")).otherwise(True)).select("image", *keep, "pixels")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct upper-cased lines of a list that aren't blank."""
    from fieldmark.functions.text import strip

    return spark.read.text(path).select(F.upper(strip(F.col("value"))).alias("value")).where("value <> ''").distinct()


def unknown_values(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose upper-cased value isn't in the list (column value); nulls are no unknown values."""
    from fieldmark.functions.text import strip

    return df.where(F.col(column).isNotNull()).join(known, F.upper(strip(F.col(column))) == F.col("value"), "left_anti")


#: Invented cards, as rows of the card's keys.
RECORDS = (
    ("YUSUF HAMAD AL KINDI", "يوسف حمد الكندي", "55120934", "1984-09-17", "2032-02-08", "OMANI", "عماني", "M", "ذكر"),
    ("LAYLA NASSER HADDAD", "ليلى ناصر حداد", "61877203", "2001-05-30", "2030-07-19", "JORDANIAN", "أردني", "F", "أنثى"),
    ("TOM WALKER", "توم ووكر", "70045518", "1969-12-01", "2027-10-25", "BRITISH", "بريطاني", "M", "ذكر"),
    ("SUNITA RANI THAPA", "سونيتا راني ثابا", "48290167", "1990-03-14", "2033-06-02", "NEPALI", "نيبالي", "F", "أنثى"),
)


def synthetic_cards(spark: SparkSession, char_width: int = 16, char_height: int = 26) -> DataFrame:
    """image, fields and boxes of the synthetic cards; boxes are those of a font whose characters are all so wide and high.

    Cards aren't drawn: that takes fonts and an image library.
    """
    rows = []
    for i, record in enumerate(RECORDS, 1):
        card = dict(zip(CARD_KEYS, record))
        top = [112 + 78 * k for k in range(len(FIELDS))]
        boxes = {f: [296, y - 4, 304 + char_width * len(card[f]), y + char_height + 4] for f, y in zip(FIELDS, top)}
        rows.append((f"synthetic_{i:02d}.jpg", card, boxes))
    return spark.createDataFrame(rows, "image string, fields map<string, string>, boxes map<string, array<int>>")
