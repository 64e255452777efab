"""Pixels: the contrast variant of an image for the second reading, and size policy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions import geometry as g

# BT.601 weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def contrast_pixels(data: bytes, height: int, width: int, channels: int) -> bytes:
    """Grey by luma, stretched from its least and most to 0..255, in three equal channels.

    Pixels come as Spark's image source gives them: blue first; one channel is grey; of four the last, alpha, is dropped.
    A flat image becomes 0 everywhere.
    """
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float32)
    if channels == 1:
        raw = np.repeat(raw, 3, axis=2)
    red, green, blue = np.array(LUMA, np.float32)
    grey = raw[:, :, 2] * red + raw[:, :, 1] * green + raw[:, :, 0] * blue
    low, high = float(grey.min()), float(grey.max())
    # divided first, so that the brightest is exactly 1 and becomes 255
    stretched = np.clip((grey - low) / max(1.0, high - low) * 255.0, 0, 255).astype(np.uint8)
    return np.repeat(stretched[:, :, None], 3, axis=2).tobytes()


@F.pandas_udf(T.BinaryType())
def _contrast(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, height, width, channels in parts:
        yield pd.Series([None if d is None or h <= 0 or w <= 0 else contrast_pixels(d, h, w, c) for d, h, w, c in zip(data, height, width, channels)])


def contrast_normalise(images: DataFrame, image: str = "image") -> DataFrame:
    """images with ``contrast``: the variant's pixels, height x width x 3; null for images that can't be read."""
    i = F.col(image)
    return images.withColumn("contrast", _contrast(i["data"], i["height"], i["width"], i["nChannels"]))


def resize_policy(sizes: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """sizes with factor, out_w and out_h: long sides end at most at 1600, short images grow towards 900 by two at most."""
    sizes = sizes.withColumn("factor", g.scale_factor(F.col(w), F.col(h)))
    return sizes.withColumns({"out_w": g.resized(F.col(w), F.col("factor")), "out_h": g.resized(F.col(h), F.col("factor"))})
