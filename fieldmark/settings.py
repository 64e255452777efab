"""Settings from the session (spark.fieldmark.<name>), then the environment (<NAME>), then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    model_id: str = "scripted"
    device: str = "auto"
    torch_dtype: str = "float16"
    max_new_tokens: int = 256
    min_pixels: int = 256 * 28 * 28
    max_pixels: int = 1280 * 28 * 28
    self_consistency: bool = True
    show_boxes: bool = True
    #: Images of cards are never written unless this is on; the engine has no writer for them and refuses.
    debug_save_images: bool = False

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.fieldmark.{f.name}", None) if spark else None
            text = os.environ.get(f.name.upper()) if text is None else text
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return cls(**found)
