"""The seam to a model: requests in, replies out, keyed by document, reading and attempt.

Readings: A on the image, B on its contrast variant, C for boxes, T for a transcription.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import geometry
from fieldmark.operators.devices import Device, NoDevice, peak
from fieldmark.schemas import CARD_KEYS, FIELDS
from fieldmark.settings import Settings

#: Prompts are parameters of an engine's operator; these are plain defaults.
FIELD_PROMPT = (
    "Read the identity card in the image and answer with one JSON object and nothing else. Its keys are: "
    + ", ".join(CARD_KEYS)
    + ". Give dates as YYYY-MM-DD and sex as M or F. Put Latin text under the plain keys and Arabic text under those ending in _ar. "
    "Use null for whatever you can't read; never guess and never derive one value from another."
)
BOX_PROMPT = "Find these printed fields: " + ", ".join(FIELDS) + ". Answer with one JSON object of field names to bbox_2d as [x1, y1, x2, y2] in pixels. Leave out what you can't find."
TEXT_PROMPT = "Write down all printed text of the card, line by line, as it stands."

REQUEST_KEYS = ("doc_id", "reading", "attempt")


def retry_prompt(error: Column, prompt: str = FIELD_PROMPT) -> Column:
    return F.concat(F.lit(prompt + "\n\nThe last answer could not be used: "), error, F.lit(". Answer with the JSON object alone."))


def requests(docs: DataFrame, settings: Settings = Settings(), transcribe: bool = False) -> DataFrame:
    """doc_id, reading, attempt, variant, prompt of the first round; B and C only where the settings ask for them."""
    rows = [("A", "original", FIELD_PROMPT)]
    rows += [("B", "contrast", FIELD_PROMPT)] if settings.self_consistency else []
    rows += [("C", "original", BOX_PROMPT)] if settings.show_boxes else []
    rows = [("T", "original", TEXT_PROMPT)] if transcribe else rows
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("reading"), F.lit(v).alias("variant"), F.lit(p).alias("prompt")) for r, v, p in rows]))
    return docs.select("doc_id", each.alias("r")).select("doc_id", "r.reading", F.lit(1).alias("attempt"), "r.variant", "r.prompt")


class Engine(Protocol):
    """Replies (doc_id, reading, attempt, text) for requests."""

    model_id: str
    device: str

    def generate(self, requests: DataFrame) -> DataFrame: ...


class ScriptedEngine:
    """Replies from a table keyed by document, reading and attempt; a request without a reply is an error when it is met."""

    device = "none"

    def __init__(self, replies: DataFrame, model_id: str = "scripted"):
        self.replies, self.model_id = replies, model_id

    def generate(self, requests: DataFrame) -> DataFrame:
        found = requests.select(*REQUEST_KEYS).join(self.replies.select(*REQUEST_KEYS, F.col("text").alias("_text")), list(REQUEST_KEYS), "left")
        lost = F.raise_error(F.concat(F.lit("no scripted reply for document "), F.col("doc_id").cast("string"), F.lit(", reading "), F.col("reading"), F.lit(", attempt "), F.col("attempt").cast("string")))
        return found.select(*REQUEST_KEYS, F.when(F.col("_text").isNull(), lost.cast("string")).otherwise(F.col("_text")).alias("text"))


class ExpressionEngine:
    """Replies by a column expression over the request's columns."""

    device = "none"

    def __init__(self, reply: Callable[[DataFrame], Column], model_id: str = "expression"):
        self.reply, self.model_id = reply, model_id

    def generate(self, requests: DataFrame) -> DataFrame:
        return requests.select(*REQUEST_KEYS, self.reply(requests).alias("text"))


@dataclass(frozen=True)
class Bounds:
    """What a batch may hold: so many requests, prompt tokens (as padded: all as long as the longest) and pixels.

    A request that is beyond a bound by itself is a batch of its own. window: requests that are planned together.
    """

    requests: int = 24
    tokens: int = 16_384
    pixels: int = 24 * 1280 * 28 * 28
    window: int = 2048


def planned(tokens: list[int], pixels: list[int], bounds: Bounds) -> list[list[int]]:
    """Batches of indexes: requests from the longest to the shortest, each batch filled as far as the bounds allow.

    Neighbours in length are padded least. Each index is in one batch.
    """
    batches: list[list[int]] = []
    longest = seen = 0
    for i in sorted(range(len(tokens)), key=lambda i: (-tokens[i], i)):
        now = batches[-1] if batches else []
        if now and len(now) < bounds.requests and longest * (len(now) + 1) <= bounds.tokens and seen + pixels[i] <= bounds.pixels:
            now.append(i)
            seen += pixels[i]
        else:
            batches.append([i])
            longest, seen = tokens[i], pixels[i]
    return batches


def rough_tokens(prompts: list[str]) -> list[int]:
    """A stand-in for a model's tokenizer: one token for every three bytes begun."""
    return [(len(p.encode()) + 2) // 3 for p in prompts]


class BatchEngine:
    """Replies by a Python model that is loaded once in each task and called with batches.

    load: returns a function from a list of (prompt, image bytes or None) to a list of replies; it may take the name of its
    device. It runs on executors, so heavy imports belong inside it. With most_new_tokens, the function gets that cap on a
    reply's length as a second argument. check: runs on the driver first; where the device is a Device, a session that
    doesn't offer it is refused before any work, and the stage asks for it by a resource profile. warm_up: a batch that each
    task asks its model first, unanswered, so that no document waits for what only first calls do. tokens: the lengths of
    prompts, by the model's tokenizer. used_mb: the memory that the model's device has held at most; the largest of all
    tasks is in ``peak_mb`` once a job is done.

    A task's requests are planned into batches by length within Bounds; replies come in the order of the keys, each request
    is asked once. tasks: among how many requests are dealt, such as the devices there are; otherwise Spark decides by their
    bytes, which say little about a model's work. A column ``pixels`` or the columns w and h tell an image's size, else an image has the most that Settings allow.
    """

    def __init__(
        self, load: Callable[..., Callable], model_id: str, device: str | Device = "any", check: Callable[[], None] | None = None, bounds: Bounds = Bounds(), warm_up: list[tuple] = (),
        tokens: Callable[[list[str]], list[int]] = rough_tokens, most_new_tokens: int | None = None, used_mb: Callable[[], int] | None = None, grid: geometry.Grid | None = None, tasks: int | None = None,
    ):
        self.load, self.model_id, self.check, self.bounds, self.warm_up = load, model_id, check, bounds, list(warm_up)
        self.needs = device if isinstance(device, Device) else None
        self.device = device.name if isinstance(device, Device) else device
        self.tokens, self.most_new_tokens, self.used_mb, self.grid, self.tasks = tokens, most_new_tokens, used_mb, grid, tasks
        self.peak_mb = None

    def _loader(self) -> Callable[[], Callable]:
        load, first, needs, cap = self.load, self.warm_up, self.needs, self.most_new_tokens

        def loaded() -> Callable:
            model = load(needs.in_task()) if needs and inspect.signature(load).parameters else load()
            ask = model if cap is None else lambda batch: model(batch, cap)
            if first:
                ask(first)
            return ask

        return loaded

    def _refuse(self, spark) -> None:
        if self.check:
            self.check()
        if self.needs:
            self.needs.checked(spark)

    def generate(self, requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        self._refuse(spark)
        load, bounds, tokens, used_mb = self._loader(), self.bounds, self.tokens, self.used_mb
        if used_mb and self.peak_mb is None:
            self.peak_mb = peak(spark)
        held = self.peak_mb
        has_image = "image" in requests.columns
        size = F.col("pixels") if "pixels" in requests.columns else F.col("w") * F.col("h") if {"w", "h"} <= {*requests.columns} else F.lit(None)
        most = F.lit(Settings().max_pixels if has_image else 0)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                for at in range(0, len(frame), bounds.window):
                    part = frame.iloc[at : at + bounds.window]
                    model = model or load()
                    asked = list(zip(part["prompt"], part["image"] if has_image else [None] * len(part)))
                    texts: list = [None] * len(part)
                    for batch in planned(tokens(list(part["prompt"])), part["_pixels"].tolist(), bounds):
                        said = model([asked[i] for i in batch])
                        if len(said) != len(batch):
                            raise ValueError(f"{len(batch)} requests but {len(said)} replies")
                        for i, text in zip(batch, said):
                            texts[i] = text
                    yield part[list(REQUEST_KEYS)].assign(text=texts)
            if held is not None and model:
                held.add(int(used_mb()))

        sized = requests.select(*REQUEST_KEYS, "prompt", *(["image"] if has_image else []), F.coalesce(size.cast("long"), most.cast("long")).alias("_pixels"))
        near = sized.repartition(*([self.tasks] if self.tasks else []), "doc_id").sortWithinPartitions(*REQUEST_KEYS)
        return near.mapInPandas(run, "doc_id long, reading string, attempt int, text string", profile=self.needs.of_stage(spark) if self.needs else None)

    def ready(self, spark) -> tuple[bool, int | None]:
        """Whether an executor can load the model and answer the warm-up, and in how many milliseconds."""
        try:
            self._refuse(spark)
        except NoDevice:
            return False, None
        load = self._loader()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                start = time.perf_counter()
                try:
                    load()
                    yield pd.DataFrame({"loaded": [True] * len(frame), "ms": [int(1000 * (time.perf_counter() - start))] * len(frame)})
                except Exception:  # noqa: BLE001  a model's own error, which health tells as not loaded
                    yield pd.DataFrame({"loaded": [False] * len(frame), "ms": [-1] * len(frame)})

        loaded, ms = spark.range(1).coalesce(1).mapInPandas(run, "loaded boolean, ms long", profile=self.needs.of_stage(spark) if self.needs else None).first()
        return loaded, ms if loaded else None


def engine_info(spark, engine: Engine, settings: Settings = Settings(), vram_mb: int | None = None) -> DataFrame:
    """One row of health. An engine that has a model to load is asked to; the others are always ready.

    vram_mb: given, or else the most that the engine's tasks have told of.
    """
    loaded, warmup_ms = engine.ready(spark) if hasattr(engine, "ready") else (True, None)
    told = getattr(engine, "peak_mb", None)
    vram_mb = told.value if vram_mb is None and told is not None else vram_mb
    row = (engine.model_id, engine.device, loaded, settings.self_consistency, warmup_ms, vram_mb)
    return spark.createDataFrame([row], "model string, device string, loaded boolean, self_consistency boolean, warmup_ms int, vram_mb int")
