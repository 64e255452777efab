"""The whole extraction: requests, replies, one retry, merge, boxes, response.

Replies are stored as tables before anything branches on them, so that an expensive or random model runs once for each
request, also if executors are lost. Only replies that couldn't be parsed are asked for again: of A always, of B where A
could be. A document's replies then come together in one row, and all that follows is a projection of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.text import strip
from fieldmark.operators.boxes import box_of, filtered
from fieldmark.operators.inference import Engine, requests, retry_prompt
from fieldmark.operators.merge import merge_passes
from fieldmark.operators.parsing import boxes_of, parse_card
from fieldmark.schemas import CARD, FIELDS
from fieldmark.settings import Settings
from fieldmark.sources.writers import stored

#: Makes a table of a frame and reads it back; writers.stored, or a writers.Stored that deletes its tables afterwards.
Keep = Callable[[DataFrame], DataFrame]


def _parsed(replies: DataFrame) -> DataFrame:
    """Replies with card and error; those to C are kept for their boxes and have neither."""
    asked = replies.select("doc_id", "reading", "attempt", "text", F.when(F.col("reading") != "C", F.col("text")).alias("_said"))
    is_card = F.col("reading") != "C"
    return parse_card(asked, "_said").withColumn("error", F.when(is_card, F.col("error"))).drop("_said")


def _again(failed: DataFrame) -> DataFrame:
    variant = F.when(F.col("reading") == "B", "contrast").otherwise("original")
    return failed.select("doc_id", "reading", F.lit(2).alias("attempt"), variant.alias("variant"), retry_prompt(F.col("error")).alias("prompt"))


def resolve_replies(engine: Engine, first: DataFrame, keep: Keep = stored) -> DataFrame:
    """doc_id, a, b (cards or null), boxes (the reply to C), raw_text and error of each document, from the first round's replies.

    raw_text is the reply to A that was parsed, or the last one where none was; error is what A's first reply failed by.
    Replies are stored with what they were parsed to. The second round asks for A again, and for B where A came out at once;
    B of the documents whose A came out in the second round is asked last, on its own variant as before.
    """
    parsed = keep(_parsed(first))
    failed = parsed.where("error IS NOT NULL")
    lost_a, lost_b = failed.where("reading = 'A'"), failed.where("reading = 'B'")
    second = keep(_parsed(engine.generate(_again(lost_a.unionByName(lost_b.join(lost_a, "doc_id", "left_anti"))))))
    saved = second.where("reading = 'A' AND card IS NOT NULL").select("doc_id")
    third = _parsed(engine.generate(_again(lost_b.join(saved, "doc_id", "left_semi"))))
    replies = parsed.unionByName(second).unionByName(third)
    is_ = lambda r, n: (F.col("reading") == r) & (F.col("attempt") == n)
    of = lambda c, r, n: F.max(F.when(is_(r, n), F.col(c)))
    raw = F.coalesce(F.max(F.when(is_("A", 1) & F.col("card").isNotNull(), F.col("text"))), of("text", "A", 2), of("text", "A", 1))
    return replies.groupBy("doc_id").agg(
        F.coalesce(of("card", "A", 1), of("card", "A", 2)).alias("a"), F.coalesce(of("card", "B", 1), of("card", "B", 2)).alias("b"), of("text", "C", 1).alias("boxes"), raw.alias("raw_text"), of("error", "A", 1).alias("error"),
    )


def extract_fields(resolved: DataFrame, as_of=None) -> DataFrame:
    """Merged cards; a document whose A never parsed has all fields missing, no agreement and B ignored."""
    blank = F.struct(*[F.lit(None).cast("string").alias(f.name) for f in CARD])
    usable = resolved.withColumns({"b": F.when(F.col("a").isNotNull(), F.col("b")), "a": F.coalesce("a", blank), "readable": F.col("a").isNotNull()})
    return merge_passes(usable, as_of)


def extract(docs: DataFrame, engine: Engine, settings: Settings = Settings(), as_of=None, keep: Keep = stored) -> DataFrame:
    """One response for each document: doc_id, fields (map of field results), raw_text, agreement, elapsed_ms, model.

    docs: doc_id, w, h and, where the model works on another size, pw, ph; elapsed_ms if it is measured. Without pw and ph,
    an engine with a grid works on the size that its grid gives.
    """
    merged = extract_fields(resolve_replies(engine, engine.generate(requests(docs, settings)), keep), as_of)
    if (grid := getattr(engine, "grid", None)) and {"w", "h"} <= {*docs.columns} and not {"pw", "ph"} & {*docs.columns}:
        docs = docs.withColumns(dict(zip(("pw", "ph"), grid.processed(F.col("w"), F.col("h")))))
    given = [F.col(c) if c in docs.columns else F.lit(None).cast("int").alias(c) for c in ("pw", "ph", "w", "h", "elapsed_ms")]
    rows = merged.join(docs.select("doc_id", *given), "doc_id")
    if settings.show_boxes:
        # boxes belong to documents whose A came out
        sizes = [F.coalesce("pw", "w"), F.coalesce("ph", "h"), F.col("w"), F.col("h")]
        rows = rows.withColumn("left", F.when(F.col("readable"), filtered(boxes_of(F.col("boxes")), *sizes)))
    else:
        rows = rows.withColumn("left", F.lit(None).cast("array<struct<field:string,x1:int,y1:int,x2:int,y2:int>>"))
    result = lambda f: F.struct(f["value"], f["value_ar"], f["status"], f["reason"], box_of(F.col("left"), f["field"]).alias("box"))
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], result(f))))
    return rows.select("doc_id", fields.alias("fields"), "raw_text", "agreement", "elapsed_ms", F.lit(engine.model_id).alias("model"))


def all_missing(fields=FIELDS) -> dict:
    """What an unreadable document's fields look like, for comparison in tests."""
    return {f: {"value": None, "value_ar": None, "status": "missing", "reason": None, "box": None} for f in fields}


def transcribe(docs: DataFrame, engine: Engine) -> DataFrame:
    """doc_id and the stripped transcription."""
    return engine.generate(requests(docs, transcribe=True)).select("doc_id", strip(F.col("text")).alias("text"))
