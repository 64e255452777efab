"""Small lookups for display."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.schemas import FIELD_LABELS, STATUS_CLASSES, STATUS_COLOURS


def _looked_up(c: Column, words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(words.items())])[c]


def field_label(field: Column) -> Column:
    return F.coalesce(_looked_up(field, FIELD_LABELS), field)


def status_class(status: Column) -> Column:
    return _looked_up(status, STATUS_CLASSES)


def status_colour(status: Column) -> Column:
    return _looked_up(status, STATUS_COLOURS)


def confidence_class(c: Column) -> Column:
    """ok from 85, mid from 65 and for unknown, else low."""
    return F.when(c.isNull(), "mid").when(c >= 85, "ok").when(c >= 65, "mid").otherwise("low")


def confidence_colour(c: Column) -> Column:
    return F.when(c >= 85, STATUS_COLOURS["ok"]).when(c >= 65, STATUS_COLOURS["review"]).otherwise(STATUS_COLOURS["missing"])


def confidence_label(c: Column) -> Column:
    return F.coalesce(F.concat(F.floor(c + 0.5).cast("string"), F.lit("%")), F.lit("n/a"))


def agreement_label(matched: Column, compared: Column) -> Column:
    """A dash where nothing was compared: that is no disagreement."""
    return F.when(compared == 0, "—").otherwise(F.concat_ws("/", matched.cast("string"), compared.cast("string")))


def seconds_label(ms: Column) -> Column:
    return F.when(ms.isNotNull(), F.format_string("%.1fs", ms / 1000))


def short_model(model: Column) -> Column:
    return F.substring_index(model, "/", -1)


def api_base(query: Column, stored: Column) -> Column:
    """The first that isn't empty of the query's and the stored address, without slashes at its end; else empty."""
    chosen = F.coalesce(F.nullif(query, F.lit("")), F.nullif(stored, F.lit("")), F.lit(""))
    return F.regexp_replace(chosen, r"/+\z", "")
