"""Field boxes: claims that too many fields share are dropped, the rest is rescaled, bounded, clamped and judged, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import geometry as g
from fieldmark.functions.binding import bind
from fieldmark.schemas import FIELDS

CORNERS = ("x1", "y1", "x2", "y2")


def shared_claims(boxes: DataFrame, *keys: str) -> DataFrame:
    """Known fields' boxes with ``claims``: how many known fields of the document claim the same raw box."""
    known = boxes.where(F.col("field").isin(*FIELDS))
    # dealt by the document alone, which serves this window and whatever follows by document
    return known.repartition(*keys).withColumn("claims", F.count(F.lit(1)).over(Window.partitionBy(*keys, *CORNERS)))


def _in_original(box: dict[str, Column], pw: Column, ph: Column, w: Column, h: Column) -> tuple[Column, list[Column]]:
    """Whether a claimed box can be a field's, and its corners in the original image."""
    scaled = [g.rescaled(box[c], *((pw, w) if c[0] == "x" else (ph, h))) for c in CORNERS]
    corners = g.clamped(*scaled, w, h)
    return g.in_reach(*scaled, w, h) & g.plausible(*corners, w, h), list(corners)


def filter_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, field and corners in the original image of the boxes that are left.

    boxes: keys, field, corners, and the sizes pw, ph (processed) and w, h (original); a null processed size is the original's.
    Sizes must be positive, other rows are dropped.
    """
    sized = boxes.withColumns({"pw": F.coalesce("pw", "w"), "ph": F.coalesce("ph", "h")}).where("pw > 0 AND ph > 0 AND w > 0 AND h > 0")
    once = shared_claims(sized, *keys).where(F.col("claims") <= g.MAX_CLAIMS)
    fits, corners = _in_original({c: F.col(c) for c in CORNERS}, F.col("pw"), F.col("ph"), F.col("w"), F.col("h"))
    return once.where(fits).select(*keys, "field", *[c.alias(n) for c, n in zip(corners, CORNERS)])


def filtered(boxes: Column, pw: Column, ph: Column, w: Column, h: Column) -> Column:
    """filter_boxes for one document whose boxes are an array of (field, corners); null sizes or none leave no box."""
    known = F.filter(boxes, lambda b: b["field"].isin(*FIELDS))

    def left(mine: Column) -> Column:
        claims = lambda b: F.size(F.filter(mine, lambda o: (o["x1"] == b["x1"]) & (o["y1"] == b["y1"]) & (o["x2"] == b["x2"]) & (o["y2"] == b["y2"])))
        once = F.filter(mine, lambda b: claims(b) <= g.MAX_CLAIMS)

        def moved(b: Column) -> Column:
            fits, corners = _in_original({c: b[c] for c in CORNERS}, pw, ph, w, h)
            return F.when(fits, F.struct(b["field"].alias("field"), *[c.alias(n) for c, n in zip(corners, CORNERS)]))

        return F.array_compact(F.transform(once, moved))

    sized = (pw > 0) & (ph > 0) & (w > 0) & (h > 0)
    return F.when(sized, bind(known, left))


def box_of(boxes: Column, field: Column) -> Column:
    """The corners of a field's box in an array of (field, corners), or null; of several, the first."""
    b = F.get(F.filter(boxes, lambda b: b["field"] == field), F.lit(0))
    return F.when(b.isNotNull(), F.struct(*[b[c].alias(c) for c in CORNERS]))


def attach_boxes(fields: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """Long fields with ``box``, also for missing fields; null where none is left, the least of several.

    A document's boxes come together first, so that the join goes by the document, as the steps before it do.
    """
    of_document = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("field", *CORNERS))).alias("_boxes"))
    return fields.join(of_document, list(keys), "left").withColumn("box", box_of(F.col("_boxes"), F.col("field"))).drop("_boxes")
