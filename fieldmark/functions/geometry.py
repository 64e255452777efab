"""Boxes and image sizes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a printed field's box may be, as parts of the image; how far it may overshoot; shared claims.
MIN_AREA, MAX_AREA, MIN_ASPECT, MAX_ASPECT, MIN_HEIGHT, MAX_HEIGHT = 0.0005, 0.40, 0.5, 30.0, 0.01, 0.25
OVERSHOOT, MAX_CLAIMS = 0.02, 2
LARGEST, SMALLEST, MOST_ENLARGED = 1600, 900, 2.0


def rescaled(x: Column, of: Column, to: Column) -> Column:
    """A coordinate in another size of the image, rounded half to even."""
    return F.rint(x * (to / of)).cast("int")


def in_reach(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Whether no edge lies further outside the image than rounding explains."""
    return (x1 >= -w * OVERSHOOT) & (y1 >= -h * OVERSHOOT) & (x2 <= w + w * OVERSHOOT) & (y2 <= h + h * OVERSHOOT)


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1), F.least(w, x2), F.least(h, y2)


def plausible(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    bw, bh = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    fits = (bw * bh / (w * h).cast("double")).between(MIN_AREA, MAX_AREA) & F.try_divide(bw, bh).between(MIN_ASPECT, MAX_ASPECT) & (bh / h).between(MIN_HEIGHT, MAX_HEIGHT)
    return (x2 > x1) & (y2 > y1) & F.coalesce(fits, F.lit(False))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where they don't overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = w.cast("long") * h
    area = lambda q: (q[2] - q[0]).cast("long") * (q[3] - q[1])
    return F.when((w > 0) & (h > 0), shared / (area(a) + area(b) - shared)).otherwise(0.0)


def scale_factor(w: Column, h: Column) -> Column:
    side = F.greatest(w, h)
    return F.when(side > LARGEST, LARGEST / side).when(side < SMALLEST, F.least(F.lit(MOST_ENLARGED), SMALLEST / side)).otherwise(1.0)


def resized(x: Column, factor: Column) -> Column:
    """Half rounds up, as pixels of a canvas do."""
    return F.floor(x * factor + 0.5).cast("int")


@dataclass(frozen=True)
class Grid:
    """The size that a vision model works on: sides of whole cells, with an area between the least and the most pixels.

    A cell is a patch's side times the patches that are merged; the size is the grid of patches times the patch's side.
    """

    patch: int = 14
    merged: int = 2
    least: int = 256 * 28 * 28
    most: int = 1280 * 28 * 28
    #: Images that are longer than so many times their other side aren't worked on.
    longest: int = 200

    def cells(self, w: Column, h: Column) -> tuple[Column, Column]:
        """Patches across and down; null where an image has no size or is too long."""
        cell = self.patch * self.merged
        w, h = w.cast("double"), h.cast("double")
        near = [F.greatest(F.lit(float(cell)), F.rint(x / cell) * cell) for x in (w, h)]
        small, large = F.sqrt(w * h / self.most), F.sqrt(F.lit(float(self.least)) / (w * h))
        down = [F.greatest(F.lit(float(cell)), F.floor(x / small / cell) * cell) for x in (w, h)]
        up = [F.ceil(x * large / cell) * cell for x in (w, h)]
        area = near[0] * near[1]
        fits = (w > 0) & (h > 0) & (F.greatest(w, h) / F.least(w, h) <= self.longest)
        side = lambda i: F.when(fits, F.when(area > self.most, down[i]).when(area < self.least, up[i]).otherwise(near[i]))
        return tuple((side(i) / self.patch).cast("int") for i in (0, 1))

    def processed(self, w: Column, h: Column) -> tuple[Column, Column]:
        """The processed width and height: the grid times the patch's side, or the image's own size where there is no grid."""
        across, down = self.cells(w, h)
        return F.coalesce(across * self.patch, w.cast("int")), F.coalesce(down * self.patch, h.cast("int"))
