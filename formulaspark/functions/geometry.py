"""Bounding boxes as column expressions over ``x, y, w, h``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Columns of a box; every method is one expression."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + c) for c in "xywh"))

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def center_x(self) -> Column:
        return self.x + self.w / 2

    @property
    def center_y(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def aspect_ratio(self) -> Column:
        return self.w / _one(self.h)

    @property
    def size(self) -> Column:
        return F.greatest(self.w, self.h)

    def to_tuple(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))

    def to_rect(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.x2.alias("x2"), self.y2.alias("y2"))

    def expand(self, margin: int) -> Box:
        zero = F.lit(0)
        return Box(F.greatest(zero, self.x - margin), F.greatest(zero, self.y - margin), self.w + 2 * margin, self.h + 2 * margin)

    def _common(self, other: Box) -> tuple[Column, Column, Column, Column]:
        return F.greatest(self.x, other.x), F.greatest(self.y, other.y), F.least(self.x2, other.x2), F.least(self.y2, other.y2)

    def intersects(self, other: Box) -> Column:
        x1, y1, x2, y2 = self._common(other)
        return (x1 < x2) & (y1 < y2)

    def intersection(self, other: Box) -> Column:
        """The common box, null unless it has an extent in both directions."""
        x1, y1, x2, y2 = self._common(other)
        return F.when(self.intersects(other), Box(x1, y1, x2 - x1, y2 - y1).to_tuple())

    def union(self, other: Box) -> Box:
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return Box(x, y, F.greatest(self.x2, other.x2) - x, F.greatest(self.y2, other.y2) - y)

    def iou(self, other: Box) -> Column:
        x1, y1, x2, y2 = self._common(other)
        both = F.when(self.intersects(other), (x2 - x1) * (y2 - y1)).otherwise(0)
        return both / _one(self.area + other.area - both)

    def vertical_overlap(self, other: Box) -> Column:
        both = F.least(self.y2, other.y2) - F.greatest(self.y, other.y)
        return F.greatest(F.lit(0), both) / _one(F.least(self.h, other.h))

    def horizontal_overlap(self, other: Box) -> Column:
        both = F.least(self.x2, other.x2) - F.greatest(self.x, other.x)
        return F.greatest(F.lit(0), both) / _one(F.least(self.w, other.w))

    def distance(self, other: Box) -> Column:
        return F.hypot(self.center_x - other.center_x, self.center_y - other.center_y)

    def coverage(self, other: Box) -> Column:
        """Share of the other's width that lies above or below this box."""
        both = F.least(self.x2, other.x2) - F.greatest(self.x, other.x)
        return F.greatest(F.lit(0), both) / _one(other.w)


def _one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))
