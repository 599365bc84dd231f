"""Plane geometry on double columns: boxes, segments, rings of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("min_x", "min_y", "max_x", "max_y")


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def overlaps(a: list[Column], b: list[Column]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def contains_point(a: list[Column], x: Column, y: Column) -> Column:
    return x.between(a[0], a[2]) & y.between(a[1], a[3])


def area(a: list[Column]) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def iou(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def box_distance(a: list[Column], b: list[Column]) -> Column:
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def centre(a: list[Column]) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    x, y = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(x * x + y * y)


def turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross properly."""
    d1, d2 = turn(*a, b[0], b[1]), turn(*a, b[2], b[3])
    d3, d4 = turn(*b, a[0], a[1]), turn(*b, a[2], a[3])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_area(ring: Column) -> Column:
    """Area of a ring of points struct(x, y), by the shoelace formula."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))
    return F.abs(twice) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray parity of a point in a ring."""

    def flip(inside, e):
        p, q = e["p"], e["q"]
        above = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(None)).otherwise(q["y"] - p["y"]) + p["x"]
        return F.when(above & (x < at), ~inside).otherwise(inside)

    return F.aggregate(_edges(ring), F.lit(False), flip)


def representative(location: Column, insert: Column, centre_: Column, start: Column, middle: Column) -> Column:
    return F.coalesce(location, insert, centre_, start, middle)


def cells(a: list[Column], size: float | Column) -> Column:
    """Grid cells that a box touches, for an equi-join of boxes."""
    xs = F.sequence(F.floor(a[0] / size), F.floor(a[2] / size))
    ys = F.sequence(F.floor(a[1] / size), F.floor(a[3] / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def level(a: list[Column], size: float) -> Column:
    """The grid of a box: cells of size * 2**level are no smaller than it, so that it touches two by two of them at most."""
    extent = F.greatest(a[2] - a[0], a[3] - a[1])
    return F.when(extent > size, F.ceil(F.log2(extent / size))).otherwise(0).cast("int")


def line_cells(a: list[Column], size: Column) -> Column:
    """Cells that a segment (x1, y1, x2, y2) runs through, column by column; edges count for both sides."""
    x1, y1, x2, y2 = a
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    edge = size * 1e-9
    steep = (y2 - y1) / F.when(x2 != x1, x2 - x1)
    at = lambda x: y1 + (F.greatest(low, F.least(high, x)) - x1) * steep

    def rows(cx: Column) -> Column:
        p, q = F.coalesce(at(cx * size), y1), F.coalesce(at((cx + 1) * size), y2)
        ys = F.sequence(F.floor((F.least(p, q) - edge) / size), F.floor((F.greatest(p, q) + edge) / size))
        return F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor((low - edge) / size), F.floor((high + edge) / size)), rows))
