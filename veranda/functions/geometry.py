"""Rectangles and points as Column functions. A rectangle is a struct x0, y0, x1, y1 or four columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect_distance(x0, y0, x1, y1, px, py) -> Column:
    """0 inside."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - px, zero, px - x1), F.greatest(y0 - py, zero, py - y1))


def overlaps(a, b) -> Column:
    """Whether two rectangles (tuples of four columns) share more than an edge."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def page_scale(width: Column) -> Column:
    return F.greatest(F.lit(1.0), width / 900)


def output_page(new_page: Column, page: Column) -> Column:
    return F.coalesce(new_page, page)


def anchor_point(snap: Column, vertices: Column, tip: Column, rect: Column) -> Column:
    centre = F.struct(((rect["x0"] + rect["x1"]) / 2).alias("x"), ((rect["y0"] + rect["y1"]) / 2).alias("y"))
    return F.coalesce(snap, F.get(vertices, F.lit(0)), tip, centre)


def quarter_direction(turn: Column) -> Column:
    """The unit vector of a quarter turn 0..3: right, down, left, up (y counts down)."""
    vectors = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))])
    return F.element_at(vectors, F.pmod(turn, F.lit(4)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    """The middle value, of an even number the upper one."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def fitting_size(height, room: Column, start: float = 8.0, shrink: float = 0.9, least: float = 3.0) -> Column:
    """The first size of start, start * shrink, start * shrink ** 2, ... at which a text fits, or the first not over least. height: the text's height per unit of size, or a
    function of the size, whose order of products decides where a text fits just so."""
    of = height if callable(height) and not isinstance(height, Column) else lambda v: v * height
    sizes, k = [start], 0
    while sizes[-1] > least:
        sizes.append(start * shrink ** (k := k + 1))
    listed = F.array(*map(F.lit, sizes))
    return F.coalesce(F.get(F.filter(listed, lambda v: (of(v) <= room) | (v <= least)), F.lit(0)), F.lit(sizes[-1]))


#: Codes of annotation types; a pin's dot radius, its body's distance in radii and its point's radius in radii.
FREE_TEXT, LINE, SQUARE, CIRCLE_BOX, POPUP = 2, 3, 4, 8, 15
DOT_RADIUS, BODY_DISTANCE, POINT_RADIUS, SIDEBAR = 11.0, 2.0, 0.26, 200.0
Rect = tuple[Column, Column, Column, Column]


def rect_of(c: Column) -> Rect:
    return c["x0"], c["y0"], c["x1"], c["y1"]


def as_struct(r: Rect) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)])


def offset(r: Rect, dx: Column, dy: Column) -> Rect:
    return r[0] + dx, r[1] + dy, r[2] + dx, r[3] + dy


def union(a: Rect, b: Rect) -> Rect:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def intersection(a: Rect, b: Rect) -> Rect:
    """Empty (no width or height over 0) where the rectangles don't meet."""
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def contains(a: Rect, b: Rect) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def area(r: Rect) -> Column:
    return F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))


def middle(r: Rect) -> tuple[Column, Column]:
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def search_point(code: Column, vertices: Column, r: Rect) -> Column:
    """struct(x, y) around which an annotation's picture is sought: a callout's tip, a box's middle, null for others."""
    x, y = middle(r)
    return F.when((code == FREE_TEXT) & (F.size(vertices) > 0), F.get(vertices, F.lit(0))).when(code == SQUARE, F.struct(x.alias("x"), y.alias("y")))


def pin_turn(vertices: Column, r: Rect, tip: Column) -> Column:
    """0 (body to the right of the point) or 2 (to the left): the side that the callout's line came from, else that of the rectangle's middle."""
    far = F.when(F.size(vertices) >= 2, F.element_at(vertices, -1)["x"] - F.get(vertices, F.lit(0))["x"]).otherwise(middle(r)[0] - tip["x"])
    return F.when(far >= 0, 0).otherwise(2)


def pin(tip: Column, turn: Column, scale: Column) -> Column:
    """struct(px, py, cx, cy, x0, y0, x1, y1) of a pin: its point, two units off the tip, its body's centre, and the box around all of it."""
    d, r = quarter_direction(turn), scale * DOT_RADIUS
    px, py = tip["x"] + d["dx"] * 2 * scale, tip["y"] + d["dy"] * 2 * scale
    cx, cy = px + d["dx"] * r * BODY_DISTANCE, py + d["dy"] * r * BODY_DISTANCE
    point, pad = r * POINT_RADIUS, 2 + r * 0.1
    box = (F.least(cx - r, px - point) - pad, F.least(cy - r, py - point) - pad, F.greatest(cx + r, px + point) + pad, F.greatest(cy + r, py + point) + pad)
    return F.struct(px.alias("px"), py.alias("py"), cx.alias("cx"), cy.alias("cy"), *[v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


def box_rect(edit: Column, width: Column, height: Column, new: Column) -> Column:
    """An edited box (fx, fy, fw, fh as fractions of the page) in points, else the new rectangle."""
    r = (edit["fx"] * width, edit["fy"] * height, (edit["fx"] + edit["fw"]) * width, (edit["fy"] + edit["fh"]) * height)
    return F.when(edit.isNotNull(), as_struct(r)).otherwise(new)
