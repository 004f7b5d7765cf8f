"""Columns over face meshes (array<struct<x,y,z>> of 478 points) and over drawings of faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gaze import LEFT_IRIS, RIGHT_IRIS

#: The outer corners of the eyes in the mesh.
OUTER_CORNERS = (33, 263)


def _point(points: Column, i: int) -> Column:
    return F.element_at(points, i + 1)


def points_of_row(columns: Sequence[str], layout: str = "axis", dims: int = 3) -> Column:
    """array<struct> of flat columns: 'axis' has all x, then all y …; 'point' has x, y, z of each point in turn.

    Mixing the two scrambles points, so the layout is always said.
    """
    n = len(columns) // dims
    at = (lambda p, d: columns[d * n + p]) if layout == "axis" else (lambda p, d: columns[p * dims + d])
    return F.array(*[F.struct(*[F.col(f"`{at(p, d)}`").cast("double").alias("xyz"[d]) for d in range(dims)]) for p in range(n)])


def to_canonical_axes(points: Column) -> Column:
    """y and z turned round: from image axes to those of the canonical face."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), (-p["y"]).alias("y"), (-p["z"]).alias("z")))


def unit_mesh_to_frame(points: Column, left: Column, top: Column, right: Column, bottom: Column, pad_left: Column, pad_top: Column, scale: Column) -> Column:
    """A mesh in units of its crop in coordinates of the original frame; z stays."""
    move = lambda v, a, b, pad: (v * (b - a) + a - pad) / scale
    return F.transform(points, lambda p: F.struct(move(p["x"], left, right, pad_left).alias("x"), move(p["y"], top, bottom, pad_top).alias("y"), p["z"].alias("z")))


def iris_radii(points: Column) -> Column:
    """struct<left,right>: mean distance of the ring's four points from the iris's centre."""

    def radius(iris: Sequence[int]) -> Column:
        c = _point(points, iris[0])
        far = [F.sqrt(sum((F.pow(_point(points, i)[a] - c[a], F.lit(2)) for a in "yz"), F.pow(_point(points, i)["x"] - c["x"], F.lit(2)))) for i in iris[1:]]
        return sum(far[1:], far[0]) / len(far)

    return F.struct(radius(LEFT_IRIS).alias("left"), radius(RIGHT_IRIS).alias("right"))


def pupil_shift(radii: Column, pitch: Column, yaw: Column) -> Column:
    """struct<x,y,z>: 0.45 of the mean radius along the gaze, without depth."""
    size = 0.45 * (radii["left"] + radii["right"]) / 2
    return F.struct((-size * F.sin(yaw) * F.cos(pitch)).alias("x"), (size * F.sin(pitch)).alias("y"), F.lit(0.0).alias("z"))


def gaze_arrow(points: Column, pitch: Column, yaw: Column, length: float = 0.3) -> Column:
    """struct<origin,direction,length>: from between the eyes' outer corners, a part of the face's height long."""
    a, b = (_point(points, i) for i in OUTER_CORNERS)
    origin = F.struct(*[((a[d] + b[d]) / 2).alias(d) for d in "xyz"])
    way = F.struct((-F.sin(yaw) * F.cos(pitch)).alias("x"), F.sin(pitch).alias("y"), (F.cos(yaw) * F.cos(pitch)).alias("z"))
    ys = F.transform(points, lambda p: p["y"])
    return F.struct(origin.alias("origin"), way.alias("direction"), (length * (F.array_max(ys) - F.array_min(ys))).alias("length"))


def svg_polygon(points: Column, height: Column | int) -> Column:
    """Closed path of array<struct<x,y>>, y from the bottom up."""
    h = height if isinstance(height, Column) else F.lit(height)
    one = lambda p, i: F.concat(F.when(i == 0, "M ").otherwise("L "), p["x"].cast("string"), F.lit(","), (h - p["y"]).cast("string"))
    return F.concat(F.array_join(F.transform(points, one), ""), F.lit(" Z"))


def emotion_label_place(x: Column, y: Column, w: Column, h: Column, height: float, width: float, position: str = "bottom", dx: float = 0.0, dy: float = 0.0) -> Column:
    """struct<x,y,align,valign> of an emotion label beside a box: bottom, top, left or right of it."""
    position = position.lower()
    middle = height - y - h / 2
    places = {
        "bottom": (x + w / 2, height - y - h - height * 0.04 - dy, "left", "bottom"),
        "top": (x + w / 2, height - y + h / 2 + dy - height * 0.04, "left", "bottom"),
        "right": (x + w + width * 0.025 + dx, middle, "left", "middle"),
        "left": (x - w / 2 - dx + width * 0.01, middle, "right", "middle"),
    }
    if position not in places:
        raise ValueError("position is bottom, top, left or right")
    px, py, align, valign = places[position]
    return F.struct(px.alias("x"), py.alias("y"), F.lit(align).alias("align"), F.lit(valign).alias("valign"))
