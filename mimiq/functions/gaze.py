"""Gaze angles and vectors as column expressions.

Two conventions are in use and kept apart: the metric's vector looks along -z,
the geometric estimate along +z.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotations import _let

#: Points of the eye outlines and irises in the 478-point mesh.
LEFT_EYE = (33, 7, 163, 144, 145, 153, 154, 155, 133, 246, 161, 160, 159, 158, 157, 173)
RIGHT_EYE = (263, 249, 390, 373, 374, 380, 381, 382, 362, 466, 388, 387, 386, 385, 384, 398)
LEFT_IRIS = (468, 469, 470, 471, 472)
RIGHT_IRIS = (473, 474, 475, 476, 477)


def gaze_unit_vector(pitch: Column, yaw: Column) -> Column:
    """struct<x,y,z> for angles in radians, forward along -z."""
    return F.struct((-F.cos(pitch) * F.sin(yaw)).alias("x"), (-F.sin(pitch)).alias("y"), (-F.cos(pitch) * F.cos(yaw)).alias("z"))


def angular_error_degrees(pitch_true: Column, yaw_true: Column, pitch: Column, yaw: Column) -> Column:
    """Angle between two gazes, in degrees."""
    a, b = gaze_unit_vector(pitch_true, yaw_true), gaze_unit_vector(pitch, yaw)
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def vector_to_pitch_yaw(x: Column, y: Column, z: Column) -> Column:
    """struct<pitch,yaw> in radians of a vector, forward along +z."""
    return F.struct(F.atan2(y, F.sqrt(x * x + z * z)).alias("pitch"), F.atan2(-x, z).alias("yaw"))


def _mean(points: Column, index: Sequence[int]) -> list[Column]:
    return [sum((F.element_at(points, i + 1)[a] for i in index[1:]), F.element_at(points, index[0] + 1)[a]) / len(index) for a in "xyz"]


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _unit(v: Column) -> Column:
    sized = _let(v, lambda u: F.struct(u.alias("u"), F.greatest(F.sqrt(u["x"] * u["x"] + u["y"] * u["y"] + u["z"] * u["z"]), F.lit(1e-12)).alias("size")))
    return _let(sized, lambda s: _vector(*[s["u"][a] / s["size"] for a in "xyz"]))


def estimate_gaze(points: Column, rotation: Column | None = None, left_eye: Sequence[int] = LEFT_EYE, right_eye: Sequence[int] = RIGHT_EYE) -> Column:
    """struct of pitch and yaw, left, right and combined, from array<struct<x,y,z>> of 478 points.

    The vector from an eye's centre to its iris's; with a head rotation (nine numbers by rows) it is turned
    into the head's frame by the transpose.
    """

    def turned(v: Column) -> Column:
        return _vector(*[sum((F.element_at(rotation, 3 * r + c + 1) * v["xyz"[r]] for r in (1, 2)), F.element_at(rotation, c + 1) * v["x"]) for c in range(3)])

    def eye(outline: Sequence[int], iris: Sequence[int]) -> Column:
        v = _unit(_vector(*[i - e for i, e in zip(_mean(points, iris), _mean(points, outline), strict=True)]))
        return v if rotation is None else _unit(_let(v, turned))

    angles = lambda v: vector_to_pitch_yaw(v["x"], v["y"], v["z"])
    half = lambda e: _unit(_vector(*[(e["l"][a] + e["r"][a]) * 0.5 for a in "xyz"]))
    both = F.struct(eye(left_eye, LEFT_IRIS).alias("l"), eye(right_eye, RIGHT_IRIS).alias("r"))
    return _let(both, lambda e: F.struct(angles(e["l"]).alias("left"), angles(e["r"]).alias("right"), _let(half(e), angles).alias("combined")))


def pupil_offsets(pitch: Column, yaw: Column, scale: float = 15.0) -> Column:
    """struct of both pupils' x and y, scale times the sines; NULL for an angle that is not finite."""
    from ..nulls import is_finite

    return F.when(is_finite(pitch) & is_finite(yaw), F.struct(*[(scale * F.sin(a)).alias(f"{side}_{n}") for side in ("left", "right") for n, a in (("x", yaw), ("y", pitch))]))


def binned_angle(logits: Column, first_deg: float = -180.0, bin_deg: float = 4.0) -> Column:
    """Radians: expected angle under the softmax of logits over bins."""
    top = F.array_max(logits)
    odds = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.transform(odds, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x) / total
    return F.radians(mean * bin_deg + first_deg)
