"""Rotations as column expressions. A matrix is an array of nine numbers by rows.

Values that a formula uses often are bound once (``_let``): Spark would write
them out at each place, and formulas in formulas would grow without end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(matrix: Column, r: int, c: int) -> Column:
    return F.element_at(matrix, 3 * r + c + 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _cap(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _matrix_of_rotvec(v: Column) -> Column:
    """Rotation by the length of the vector about its direction; a zero vector is the identity."""
    u, c, s = [v["x"], v["y"], v["z"]], v["c"], v["s"]
    cross = [[None, -u[2], u[1]], [u[2], None, -u[0]], [-u[1], u[0], None]]
    return F.array(*[c + (1 - c) * u[i] * u[i] if i == j else (1 - c) * u[i] * u[j] + s * cross[i][j] for i in range(3) for j in range(3)])


def _rotvec_of_matrix(m: Column) -> Column:
    """struct<x,y,z>: near no turn half the skew part, near a half turn from the matrix's symmetric part, else by the sine."""
    angle = F.acos(_cap((_at(m, 0, 0) + _at(m, 1, 1) + _at(m, 2, 2) - 1) / 2))
    skew = [_at(m, 2, 1) - _at(m, 1, 2), _at(m, 0, 2) - _at(m, 2, 0), _at(m, 1, 0) - _at(m, 0, 1)]
    sine = F.sin(angle)
    safe = F.when(F.abs(sine) > 1e-8, sine).otherwise(1.0)
    half = [[(_at(m, i, j) + (1 if i == j else 0)) / 2 for i in range(3)] for j in range(3)]  # columns of (R + I) / 2
    big = F.greatest(half[0][0], half[1][1], half[2][2])
    pick = [F.when(half[0][0] >= big, half[0][k]).when(half[1][1] >= big, half[1][k]).otherwise(half[2][k]) for k in range(3)]
    size = F.greatest(F.sqrt(sum((p * p for p in pick[1:]), pick[0] * pick[0])), F.lit(1e-12))
    way = F.when(pick[0] * skew[0] + pick[1] * skew[1] + pick[2] * skew[2] < 0, -1.0).otherwise(1.0)
    out = []
    for k, n in enumerate("xyz"):
        out.append(F.when(angle < 1e-6, skew[k] * 0.5).when(angle > 3.141592653589793 - 0.05, way * pick[k] / size * angle).otherwise(skew[k] / (2 * safe) * angle).alias(n))
    return F.struct(*out)


def _quaternion_of_matrix(m: Column) -> Column:
    """struct<w,x,y,z> of length one, from the largest of four candidates."""
    d = [_at(m, k, k) for k in range(3)]
    trace = d[0] + d[1] + d[2]

    def of(square: Column, parts: Sequence[Column | None]) -> Column:
        """parts: numerators over 4 times the main component, None for that itself."""
        main = F.sqrt(F.greatest(square, F.lit(1e-12))) / 2
        return F.array(*[main if p is None else p / (4 * main) for p in parts])

    a, b, c = _at(m, 2, 1) - _at(m, 1, 2), _at(m, 0, 2) - _at(m, 2, 0), _at(m, 1, 0) - _at(m, 0, 1)
    e, f, g = _at(m, 0, 1) + _at(m, 1, 0), _at(m, 0, 2) + _at(m, 2, 0), _at(m, 1, 2) + _at(m, 2, 1)
    found = (
        F.when(trace > 0, of(1 + trace, (None, a, b, c)))
        .when((d[0] > d[1]) & (d[0] > d[2]), of(1 + d[0] - d[1] - d[2], (a, None, e, f)))
        .when(d[1] > d[2], of(1 + d[1] - d[0] - d[2], (b, e, None, g)))
        .otherwise(of(1 + d[2] - d[0] - d[1], (c, f, g, None)))
    )

    def unit(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.struct(*[(F.element_at(v, k + 1) / size).alias(n) for k, n in enumerate("wxyz")])

    return _let(found, unit)


def _euler_of_quaternion(q: Column) -> Column:
    """struct<roll,pitch,yaw> of xyz angles; the sine is clamped."""
    w, x, y, z = (q[n] for n in "wxyz")
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(_cap(2 * (w * y - z * x)))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return F.struct(roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"))


def euler_of_rotvec(x: Column, y: Column, z: Column) -> Column:
    return euler_of_quaternion(quaternion_of_matrix(matrix_of_rotvec(x, y, z)))


def _head_angles_of_matrix(m: Column) -> Column:
    """struct<pitch,roll,yaw> in radians: about x, about y (named roll) and about z (named yaw), with the locked case apart."""
    sy = F.sqrt(_at(m, 0, 0) * _at(m, 0, 0) + _at(m, 1, 0) * _at(m, 1, 0))
    locked = sy < 1e-6
    pitch = F.when(locked, F.atan2(-_at(m, 2, 1), _at(m, 1, 1))).otherwise(F.atan2(_at(m, 2, 1), _at(m, 2, 2)))
    yaw = F.when(locked, F.lit(0.0)).otherwise(F.atan2(_at(m, 1, 0), _at(m, 0, 0)))
    return F.struct(pitch.alias("pitch"), F.atan2(-_at(m, 2, 0), sy).alias("roll"), yaw.alias("yaw"))


def _pose_degrees_of_matrix(m: Column) -> Column:
    """struct<pitch,roll,yaw> in degrees: extrinsic xyz angles a of the transpose, as a0, -a2, -a1."""
    t = F.array(*[_at(m, c, r) for r in range(3) for c in range(3)])
    return _let(head_angles_of_matrix(t), lambda a: F.struct(F.degrees(a["pitch"]).alias("pitch"), (-F.degrees(a["yaw"])).alias("roll"), (-F.degrees(a["roll"])).alias("yaw")))


def pose_degrees_of_rotvec(x: Column, y: Column, z: Column) -> Column:
    return pose_degrees_of_matrix(matrix_of_rotvec(x, y, z))


def matrix_of_rotvec(x: Column, y: Column, z: Column) -> Column:
    """array<double> of nine; a zero vector gives the identity."""
    angle = F.sqrt(x * x + y * y + z * z)
    safe = F.when(angle > 0, angle).otherwise(1.0)
    parts = F.struct((x / safe).alias("x"), (y / safe).alias("y"), (z / safe).alias("z"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    return _let(parts, _matrix_of_rotvec)


def rotvec_of_matrix(m: Column) -> Column:
    """struct<x,y,z> of a rotation matrix."""
    return _let(m, _rotvec_of_matrix)


def quaternion_of_matrix(m: Column) -> Column:
    """struct<w,x,y,z> of a rotation matrix."""
    return _let(m, _quaternion_of_matrix)


def euler_of_quaternion(q: Column) -> Column:
    """struct<roll,pitch,yaw> of a quaternion."""
    return _let(q, _euler_of_quaternion)


def head_angles_of_matrix(m: Column) -> Column:
    """struct<pitch,roll,yaw> in radians of a rotation matrix."""
    return _let(m, _head_angles_of_matrix)


def pose_degrees_of_matrix(m: Column) -> Column:
    """struct<pitch,roll,yaw> in degrees of a rotation matrix."""
    return _let(m, _pose_degrees_of_matrix)
