"""Fits and searches on points and boxes that need a kernel: similarity fits, registration, non-maximum suppression, linear face models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .frame import q
from .grouping import map_groups

#: Points of the 68 that the 'inner' registration uses.
INNER_FACE = tuple(range(17, 68))


def similarity_fit(source: np.ndarray, target: np.ndarray, with_scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, translation, scale) of batches (n, points, dims), so that target ≈ scale · R · source + t.

    The reflection is put right in the direction of least variance.
    """
    ms, mt = source.mean(1, keepdims=True), target.mean(1, keepdims=True)
    a, b = source - ms, target - mt
    u, s, vt = np.linalg.svd(np.swapaxes(b, 1, 2) @ a / source.shape[1])
    sign = np.ones_like(s)
    sign[:, -1] = np.sign(np.linalg.det(u @ vt))
    rotation = (u * sign[:, None, :]) @ vt
    spread = (a**2).sum((1, 2)) / source.shape[1]
    scale = np.where(spread > 1e-12, (s * sign).sum(1) / np.maximum(spread, 1e-12), 1.0) if with_scale else np.ones(len(source))
    shift = mt[:, 0] - scale[:, None] * np.einsum("nij,nj->ni", rotation, ms[:, 0])
    return rotation, shift, scale


def _points(series: pd.Series, dims: int) -> np.ndarray:
    return np.stack([np.asarray(v, float).reshape(-1, dims) for v in series])


def pose_from_mesh(points: Column, canonical: np.ndarray) -> Column:
    """array<double> of nine: rotation (by rows) that turns the canonical mesh into the observed one.

    ``points`` is array<double>, x, y, z of each point; more points than the
    canonical mesh has (iris) are left out. NULL gives NULL.
    """
    n = len(canonical)

    @pandas_udf("array<double>")
    def fit(series: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(series), dtype=object)
        good = series.notna()
        if good.any():
            seen = _points(series[good], 3)[:, :n]
            rotation, _, _ = similarity_fit(np.broadcast_to(canonical, seen.shape), seen)
            out[good] = [r.ravel() for r in rotation]
        return out

    return fit(points)


def align_2d(points: Column, anchors: Sequence[int], reference: np.ndarray) -> Column:
    """array<double>, x, y of each point: all points moved by the similarity that fits the anchors to the reference."""
    index = list(anchors)

    @pandas_udf("array<double>")
    def fit(series: pd.Series) -> pd.Series:
        p = _points(series, 2)
        rotation, shift, scale = similarity_fit(p[:, index], np.broadcast_to(reference, (len(p), *reference.shape)))
        moved = scale[:, None, None] * np.einsum("nij,npj->npi", rotation, p) + shift[:, None]
        return pd.Series([m.ravel() for m in moved])

    return fit(points)


def similarity_matrix_2d(points: Column, reference: np.ndarray) -> Column:
    """array<double> of six: the 2 x 3 matrix (by rows) that takes the points to the reference."""

    @pandas_udf("array<double>")
    def fit(series: pd.Series) -> pd.Series:
        p = _points(series, 2)
        rotation, shift, scale = similarity_fit(p, np.broadcast_to(reference, p.shape))
        return pd.Series([np.column_stack([s * r, t]).ravel() for r, t, s in zip(rotation, shift, scale, strict=True)])

    return fit(points)


def registration(points: Column, neutral: np.ndarray, method: str | Sequence[int] = "fullface") -> Column:
    """array<double>, x, y of each of 68 points: the affine least-squares fit to the neutral face, applied to all.

    method: 'fullface', 'inner', or the points to fit.
    """
    if isinstance(method, str):
        if method not in ("fullface", "inner"):
            raise ValueError("method is fullface, inner or points")
        index = list(range(68)) if method == "fullface" else list(INNER_FACE)
    else:
        index = list(method)

    @pandas_udf("array<double>")
    def fit(series: pd.Series) -> pd.Series:
        out = []
        for v in series:
            p = np.asarray(v, float).reshape(-1, 2)
            design = np.column_stack([p, np.ones(len(p))])
            out.append((design @ np.linalg.lstsq(design[index], neutral[index], rcond=None)[0]).ravel())
        return pd.Series(out)

    return fit(points)


def greedy_nms(boxes: np.ndarray, scores: np.ndarray, threshold: float, method: str = "union", pixel: float = 1.0, bounds: np.ndarray | None = None) -> np.ndarray:
    """Indices kept, best first: a box goes if a better kept one overlaps it by more than the threshold.

    Areas count ``pixel`` more on each side. method 'min' divides by the smaller
    area instead of the union. Of equal scores the later row is better. With ``bounds`` (first rows
    of groups, and the end), groups are apart, and all move on together: each round keeps every group's best.
    """
    n = len(scores)
    bounds = np.array([0, n]) if bounds is None else bounds
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((-np.arange(n), -scores, group))
    b, g = boxes[order], group[order]
    area = (b[:, 2] - b[:, 0] + pixel) * (b[:, 3] - b[:, 1] + pixel)
    left, kept = np.arange(n), []
    while len(left):
        first = np.append(True, g[left[1:]] != g[left[:-1]])
        heads = left[first]
        kept.append(heads)
        best = heads[np.cumsum(first) - 1]
        w = np.maximum(0, np.minimum(b[best, 2], b[left, 2]) - np.maximum(b[best, 0], b[left, 0]) + pixel)
        h = np.maximum(0, np.minimum(b[best, 3], b[left, 3]) - np.maximum(b[best, 1], b[left, 1]) + pixel)
        base = np.minimum(area[best], area[left]) if method == "min" else area[best] + area[left] - w * h
        left = left[(w * h <= threshold * base) & ~first]
    return order[np.sort(np.concatenate(kept))] if kept else np.zeros(0, int)


def nms(df: DataFrame, threshold: float, by: Sequence[str] = ("frame",), order_by: Sequence[str] = (), method: str = "union", pixel: float = 1.0, boxes: Sequence[str] = ("left", "top", "right", "bottom"), score: str = "score") -> DataFrame:
    """The rows kept within each group (a frame, or a frame and class), by score. ``order_by`` settles ties: of equal scores the last is first."""
    boxes, by, columns = list(boxes), list(by), df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def kernel(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        b, s = rows[boxes].to_numpy(float), rows[score].to_numpy(float)
        return rows.iloc[greedy_nms(b, s, threshold, method, pixel, bounds)][columns]

    return map_groups(df, by, order_by, kernel, schema)


def detections(df: DataFrame, image: str = "image", first_score: float = 0.02, top_k: int = 5000, threshold: float = 0.4, final_score: float = 0.5, keep: int = 750, order_by: Sequence[str] = ("prior",)) -> DataFrame:
    """Decoded boxes to detections: score filter, best top_k, suppression, score filter, best ``keep`` of each image."""
    best = lambda d, n: d.withColumn("__r", F.row_number().over(Window.partitionBy(q(image)).orderBy(F.desc("score"), *map(q, order_by)))).filter(F.col("__r") <= n).drop("__r")
    few = best(df.filter(F.col("score") > first_score), top_k)
    return best(nms(few, threshold, [image], order_by, pixel=0.0).filter(F.col("score") >= final_score), keep)


def linear_model(inputs: Column, weights: np.ndarray, bias: np.ndarray, clip: tuple[float, float] | None = None) -> Column:
    """array<double>: inputs · weights + bias, as for blendshapes to action units or action units to points."""

    @pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in series]) @ weights + bias
        return pd.Series(list(np.clip(x, *clip) if clip else x))

    return run(inputs)


def normalize_for_pose(points: Column, left_eye: Sequence[int], right_eye: Sequence[int]) -> Column:
    """array<struct<x,y>>: centred, and divided by the distance between the eyes' centres."""
    n = F.size(points)
    mean = {a: F.aggregate(points, F.lit(0.0), lambda s, p, a=a: s + p[a]) / n for a in "xy"}
    eye = lambda index, a: sum((F.element_at(points, i + 1)[a] for i in index[1:]), F.element_at(points, index[0] + 1)[a]) / len(index)
    gap = F.greatest(F.hypot(eye(left_eye, "x") - eye(right_eye, "x"), eye(left_eye, "y") - eye(right_eye, "y")), F.lit(1e-6))
    return F.transform(points, lambda p: F.struct(((p["x"] - mean["x"]) / gap).alias("x"), ((p["y"] - mean["y"]) / gap).alias("y")))


def symmetrize(points: Column, midline: Sequence[int], pairs: Sequence[tuple[int, int]]) -> Column:
    """array<struct<x,y>>: midline points moved onto their mean x, pairs averaged with each other's mirror image about it."""
    at = lambda i: F.element_at(points, i + 1)
    axis = sum((at(i)["x"] for i in midline[1:]), at(midline[0])["x"]) / len(midline)
    partner = dict(pairs) | {b: a for a, b in pairs}
    on = set(midline)

    def move(p: Column, i: Column) -> Column:
        other = F.element_at(points, F.element_at(F.array(*[F.lit(partner.get(k, k) + 1) for k in range(1 + max([*partner, *on]))]), i + 1))
        x = F.when(F.array_contains(F.array(*map(F.lit, sorted(on))), i), axis).otherwise((p["x"] + 2 * axis - other["x"]) / 2)
        return F.struct(x.alias("x"), ((p["y"] + other["y"]) / 2).alias("y"))

    return F.transform(points, move)


def mesh_of_68(points: Column, anchors: Sequence[int], reference: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Column:
    """array<double>, all x, then y, then z of the mesh: 68 points aligned by their anchors, then a linear model.

    The model takes all x, then all y.
    """

    @pandas_udf("array<double>")
    def swap(series: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v).reshape(-1, 2).T.ravel() for v in series])

    return linear_model(swap(align_2d(points, anchors, reference)), weights, bias)
