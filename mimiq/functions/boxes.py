"""Box arithmetic as column expressions. Boxes are structs; names say their form.

xyxy: left, top, right, bottom. xywh: x, y, w, h.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = ("left", "top", "right", "bottom")


def xyxy(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def to_xywh(box: Column) -> Column:
    return F.struct(box["left"].alias("x"), box["top"].alias("y"), (box["right"] - box["left"]).alias("w"), (box["bottom"] - box["top"]).alias("h"))


def iou_xywh(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of (x, y, w, h); 0 where the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / F.when(union > 0, union)).otherwise(0.0)


def intersect(a: Column, b: Column) -> Column:
    return xyxy(F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"]), F.least(a["right"], b["right"]), F.least(a["bottom"], b["bottom"]))


def hull(a: Column, b: Column) -> Column:
    return xyxy(F.least(a["left"], b["left"]), F.least(a["top"], b["top"]), F.greatest(a["right"], b["right"]), F.greatest(a["bottom"], b["bottom"]))


def clip(box: Column, left: float | Column = 0, top: float | Column = 0, right: float | Column | None = None, bottom: float | Column | None = None) -> Column:
    """Within a boundary; left and top of it are at least 0."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    lo = lambda edge, bound: F.greatest(box[edge], F.greatest(as_col(bound), F.lit(0)))
    hi = lambda edge, bound: box[edge] if bound is None else F.least(box[edge], as_col(bound))
    return xyxy(lo("left", left), lo("top", top), hi("right", right), hi("bottom", bottom))


def area(box: Column) -> Column:
    return (box["right"] - box["left"]) * (box["bottom"] - box["top"])


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection by the area of ``a``: not symmetric."""
    both = intersect(a, b)
    inside = F.greatest(both["right"] - both["left"], F.lit(0)) * F.greatest(both["bottom"] - both["top"], F.lit(0))
    return F.when(area(a) != 0, inside / F.when(area(a) != 0, area(a)))


def expand(box: Column, factor: float, symmetric: bool = True) -> Column:
    """Grown around its centre; half sizes are floored. Symmetric: to a square of the longer side."""
    w, h = box["right"] - box["left"], box["bottom"] - box["top"]
    cx, cy = box["left"] + F.floor(w / 2), box["top"] + F.floor(h / 2)
    nw, nh = (F.greatest(w, h) * factor,) * 2 if symmetric else (w * factor, h * factor)
    return xyxy(cx - F.floor(nw / 2), cy - F.floor(nh / 2), cx + F.floor(nw / 2), cy + F.floor(nh / 2))


def to_unit_points(points: Column, box: Column) -> Column:
    """array<struct<x,y>> in units of the box."""
    w, h = box["right"] - box["left"], box["bottom"] - box["top"]
    return F.transform(points, lambda p: F.struct(((p["x"] - box["left"]) / w).alias("x"), ((p["y"] - box["top"]) / h).alias("y")))


def from_unit_points(points: Column, box: Column) -> Column:
    w, h = box["right"] - box["left"], box["bottom"] - box["top"]
    return F.transform(points, lambda p: F.struct((p["x"] * w + box["left"]).alias("x"), (p["y"] * h + box["top"]).alias("y")))


def rescale_terms(height: Column, width: Column, output: int | tuple[int, int], keep_aspect: bool = True) -> Column:
    """struct: new height and width, scale, and padding that centres them; an odd pixel goes to bottom and right."""
    oh, ow = (output, output) if isinstance(output, int) else output
    scale = F.least(F.lit(float(oh)) / height, F.lit(float(ow)) / width) if keep_aspect else F.lit(float(oh)) / height
    nh, nw = F.floor(height * scale), F.floor(width * scale) if keep_aspect else F.lit(ow)
    top, left = F.floor((oh - nh) / 2), F.floor((ow - nw) / 2)
    return F.struct(nh.alias("height"), nw.alias("width"), scale.alias("scale"), left.alias("left"), top.alias("top"), (ow - nw - left).alias("right"), (oh - nh - top).alias("bottom"))


def invert_padding(x: Column, pad: Column, scale: Column) -> Column:
    """A padded and scaled coordinate in the original image."""
    return (x - pad) / scale


def invert_padding_columns(df: DataFrame, xs: Sequence[str], ys: Sequence[str], sizes: Sequence[str], left: str = "pad_left", top: str = "pad_top", scale: str = "scale") -> DataFrame:
    """x and y columns moved and scaled back, widths and heights only scaled."""
    done = {c: (F.col(c) - F.col(left)) / F.col(scale) for c in xs}
    done |= {c: (F.col(c) - F.col(top)) / F.col(scale) for c in ys}
    return df.withColumns(done | {c: F.col(c) / F.col(scale) for c in sizes})


def original_size(height: Column, width: Column, left: Column, right: Column, top: Column, bottom: Column, scale: Column) -> Column:
    return F.struct(((height - top - bottom) / scale).alias("height"), ((width - left - right) / scale).alias("width"))


def decode_box(loc: Sequence[Column], prior: Sequence[Column], variances: tuple[float, float] = (0.1, 0.2)) -> Column:
    """xyxy of offsets on a prior (centre x, centre y, width, height)."""
    cx, cy = (prior[k] + loc[k] * variances[0] * prior[k + 2] for k in (0, 1))
    w, h = (prior[k] * F.exp(loc[k] * variances[1]) for k in (2, 3))
    return xyxy(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def decode_points(loc: Sequence[Column], prior: Sequence[Column], variance: float = 0.1) -> Column:
    """array<struct<x,y>> of offsets dx, dy by point on a prior."""
    return F.array(*[F.struct((prior[0] + loc[k] * variance * prior[2]).alias("x"), (prior[1] + loc[k + 1] * variance * prior[3]).alias("y")) for k in range(0, len(loc), 2)])


def priors(spark: SparkSession, height: int, width: int, steps: Sequence[int] = (8, 16, 32), sizes: Sequence[Sequence[int]] = ((16, 32), (64, 128), (256, 512)), clip_to_unit: bool = False) -> DataFrame:
    """(prior, cx, cy, w, h): anchors of all cells of all levels, in units of the image."""
    out = None
    for level, (step, small) in enumerate(zip(steps, sizes, strict=True)):
        rows, cols = -(-height // step), -(-width // step)
        cell = spark.range(rows * cols).withColumn("size", F.explode(F.array(*map(F.lit, small))))
        i, j = F.floor(F.col("id") / cols), F.col("id") % cols
        order = (F.col("id") * len(small) + F.array_position(F.array(*map(F.lit, small)), F.col("size")) - 1).alias("place")
        values = [(j + 0.5) * step / width, (i + 0.5) * step / height, F.col("size") / width, F.col("size") / height]
        if clip_to_unit:
            values = [F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in values]
        part = cell.select(F.lit(level).alias("level"), order, *[v.alias(n) for v, n in zip(values, ("cx", "cy", "w", "h"), strict=True)])
        out = part if out is None else out.unionByName(part)
    return out


def regress_box(box: Column, offsets: Sequence[Column]) -> Column:
    """Edges moved by offsets times size, of inclusive pixels."""
    w, h = box["right"] - box["left"] + 1, box["bottom"] - box["top"] + 1
    return xyxy(*[box[e] + o * s for e, o, s in zip(EDGES, offsets, (w, h, w, h), strict=True)])


def square(box: Column) -> Column:
    """Of the longer side, around the same centre."""
    w, h = box["right"] - box["left"], box["bottom"] - box["top"]
    side = F.greatest(w, h)
    left, top = box["left"] + w * 0.5 - side * 0.5, box["top"] + h * 0.5 - side * 0.5
    return xyxy(left, top, left + side, top + side)


def clip_pixels(box: Column, width: Column | int, height: Column | int) -> Column:
    """Whole pixels numbered from 1, within the image."""
    cut = lambda e: box[e].cast("int")
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return xyxy(F.greatest(cut("left"), F.lit(1)), F.greatest(cut("top"), F.lit(1)), F.least(cut("right"), as_col(width)), F.least(cut("bottom"), as_col(height)))


def boxes_of_map(scores: DataFrame, scale: float, threshold: float, stride: int = 2, cell: int = 12) -> DataFrame:
    """Boxes of the cells of a score map (image, row, col, score) that reach the threshold."""
    at = lambda c, more: F.floor((stride * F.col(c) + more) / scale).cast("double")
    return scores.filter(F.col("score") >= threshold).select("image", at("col", 1).alias("left"), at("row", 1).alias("top"), at("col", cell).alias("right"), at("row", cell).alias("bottom"), "score")


def crop_to_box(ox: Column, oy: Column, side: Column) -> Column:
    return xyxy(ox, oy, ox + side, oy + side)


def points_to_49(points: Column) -> Column:
    """Of 68 points, without the jaw (0 to 16) and the inner lip's corners (60 and 64)."""
    return F.filter(points, lambda p, i: (i >= 17) & (i != 60) & (i != 64))


def svg_path(points: Column, height: Column | int) -> Column:
    """'M x,y L …' of array<struct<x,y>>, y from the bottom up."""
    as_col = height if isinstance(height, Column) else F.lit(height)
    one = lambda p, i: F.concat(F.when(i == 0, "M ").otherwise("L "), p["x"].cast("string"), F.lit(","), (as_col - p["y"]).cast("string"))
    return F.array_join(F.transform(points, one), " ")


def evidence_to_probability(x: Column) -> Column:
    """Base-10 logistic of evidence scores: 1 / (1 + 10^-x)."""
    return 1 / (1 + F.pow(F.lit(10.0), -x))


def approx_time(frame: Column, fps: float, n_frames: int) -> Column:
    """'MM:SS' of a frame, its end clamped to the last; minutes run on past the hour."""
    seconds = F.least(frame, F.lit(n_frames)) / fps
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))
