"""Signals by session: cleaning, resampling, wavelets.

What is a formula of moments (detrending, standardising) is SQL. Filters run
a session at a time in a kernel; a session is one recording and fits in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from .frame import FrameTable, q
from .grouping import map_groups

MODES = ("complex", "filtered", "phase", "magnitude", "power")


def _positions(table: FrameTable, ignore_sessions: bool) -> tuple[DataFrame, str]:
    """The table with its session as text-free key __s and row number __i."""
    key = table.schema.session if table.schema.session and not ignore_sessions else None
    df = table.df.withColumn("__s", q(key) if key else F.lit(0))
    return df.withColumn("__i", F.row_number().over(table.ordered(ignore_sessions)) - 1), key or ""


def detrend(table: FrameTable, columns: Sequence[str], ignore_sessions: bool = False) -> FrameTable:
    """Less the least-squares line over row number, within sessions."""
    df, _ = _positions(table, ignore_sessions)
    lines = df.groupBy("__s").agg(*[f(c) for i, c in enumerate(columns) for f in (lambda c, i=i: F.regr_slope(q(c), F.col("__i")).alias(f"__k{i}"), lambda c, i=i: F.regr_intercept(q(c), F.col("__i")).alias(f"__m{i}"))])
    joined = df.join(lines.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")))
    done = {c: q(c) - (F.col(f"__k{i}") * F.col("__i") + F.col(f"__m{i}")) for i, c in enumerate(columns)}
    return replace(table, df=joined.withColumns(done).select(*map(q, table.df.columns)))


def standardize(table: FrameTable, columns: Sequence[str], ignore_sessions: bool = False) -> FrameTable:
    """Mean 0 and sample deviation 1 within sessions; a constant becomes 0."""
    key = table.schema.session if table.schema.session and not ignore_sessions else None
    df = table.df.withColumn("__s", q(key) if key else F.lit(0))
    made = [f(q(c)).alias(f"__{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("d", F.stddev_samp))]
    joined = df.join(df.groupBy("__s").agg(*made).withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")))
    done = {c: (q(c) - F.col(f"__m{i}")) / F.when(F.col(f"__d{i}") != 0, F.col(f"__d{i}")).otherwise(1.0) for i, c in enumerate(columns)}
    return replace(table, df=joined.withColumns(done).select(*map(q, table.df.columns)))


def _apply(table: FrameTable, columns: Sequence[str], ignore_sessions: bool, kernel, keep: Sequence[str], out_columns: Sequence[str], kinds: str = "double") -> DataFrame:  # noqa: ANN001
    """Run a kernel over each session's (rows, columns) array in row order."""
    df, _ = _positions(table, ignore_sessions)
    slim = df.select("__s", "__i", *map(q, keep), *[q(c).cast("double").alias(c) for c in columns])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep]
    schema = ", ".join([*fields, *(f"`{c}` {kinds}" for c in out_columns)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i").reset_index(drop=True)
        return kernel(pdf)[[*keep, *out_columns]]

    return slim.groupBy("__s").applyInPandas(run, schema)


def clean(table: FrameTable, columns: Sequence[str] | None = None, *, detrended: bool = True, standardized: bool = True, confounds: Sequence[str] = (), low_pass: float | None = None, high_pass: float | None = None, ensure_finite: bool = False, ignore_sessions: bool = False) -> FrameTable:
    """Detrend, filter, remove confounds, standardise, make finite: in this order, within sessions.

    Without filter and confounds it is all SQL. A NULL is NaN to the kernel and NULL again after.
    """
    columns = list(columns or table.schema.numeric)
    if low_pass is None and high_pass is None and not confounds:
        out = detrend(table, columns, ignore_sessions) if detrended else table
        out = standardize(out, columns, ignore_sessions) if standardized else out
        if ensure_finite:
            out = replace(out, df=out.df.withColumns({c: F.coalesce(F.when(F.abs(q(c)) < float("inf"), q(c)), F.lit(0.0)) for c in columns}))
        return out
    freq = float(table.schema.sampling_freq or 1.0)
    extra = [c for c in confounds if c not in columns]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = filters.clean(pdf[columns].to_numpy(float), detrended=detrended, standardize=standardized, confounds=pdf[list(confounds)].to_numpy(float) if confounds else None, low_pass=low_pass, high_pass=high_pass, ensure_finite=ensure_finite, sampling_freq=freq)
        pdf[columns] = np.where(np.isnan(x), None, x)
        return pdf

    out = _apply(table, [*columns, *extra], ignore_sessions, kernel, table.keys(), columns)
    return replace(table, df=out)


def upsample(table: FrameTable, target: float, target_type: str = "hz", columns: Sequence[str] | None = None, ignore_sessions: bool = False) -> FrameTable:
    """Each session resampled in the Fourier domain to the rows that the target asks for; rows are numbered anew in 'sample'."""
    columns = list(columns or table.schema.numeric)
    freq = table.schema.sampling_freq
    if target_type not in ("hz", "samples", "seconds"):
        raise ValueError("target_type is hz, samples or seconds")
    if target_type != "samples" and not freq:
        raise ValueError("a sampling rate is needed")
    key = [table.schema.session] if table.schema.session and not ignore_sessions else []

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n = {"hz": round(len(pdf) * target / (freq or 1)), "samples": round(target), "seconds": round(target * (freq or 1))}[target_type]
        out = pd.DataFrame(filters.resample(pdf[columns].to_numpy(float), n), columns=columns)
        for k in key:
            out[k] = pdf[k].iloc[0]
        out["sample"] = np.arange(n, dtype=float)
        return out

    df = _apply(table, columns, ignore_sessions, kernel, key, ["sample", *columns])
    new = target if target_type == "hz" else None
    return FrameTable(df.withColumn("sample", F.col("sample").cast("long")), replace(table.schema, sampling_freq=new, order_by=("sample",)))


def wavelets(table: FrameTable, freqs: Sequence[float], num_cyc: float = 3, mode: str = "complex", columns: Sequence[str] | None = None, ignore_sessions: bool = False) -> FrameTable:
    """Convolution with a bank of complex Morlet waves, all in one pass over each session.

    Columns are f{freq}_{mode}_{column}; mode 'complex' gives struct<re,im>.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    columns = list(columns or table.schema.numeric)
    bank = [(f, filters.morlet(f, num_cyc, float(table.schema.sampling_freq or 30.0))) for f in freqs]
    made = [f"f{round(float(f), 2)}_{mode}_{c}" for f, _ in bank for c in columns]
    view = {"filtered": np.real, "phase": np.angle, "magnitude": np.abs, "power": lambda z: np.abs(z) ** 2}

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        new = {}
        names = iter(made)
        for _, wave in bank:
            for c in columns:
                z = filters.convolve_same(pdf[c].to_numpy(float), wave)
                new[next(names)] = [{"re": a.real, "im": a.imag} for a in z] if mode == "complex" else view[mode](z)
        return pd.concat([pdf, pd.DataFrame(new)], axis=1)

    df = _apply(table, columns, ignore_sessions, kernel, table.keys(), made, "struct<re:double,im:double>" if mode == "complex" else "double")
    return FrameTable(df, replace(table.schema, groups={"wavelets": tuple(made)}))


def multi_wavelet(table: FrameTable, min_freq: float = 0.06, max_freq: float = 0.66, bank: int = 8, **how: object) -> FrameTable:
    """Waves evenly spaced in the logarithm of frequency."""
    return wavelets(table, np.geomspace(min_freq, max_freq, bank).tolist(), **how)


def boft(table: FrameTable, min_freq: float = 0.06, max_freq: float = 0.66, bank: int = 8, columns: Sequence[str] | None = None, strict: bool = True, ignore_sessions: bool = False) -> DataFrame:
    """One row per session: for each wave (high to low) and column, twelve counts of areas between zero crossings."""
    columns = list(columns or table.schema.numeric)
    freqs = np.geomspace(min_freq, max_freq, bank)[::-1]
    waves = [np.real(filters.morlet(f, sampling_freq=float(table.schema.sampling_freq or 30.0))) for f in freqs]
    hz = [str(np.round(f, 2)) for f in freqs]
    made = [f"{side}{k}_hz_{h}_{c}" for c in columns for h in hz for side in ("pos", "neg") for k in range(6)]
    key = [table.schema.session] if table.schema.session and not ignore_sessions else []

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf[columns].isna().any().any():
            raise ValueError("signals with missing values cannot be convolved")
        counts = np.concatenate([filters.area_histogram(np.convolve(pdf[c].to_numpy(float), w), strict=strict) for c in columns for w in waves])
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), *counts.astype(float)]], columns=[*key, *made])

    return _apply(table, columns, ignore_sessions, kernel, key, made)


def ease_in_out(spark, start: Sequence[float], end: Sequence[float], n_frames: int, padding: int = 0, reverse: bool = True) -> DataFrame:  # noqa: ANN001
    """(frame, values) from start to end along a cubic, ends held for ``padding`` frames, and back again."""
    t = F.col("k") / max(n_frames - 1, 1)
    ease = F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3)) / 2)
    total = n_frames + 2 * padding
    step = spark.range(total).select("id", F.least(F.greatest(F.col("id") - padding, F.lit(0)), F.lit(n_frames - 1)).alias("k"))
    row = F.array(*[F.lit(float(a)) + F.lit(float(b - a)) * ease for a, b in zip(start, end, strict=True)])
    there = step.select(F.col("id").alias("frame"), row.alias("values"))
    if not reverse:
        return there
    return there.unionByName(there.select((F.lit(2 * total - 1) - F.col("frame")).alias("frame"), "values"))


def matched(gap: np.ndarray) -> np.ndarray:
    """For each row the column it gets, or -1, where every column prefers the earlier row and every row the smaller finite gap.

    Rows without a column propose to the best that has not refused them, all at once; columns keep the earliest.
    """
    left = gap.copy()
    n, m = left.shape
    holder, asked = np.full(m, n), np.full(n, -1)
    seek = np.flatnonzero(np.isfinite(left).any(1))
    while len(seek):
        asked[seek] = left[seek].argmin(1)
        np.minimum.at(holder, asked[seek], seek)
        tried = np.flatnonzero(asked >= 0)
        refused = tried[holder[asked[tried]] != tried]
        left[refused, asked[refused]] = np.inf
        asked[refused] = -1
        seek = refused[np.isfinite(left[refused]).any(1)]
    return asked


def smooth_boxes(frames: Iterator[np.ndarray], alpha: float, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Each frame's boxes (xyxy) moved towards the frame before, with the boxes to carry on.

    Boxes are matched to earlier ones whose centres lie within half their width, the nearest first and earlier rows
    before later ones; others, and rows that are not finite, pass as they are.
    """
    centre = lambda x: x.reshape(-1, 2, 2).mean(1)
    for boxes in frames:
        rows = np.flatnonzero(np.isfinite(boxes).all(1))
        now, out = boxes[rows], boxes.copy()
        if before is not None and len(before) and len(rows):
            gap = np.hypot(*np.moveaxis(centre(now)[:, None] - centre(before)[None], 2, 0))
            reach = np.maximum(now[:, 2] - now[:, 0], 1.0) / 2
            to = matched(np.where(gap < reach[:, None], gap, np.inf))
            hit = to >= 0
            now[hit] = alpha * now[hit] + (1 - alpha) * before[to[hit]]
            out[rows] = now
        before = now if len(rows) else None
        yield out, before


def smooth_box_table(df: DataFrame, alpha: float, stream: str = "input", frame: str = "frame", boxes: Sequence[str] = ("left", "top", "right", "bottom"), tie: Sequence[str] = ()) -> DataFrame:
    """Box columns smoothed along each recording, frame by frame."""
    boxes, columns = list(boxes), df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def kernel(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        x, at = rows[boxes].to_numpy(float), rows[frame].to_numpy()
        for a, e in zip(bounds, bounds[1:], strict=False):
            cuts = [a, *(a + 1 + np.flatnonzero(at[a + 1 : e] != at[a : e - 1])).tolist(), e]
            for f, g, (new, _) in zip(cuts, cuts[1:], smooth_boxes((x[f:g] for f, g in zip(cuts, cuts[1:], strict=False)), alpha), strict=False):
                x[f:g] = new
        rows[boxes] = x
        return rows[columns]

    return map_groups(df, [stream], [frame, *tie], kernel, schema)
