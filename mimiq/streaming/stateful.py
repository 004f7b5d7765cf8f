"""Streams: smoothed boxes and running identities, and a summary by windows of event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identity import gallery_labels
from ..operators.signal import smooth_boxes


def read_frame_stream(spark, path: str, schema, kind: str = "parquet") -> DataFrame:  # noqa: ANN001
    """Files of frame rows as they come."""
    return spark.readStream.schema(schema).format(kind).load(path)


def smoothed_boxes(frames: DataFrame, alpha: float, stream: str = "input", frame: str = "frame", boxes: Sequence[str] = ("left", "top", "right", "bottom")) -> DataFrame:
    """Boxes smoothed along each recording; the last frame's boxes are the state. Frames come in order."""
    boxes = list(boxes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    columns = frames.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(frame, kind="stable").reset_index(drop=True)
        x, at = rows[boxes].to_numpy(float), rows[frame].to_numpy()
        cuts = [0, *(1 + np.flatnonzero(at[1:] != at[:-1])).tolist(), len(at)]
        for a, e in zip(cuts, cuts[1:], strict=False):
            new, before = next(smooth_boxes([x[a:e]], alpha, before))
            x[a:e] = new
        state.update((pickle.dumps(before),))
        rows[boxes] = x
        yield rows[columns]

    return frames.groupBy(stream).applyInPandasWithState(run, schema, "boxes binary", "append", GroupStateTimeout.NoTimeout)


def running_identities(faces: DataFrame, threshold: float = 0.8, scope: str = "input", vector: str = "v", order: str = "frame") -> DataFrame:
    """Leader clustering along each recording; centroids and counts are the state. Adds Identity."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in faces.schema), "Identity string"])
    columns = [*faces.columns, "Identity"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = pickle.loads(state.get[0]) if state.exists else ([], [])
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)
        x = np.stack([np.asarray(v, float) for v in rows[vector]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        labels = gallery_labels(x, threshold, book)
        state.update((pickle.dumps(book),))
        rows["Identity"] = [f"Person_{k + 1}" if k >= 0 else None for k in labels]
        yield rows[columns]

    return faces.groupBy(scope).applyInPandasWithState(run, schema, "book binary", "append", GroupStateTimeout.NoTimeout)


def windowed_summary(frames: DataFrame, value: str, session: str, ts: str = "ts", length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, least and greatest by session and window of event time; later rows than ``late`` are left out."""
    w: Column = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = frames.withWatermark(ts, late).groupBy(w.alias("w"), session)
    return out.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), session, "n", "mean", "std", "min", "max")


def session_activity(frames: DataFrame, session: str, ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of activity by session, ended by a gap."""
    out = frames.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), session).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), session, "n")
