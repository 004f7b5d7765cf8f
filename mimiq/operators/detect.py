"""Detection as a plan: frames in, one row per face out, by a pluggable model.

Weights of the usual networks are not supplied; a model is any object with
``faces(images)``. The stub is deterministic and serves tests. Model calls run in
Arrow batches on executors; what follows (identities, scores) is SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import approx_time
from ..schema import AUS, EMOTIONS, FACEBOX, FrameSchema
from .frame import FrameTable

OUTPUT = ("FaceRectX double, FaceRectY double, FaceRectWidth double, FaceRectHeight double, FaceScore double, " + ", ".join(f"{c} double" for c in (*AUS, *EMOTIONS, "Pitch", "Roll", "Yaw")) + ", embedding array<float>")
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class Model(Protocol):
    """Faces of one image: dicts of the output columns; none if there is no face."""

    def faces(self, content: bytes) -> list[dict]: ...


@dataclass(frozen=True)
class StubModel:
    """Faces made from a digest of the image's bytes: same bytes, same faces. It finds nothing in empty content."""

    dimensions: int = 16

    def faces(self, content: bytes) -> list[dict]:
        if not content:
            return []
        seed = int.from_bytes(hashlib.sha256(content).digest()[:8], "big")
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(1 + seed % 2):
            row = dict(zip(FACEBOX, [*rng.uniform(0, 100, 2), *rng.uniform(20, 80, 2), rng.uniform(0.5, 1)], strict=True))
            row |= {a: float(v) for a, v in zip(AUS, rng.uniform(0, 1, len(AUS)), strict=True)}
            mood = rng.exponential(size=len(EMOTIONS))
            row |= {e: float(v) for e, v in zip(EMOTIONS, mood / mood.sum(), strict=True)}
            row |= {p: float(v) for p, v in zip(("Pitch", "Roll", "Yaw"), rng.normal(0, 15, 3), strict=True)}
            v = rng.normal(size=self.dimensions)
            out.append(row | {"embedding": (v / np.linalg.norm(v)).astype(np.float32).tolist()})
        return out


#: Models by name and kind, for detectors built by name.
REGISTRY: dict[str, dict[str, Callable[[], Model]]] = {"face": {"stub": StubModel}}


def register(kind: str, name: str, make: Callable[[], Model]) -> None:
    REGISTRY.setdefault(kind, {})[name] = make


def fetch(kind: str, name: str) -> Model:
    try:
        return REGISTRY[kind][name]()
    except KeyError:
        raise ValueError(f"no {kind} model is registered as {name}; there are {sorted(REGISTRY.get(kind, {}))}") from None


def capabilities() -> dict[str, list[str]]:
    return {k: sorted(v) for k, v in REGISTRY.items()}


def images(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """(input, frame, content) of image files."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths if isinstance(paths, str) else list(paths)).select(F.col("path").alias("input"), F.lit(0).cast("long").alias("frame"), "content")


def frame_range(spark: SparkSession, video: str, n_frames: int, skip_frames: int | None = None) -> DataFrame:
    """(input, frame) of a video's frames, every skip-th; a decoder fills in content."""
    return spark.range(0, n_frames, skip_frames or 1).select(F.lit(video).alias("input"), F.col("id").alias("frame"))


def detect(frames: DataFrame, model: Model | str = "stub", threshold: float = 0.5, identities: str | None = "gallery", identity_threshold: float = 0.8, fps: float | None = None, n_frames: int | None = None, kind: str = "image") -> FrameTable:
    """One row per face of each frame (input, frame, content), and one for a frame without.

    A frame without a face has score 0, detected false, and NULL elsewhere. ``identities`` names a
    clustering over all rows of the call; frames are ordered by input and number.
    """
    if kind not in ("image", "tensor", "video"):
        raise ValueError("kind is image, tensor or video")
    shipped = fetch("face", model) if isinstance(model, str) else model
    types = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for who, frame, content in zip(b["input"], b["frame"], b["content"], strict=True):
                found = [f for f in shipped.faces(content or b"") if f["FaceScore"] >= threshold]
                for face, f in enumerate(found or [{"FaceScore": 0.0}]):
                    rows.append({"input": who, "frame": frame, "face": face, "detected": bool(found), **{c: f.get(c) for c in COLUMNS}})
            yield pd.DataFrame(rows, columns=["input", "frame", "face", "detected", *COLUMNS])

    df = frames.select("input", "frame", "content").mapInPandas(run, f"input {types['input']}, frame {types['frame']}, face int, detected boolean, {OUTPUT}")
    if fps is not None:
        df = df.withColumn("approx_time", approx_time(F.col("frame"), fps, n_frames or 2**31 - 1))
    groups = {"facebox": FACEBOX, "aus": AUS, "emotions": EMOTIONS, "poses": ("Pitch", "Roll", "Yaw")}
    table = FrameTable(df, FrameSchema(groups=groups, order_by=("input", "frame", "face")))
    if not identities:
        return table
    keys = ["input", "frame", "face"]
    named = FrameTable(df.filter("detected").select(*keys, "embedding"), table.schema).compute_identities(identity_threshold, identities)
    return FrameTable(df.join(named.df.select(*keys, "Identity"), keys, "left"), FrameSchema(groups=groups | {"identity": ("Identity",)}, order_by=table.schema.order_by))


def embed_paths(pairs: DataFrame, model: Model | str = "stub") -> DataFrame:
    """Verification pairs with both embeddings: each different path is embedded once."""
    spark = pairs.sparkSession
    shipped = fetch("face", model) if isinstance(model, str) else model
    paths = pairs.select(F.col("path_a").alias("path")).unionByName(pairs.select(F.col("path_b").alias("path"))).distinct()
    files = [r["path"] for r in paths.limit(1).collect()]
    if not files:
        return pairs.withColumns({"v_a": F.lit(None).cast("array<float>"), "v_b": F.lit(None).cast("array<float>")})
    folder = files[0].rpartition("/")[0]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            faces = [shipped.faces(c or b"") for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "v": [f[0]["embedding"] if f else None for f in faces]})

    v = content.join(paths, "path", "left_semi").mapInPandas(run, "path string, v array<float>")
    side = lambda k: v.select(F.col("path").alias(f"path_{k}"), F.col("v").alias(f"v_{k}"))
    return pairs.join(side("a"), "path_a", "left").join(side("b"), "path_b", "left")
