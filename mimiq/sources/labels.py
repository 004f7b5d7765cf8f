"""Loaders of labelled splits."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import paths_of

#: Action units of the intensity labels, and class names by number.
DISFA_AUS = ("AU01", "AU02", "AU04", "AU05", "AU06", "AU09", "AU12", "AU15", "AU17", "AU20", "AU25", "AU26")
EXPRESSIONS = ("neutral", "happiness", "sadness", "surprise", "fear", "disgust", "anger")


@dataclass(frozen=True)
class Split:
    """A labelled table: what kind of metric scores it, and tables beside it."""

    name: str
    labels: DataFrame
    kind: str
    notes: str = ""
    extras: dict[str, DataFrame] = field(default_factory=dict)


def sample_by(df: DataFrame, k: int, by: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``k`` rows of each group, chosen by a seeded hash of the key: the same at every run."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


def au_files(spark: SparkSession, pattern: str, regex: str = r"([^/]+)/([^/]+)/(?:AU_?)?(\d+)[^/]*\.txt$") -> DataFrame:
    """(subject, trial, frame, au, intensity) of one text file per subject, trial and action unit; lines of comment are skipped."""
    text = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"))
    part = lambda k: F.regexp_extract("path", regex, k)
    number = F.regexp_extract("value", r"^\s*\D*?0*(\d+)\D*?[\s,]+(\d+(?:\.\d+)?)\s*$", 1)
    value = F.regexp_extract("value", r"^\s*\D*?0*(\d+)\D*?[\s,]+(\d+(?:\.\d+)?)\s*$", 2)
    rows = text.filter(~F.trim("value").startswith("#") & (F.length(F.trim("value")) > 0) & (F.length(number) > 0))
    return rows.select(part(1).alias("subject"), part(2).alias("trial"), number.cast("long").alias("frame"), F.concat(F.lit("AU"), F.lpad(part(3), 2, "0")).alias("au"), value.cast("double").alias("intensity"))


def au_table(long: DataFrame, aus: Sequence[str] = DISFA_AUS, complete: bool = True) -> DataFrame:
    """A row per frame and a column per action unit: frames that all files have ('complete'), or that any has."""
    wide = long.groupBy("subject", "trial", "frame").pivot("au", list(aus)).agg(F.first("intensity", ignorenulls=True))
    return wide.dropna(subset=list(aus)) if complete else wide


def load_disfaplus(spark: SparkSession, root: str, subset_size: int | None = None, seed: int = 42) -> Split:
    table = au_table(au_files(spark, f"{root}/*/*/*.txt"))
    if subset_size is not None:
        table = sample_by(table, subset_size, [], ["subject", "trial", "frame"], seed)
    return Split("disfaplus", table, "au")


def load_disfa(spark: SparkSession, csv: str, fold: str, fold_col: str = "split", frozen: DataFrame | None = None, per_subject: int | None = None, renames: dict[str, str] | None = None, seed: int = 42) -> Split:
    """A fold of a label table: frozen ids by semi-join, or a seeded sample of each subject."""
    df = spark.read.csv(csv, header=True, inferSchema=True)
    df = df.filter(F.col(fold_col) == fold).withColumnsRenamed(renames or {})
    if frozen is not None:
        df = df.join(frozen, [c for c in frozen.columns if c in df.columns], "left_semi")
    elif per_subject is not None:
        df = sample_by(df, per_subject, ["subject"], ["subject", "frame"], seed)
    return Split("disfa", df, "au")


def load_affectnet_val(spark: SparkSession, csv: str, subset_size: int | None = 1000, seed: int = 42) -> Split:
    """Seven classes, evenly sampled, with class names and face boxes."""
    df = spark.read.csv(csv, header=True, inferSchema=True).filter(F.col("expression_int").isin(*range(7)))
    if subset_size is not None:
        df = sample_by(df, max(1, subset_size // 7), ["expression_int"], ["subDirectory_filePath"], seed)
    names = F.create_map(*[F.lit(x) for k, n in enumerate(EXPRESSIONS) for x in (k, n)])
    box = {"FaceRectX": "face_x", "FaceRectY": "face_y", "FaceRectWidth": "face_width", "FaceRectHeight": "face_height"}
    return Split("affectnet_val", df.withColumns({"expression": F.element_at(names, F.col("expression_int")), **{k: F.col(v) for k, v in box.items() if v in df.columns}}), "emotion")


def read_pairs(spark: SparkSession, pairs_txt: str, image_dir: str, landmark_dir: str | None = None, landmark_suffix: str = "_5loc_attri.txt", fold_pairs: int = 300) -> DataFrame:
    """(pair, path_a, path_b, same_id, fold): lines 'name tag' two by two; a pair whose tags differ raises when read."""
    whole = spark.read.text(pairs_txt, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    rows = whole.select(F.floor(F.col("i") / 2).alias("pair"), (F.col("i") % 2).alias("side"), F.split(F.trim("line"), r"\s+").alias("v"))
    side = lambda k, j: F.max(F.when(F.col("side") == k, F.col("v")[j]))
    both = rows.groupBy("pair").agg(side(0, 0).alias("a"), side(1, 0).alias("b"), side(0, 1).alias("ta"), side(1, 1).alias("tb"))
    same = F.when(F.col("ta") == F.col("tb"), (F.col("ta").cast("int") > 0).cast("int")).otherwise(F.raise_error(F.lit("the tags of a pair differ")).cast("int"))
    out = both.select("pair", F.concat(F.lit(f"{image_dir}/"), "a").alias("path_a"), F.concat(F.lit(f"{image_dir}/"), "b").alias("path_b"), same.alias("same_id"), (F.floor(F.col("pair") / fold_pairs) % 10).alias("fold"))
    if landmark_dir:
        mark = lambda c: F.concat(F.lit(f"{landmark_dir}/"), F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", ""), F.lit(landmark_suffix))
        out = out.withColumns({"landmark_a": mark("path_a"), "landmark_b": mark("path_b")})
    return out


def load_pairs(spark: SparkSession, name: str, root: str, pairs: str = "pairs.txt") -> Split:
    """Verification pairs, such as the cross-age and cross-pose sets."""
    return Split(name, read_pairs(spark, f"{root}/{pairs}", f"{root}/aligned_images", f"{root}/landmarks"), "verification")


def load_identification(spark: SparkSession, root: str, use_distractors: bool = True) -> Split:
    """Probe, gallery and distractor tables (id, path); distractors have id -1."""
    read = lambda n: spark.read.csv(f"{root}/{n}.csv", header=True, inferSchema=True)
    gallery = read("gallery")
    if use_distractors:
        gallery = gallery.unionByName(read("distractors").withColumn("id", F.lit(-1).cast(gallery.schema["id"].dataType)), allowMissingColumns=True)
    return Split("identification", read("probe"), "identification", extras={"gallery": gallery})


def load_columbia_gaze(spark: SparkSession, root: str, head_pose: str | None = "0P", subset_size: int | None = None, seed: int = 42) -> Split:
    """Labels from file names subject_distance_poseP_pitchV_yawH; angles in radians. Only names are read."""
    pattern = r"(\d+)_\d+m_(-?\d+)P_(-?\d+)V_(-?\d+)H\.(?:jpg|jpeg|png)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").filter(F.col("path").rlike("(?i)" + pattern))
    part = lambda k: F.regexp_extract("path", "(?i)" + pattern, k)
    df = files.select("path", part(1).alias("subject"), part(2).cast("int").alias("head_pose_deg"), F.radians(part(3).cast("double")).alias("gaze_pitch_rad"), F.radians(part(4).cast("double")).alias("gaze_yaw_rad"))
    if head_pose is not None:
        df = df.filter(F.col("head_pose_deg") == int(head_pose.rstrip("P")))
    if subset_size is not None:
        df = sample_by(df, subset_size, [], ["path"], seed)
    return Split("columbia_gaze", df, "gaze")


LOADERS: dict[str, Callable[..., Split]] = {"disfaplus": load_disfaplus, "disfa": load_disfa, "affectnet_val": load_affectnet_val, "calfw": lambda s, root, **k: load_pairs(s, "calfw", root, **k), "cplfw": lambda s, root, **k: load_pairs(s, "cplfw", root, **k), "tinyface": load_identification, "columbia_gaze": load_columbia_gaze}


def load(name: str, spark: SparkSession, *args: object, **kwargs: object) -> Split:
    if name not in LOADERS:
        raise KeyError(f"{name} is none of {', '.join(LOADERS)}")
    return LOADERS[name](spark, *args, **kwargs)


def available(roots: dict[str, str]) -> list[str]:
    """Names of registered splits whose folder is there."""
    return [n for n, p in roots.items() if n in LOADERS and os.path.exists(paths_of(p)[0])]


def freeze(split: Split, path: str, ids: Sequence[str]) -> None:
    """Write the ids of a split, to be read as ``frozen`` again."""
    split.labels.select(*ids).write.json(path)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
