"""Readers of frame tables, and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import FrameTable
from ..schema import OPENFACE_INTENSITY, OPENFACE_PRESENCE, FrameSchema, detect_dialect, infer_schema


def paths_of(paths: str | Sequence[str]) -> list[str]:
    """A path or several, as a list; TypeError for anything else."""
    if isinstance(paths, str):
        return [paths]
    if isinstance(paths, Sequence) and all(isinstance(p, str) for p in paths):
        return list(paths)
    raise TypeError("a path or a list of paths is needed")


def check_exists(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The paths; FileNotFoundError for one that the session's file systems do not have."""
    out = paths_of(paths)
    for p in out:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            raise FileNotFoundError(p)
    return out


def read_frames(spark: SparkSession, paths: str | Sequence[str], sampling_freq: float | None = None, schema: FrameSchema | None = None) -> FrameTable:
    """CSV written by a detector. Groups go by column name; 'input' is the file's name if the file lacks it."""
    df = spark.read.csv(check_exists(spark, paths), header=True, inferSchema=True, nanValue="nan")
    df = df.toDF(*[c.strip() for c in df.columns])
    if "input" not in df.columns:
        df = df.withColumn("input", F.col("_metadata.file_path"))
    empty = [c for c, t in df.dtypes if t == "void" or t == "string" and _looks_numeric(c)]
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in empty})
    return FrameTable.of(df, schema, sampling_freq=sampling_freq, dialect=detect_dialect(df.columns)) if schema is None else FrameTable.of(df, schema)


def _looks_numeric(name: str) -> bool:
    return bool(re.match(r"AU\d|(mesh_)?[xyz]_\d|FaceRect|FaceScore|Pitch$|Roll$|Yaw$|gaze_", name))


def read_openface(spark: SparkSession, paths: str | Sequence[str], features: Sequence[str] | None = None) -> FrameTable:
    """OpenFace CSV: blanks around header names go; ``features`` projects columns, KeyError for one that is absent."""
    names = check_exists(spark, paths)
    raw = spark.read.csv(names, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = raw.toDF(*[c.strip() for c in raw.columns]).withColumn("input", F.col("_metadata.file_path") if len(names) > 1 else F.lit(names[0]))
    if features is not None:
        absent = [c for c in features if c not in df.columns]
        if absent:
            raise KeyError(f"absent columns: {', '.join(absent)}")
        df = df.select(*[F.col(f"`{c}`") for c in features], "input")
    schema = infer_schema(df.columns)
    groups = schema.groups | {"aus": tuple(c for c in (*OPENFACE_INTENSITY, *OPENFACE_PRESENCE) if c in df.columns)}
    return FrameTable.of(df, FrameSchema(groups={g: c for g, c in groups.items() if c}, order_by=tuple(c for c in ("input", "frame") if c in df.columns)))


def read_imotions(spark: SparkSession, path: str, preamble: int = 5) -> FrameTable:
    """iMotions TSV: lines before the header skipped, ' Evidence', ' Degrees' and blanks dropped from names, Intensity columns left out."""
    check_exists(spark, path)
    lines = spark.read.text(path).withColumn("k", F.monotonically_increasing_id())
    head = lines.orderBy("k").limit(preamble + 1).collect()
    top = head[preamble]
    rows = lines.filter((F.col("k") > top["k"]) & (F.length("value") > 0)).select(F.split("value", "\t").alias("v"))
    picked = []
    for i, raw in enumerate(top["value"].split("\t")):
        name = raw.replace(" Evidence", "").replace(" Degrees", "").replace(" ", "")
        if "Intensity" in name or not name:
            continue
        picked.append(F.get("v", F.lit(i)).alias(name))
    df = rows.select(*picked)
    text = {"StimulusName", "SlideType", "EventSource", "Annotation"}
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in df.columns if c not in text})
    return FrameTable.of(df, infer_schema(df.columns))


def read_affectiva(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One JSON object per file; all scores double."""
    df = spark.read.json(check_exists(spark, paths), multiLine=True)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if t in ("bigint", "double") and c != "Timestamp" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_any(spark: SparkSession, paths: str | Sequence[str], detector: str | None = None) -> FrameTable:
    """By the detector that wrote the files."""
    return read_openface(spark, paths) if detector == "OpenFace" else read_frames(spark, paths)


def write_frames(table: FrameTable, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, CSV (missing values as empty cells) or JSON."""
    writer = table.df.write.mode(mode)
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind in ("parquet", "json"):
        getattr(writer, kind)(path)
    else:
        raise ValueError("kind is parquet, csv or json")


def pack_arrays(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Groups of scalar columns as one array column each, so that wide tables stay within generated code."""
    gone = {c for cols in groups.values() for c in cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone], *[F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias(g) for g, cols in groups.items()])


def unpack_arrays(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in groups], *[F.element_at(g, i + 1).alias(c) for g, cols in groups.items() for i, c in enumerate(cols)])


def flatten_run(runs: DataFrame) -> DataFrame:
    """Benchmark runs {metadata, records[]}: a row per record, scalar metadata repeated, nested metadata left out."""
    meta = [f.name for f in runs.schema["metadata"].dataType.fields if f.dataType.typeName() not in ("array", "struct", "map")]
    return runs.select(*[F.col(f"metadata.`{c}`").alias(c) for c in meta], F.explode("records").alias("r")).select(*meta, "r.*")


def append_rows(new: DataFrame, existing: DataFrame | None) -> DataFrame:
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def read_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return flatten_run(spark.read.json(paths_of(paths), multiLine=True))


def markdown_tables(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, section, row, cells) of the body rows of all tables; section is the heading above, carried down within a file."""
    files = spark.read.text(paths_of(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    from pyspark.sql import Window

    down = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ +", "")), ignorenulls=True).over(down)
    after = F.lead("line").over(Window.partitionBy("path").orderBy("row"))
    rule = r"^\|[\s:|-]+\|\s*$"
    marked = files.select("path", "row", "line", heading.alias("section"), after.rlike(rule).alias("header"))
    body = marked.filter(F.col("line").startswith("|") & ~F.col("line").rlike(rule) & ~F.coalesce("header", F.lit(False)))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return body.select("path", "section", "row", cells.alias("cells"))


def fps_of_ms(ms):  # noqa: ANN001, ANN201
    """Images per second of milliseconds per image, to one place."""
    return F.round(1000 / F.when(ms > 0, ms), 1)


def flatten_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value): the other numeric columns of a wide table of scores."""
    names = [c for c, t in df.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    return df.unpivot(list(keys), [F.col(f"`{c}`").cast("double").alias(c) for c in names], "metric", "value") if names else df.select(*keys)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
