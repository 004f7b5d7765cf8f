"""Queries of accessors, readers, loaders, box and mesh columns, with SQL that gives the same rows.

events stand in for a frame table with the usual column names; small files are written by rule in the shared
folder and read back by the reader under test.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import gaze as G
from ..functions import mesh as M
from ..functions import rotations as R
from ..operators import detect, metrics
from ..operators.frame import DLIB68_OF_MESH, FrameTable
from ..schema import AUS, EMOTIONS, FACEBOX, GAZE, POSE, infer_schema, landmark_names, mesh_names
from ..sources import frames, labels
from ..storage import shared_dir
from .catalog import _BOX as BOX_SQL
from .catalog import _KEY as KEY
from .catalog import box, query, table

SHAPES = ("browInnerUp", "jawOpen", "mouthSmileLeft")
EMBEDDING = tuple(f"Identity_{k}" for k in range(4))
MARKS = tuple(landmark_names())
MEASURED = (*AUS, *EMOTIONS, *FACEBOX, *MARKS, *POSE, *GAZE, *SHAPES, *EMBEDDING)


def _number(name: str, of: str = "event_id") -> str:
    """SQL: the measurement a column of this name holds, by its place and the row."""
    k = MEASURED.index(name)
    return f"CAST(({of} * {k + 3} + {k * k}) % 101 AS DOUBLE)"


_TEXTS = {"frame": "event_id", "input": "concat('user_', user_id)", "Identity": "concat('p', user_id % 5)", "StimulusName": "event_type"}


def _select(names: tuple[str, ...], frm: str = "events") -> str:
    return f"SELECT {', '.join(f'{_TEXTS.get(c) or _number(c)} AS "{c}"' for c in names)} FROM {frm}"


def face_frames(s: SparkSession, d: str, names: tuple[str, ...] = MEASURED) -> DataFrame:
    return table(s, d, "events").selectExpr(*[f"{v} AS {c}" for c, v in _TEXTS.items()], *[f"{_number(c)} AS {c}" for c in names])


def faces(s: SparkSession, d: str) -> FrameTable:
    return FrameTable.of(face_frames(s, d))


def mesh_table(s: SparkSession, d: str) -> FrameTable:
    names = mesh_names()
    return FrameTable(table(s, d, "nation").selectExpr(*[f"CAST(n_nationkey * {int(c[2:]) + 1} + {'xyz'.index(c[0])} AS DOUBLE) AS {c}" for c in names]), infer_schema(names))


# accessors

_ACCESSORS = {
    "emotions": EMOTIONS, "landmarks": MARKS, "landmarks_x": MARKS[:68], "landmarks_y": MARKS[68:], "poses": POSE, "gazes": GAZE, "blendshapes": SHAPES,
    "faceboxes": FACEBOX, "inputs": ("input",), "identities": ("Identity",), "identity_embeddings": EMBEDDING, "time": ("frame",), "design": ("StimulusName",),
    "landmark": MARKS, "landmark_x": MARKS[:68], "landmark_y": MARKS[68:], "facepose": POSE, "facebox": FACEBOX, "input": ("input",),
}
for _name, _columns in _ACCESSORS.items():
    query(f"frame_{_name}", _select(_columns))(lambda s, d, n=_name: getattr(faces(s, d), n))
query("frame_select", _select((*POSE, *GAZE, "frame")))(lambda s, d: faces(s, d).select("poses,gazes,frame"))
query("frame_dlib68", _select(("input", "frame", *MARKS)))(lambda s, d: faces(s, d).dlib68())
query(
    "mesh_dlib68",
    f"SELECT {', '.join(f'(n_nationkey * {p + 1} + {a})::DOUBLE AS {"xy"[a]}_{i}' for a in (0, 1) for i, p in enumerate(DLIB68_OF_MESH))} FROM nation",
)(lambda s, d: mesh_table(s, d).dlib68())
query("coordinate_names", "SELECT axis || '_' || i AS name FROM (VALUES ('x'), ('y'), ('z')) t(axis), range(478) r(i)")(lambda s, d: s.createDataFrame([(c,) for c in mesh_names()], "name string"))
query("frame_info", "SELECT * FROM (VALUES ('aus', 20), ('emotions', 7), ('landmarks', 136)) t(name, n)")(
    lambda s, d: s.createDataFrame([(r.split(": ")[0], int(r.split()[1])) for r in faces(s, d).info().splitlines() if r.endswith("columns")], "name string, n int").filter("name IN ('aus', 'emotions', 'landmarks')")
)


@query("session_iter", "SELECT event_type AS session, count(*) AS n, round(avg(value), 9) AS mean_value FROM events GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    whole = FrameTable.of(table(s, d, "events")).update_sessions("event_type")
    parts = [part.df.agg(F.lit(name).alias("session"), F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean_value")) for name, part in whole.itersessions()]
    return frames.union_all(parts)


# readers


def _folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/mimiq-files-{uuid.uuid4().hex}"


def _put(s: SparkSession, path: str, text: str) -> str:
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def _csv(s: SparkSession, df: DataFrame, path: str | None = None) -> str:
    path = path or _folder(s)
    df.write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return path


_READ = ("AU01", "AU12", "happiness", "FaceScore", "frame", "input")
_long = lambda df: df.withColumn("frame", F.col("frame").cast("long"))
query("read_frames", _select(_READ))(lambda s, d: _long(frames.read_frames(s, _csv(s, face_frames(s, d).select(*_READ))).df))
query("read_any", _select(("Pitch", "Yaw", "frame", "input")))(lambda s, d: _long(frames.read_any(s, _csv(s, face_frames(s, d).select("Pitch", "Yaw", "frame", "input"))).df))


@query("read_openface", "SELECT event_id AS frame, value AS \"AU01_r\", CAST(event_id % 2 AS DOUBLE) AS \"AU01_c\" FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "events").select(F.col("event_id").alias("frame"), F.col("value").alias(" AU01_r"), (F.col("event_id") % 2).cast("double").alias(" AU01_c"), F.lit(1).alias(" left_out"))
    return _long(frames.read_openface(s, _csv(s, df), ["frame", "AU01_r", "AU01_c"]).df.drop("input"))


@query("read_imotions", "SELECT 'clip' || i % 3 AS \"StimulusName\", (i * 7 % 50)::DOUBLE AS \"Joy\", (i - 20)::DOUBLE AS \"Yaw\" FROM range(200) t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    head = [f"#line {k}" for k in range(5)] + ["\t".join(("StimulusName", "Joy Evidence", "Joy Intensity", "Yaw Degrees"))]
    rows = [f"clip{i % 3}\t{i * 7 % 50}\t9\t{i - 20}" for i in range(200)]
    return frames.read_imotions(s, _put(s, f"{_folder(s)}/a.txt", "\n".join(head + rows) + "\n")).df


@query("read_affectiva", "SELECT 'f' || i AS face, (i * 2)::DOUBLE AS joy, (i + 1)::DOUBLE AS anger FROM range(6) t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    root = _folder(s)
    for i in range(6):
        _put(s, f"{root}/{i}.json", json.dumps({"face": f"f{i}", "joy": i * 2, "anger": i + 1}, indent=1))
    return frames.read_affectiva(s, root)


@query("flatten_run", "SELECT 'run' || r AS run, r AS seed, 'm' || i AS model, (r * 10 + i)::DOUBLE AS fps FROM range(4) t(r), range(3) u(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    root = _folder(s)
    for r in range(4):
        run = {"metadata": {"run": f"run{r}", "seed": r, "host": {"cpus": 8}}, "records": [{"model": f"m{i}", "fps": r * 10.0 + i} for i in range(3)]}
        _put(s, f"{root}/{r}.json", json.dumps(run))
    return frames.read_runs(s, root)


query("append_rows", "SELECT event_id, value, NULL::BIGINT AS user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_id % 2 = 1")(
    lambda s, d: frames.append_rows(table(s, d, "events").filter("event_id % 2 = 1").select("event_id", "user_id"), table(s, d, "events").filter("event_id % 2 = 0").select("event_id", "value"))
)


@query("markdown_tables", "SELECT 'Part ' || p AS section, 'm' || i AS model, 'v' || (p * i) AS score FROM range(3) t(p), range(4) u(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    parts = [f"## Part {p}\n\ntext\n\n| model | score |\n|:--|--:|\n" + "".join(f"| m{i} | v{p * i} |\n" for i in range(4)) for p in range(3)]
    return frames.markdown_tables(s, _put(s, f"{_folder(s)}/a.md", "# All\n\n" + "\n".join(parts))).select("section", F.col("cells")[0].alias("model"), F.col("cells")[1].alias("score"))


query("flatten_metrics", "UNPIVOT (SELECT l_returnflag, avg(l_tax::DOUBLE) AS tax, avg(l_discount::DOUBLE) AS discount FROM lineitem GROUP BY l_returnflag) ON tax, discount INTO NAME metric VALUE value")(
    lambda s, d: frames.flatten_metrics(table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_tax").cast("double")).alias("tax"), F.avg(F.col("l_discount").cast("double")).alias("discount")), ["l_returnflag"])
)
query("path_check", "SELECT 1 AS found, 1 AS absent")(lambda s, d: s.createDataFrame([(len(frames.check_exists(s, f"{d}/events.parquet")), int(_absent(s, f"{d}/no-such-file")))], "found int, absent int"))


def _absent(s: SparkSession, path: str) -> bool:
    try:
        frames.check_exists(s, path)
    except FileNotFoundError:
        return True
    return False


# loaders

_AU_NUMBERS = tuple(int(a[2:]) for a in labels.DISFA_AUS)


@query("load_disfaplus", f"SELECT 'S' || s AS subject, 'A' AS trial, i AS frame, {', '.join(f'(i * {k} % 6)::DOUBLE AS AU{k:02d}' for k in _AU_NUMBERS)} FROM range(1, 3) t(s), range(1, 21) u(i) WHERE i <= 15")
def _(s: SparkSession, d: str) -> DataFrame:
    root = _folder(s)
    for subject in (1, 2):
        for k in _AU_NUMBERS:
            # the last action unit has fewer frames: only those that all have stay
            _put(s, f"{root}/S{subject}/A/AU{k}.txt", "# frame and intensity\n" + "".join(f"{i:03d}.jpg {i * k % 6}\n" for i in range(1, 16 if k == 26 else 21)))
    return labels.load_disfaplus(s, root).labels


_DISFA = "SELECT event_id AS frame, user_id AS subject, CASE WHEN event_id % 3 = 0 THEN 'train' ELSE 'test' END AS split, event_id % 6 AS \"AU01\" FROM events"


def _disfa(s: SparkSession, d: str, **how: object) -> DataFrame:
    df = table(s, d, "events").selectExpr("event_id AS frame", "user_id AS subject", "CASE WHEN event_id % 3 = 0 THEN 'train' ELSE 'test' END AS split", "event_id % 6 AS action")
    out = labels.load_disfa(s, _csv(s, df), "train", renames={"action": "AU01"}, **how).labels
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "subject", "AU01")], "split")


query("load_disfa", f"SELECT * FROM ({_DISFA}) WHERE split = 'train'")(lambda s, d: _disfa(s, d))


@query("load_frozen", f"SELECT * FROM ({_DISFA}) WHERE split = 'train' AND frame % 2 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    labels.freeze(labels.Split("some", table(s, d, "events").selectExpr("event_id AS frame", "value").filter("frame % 2 = 0"), "au"), path, ["frame"])
    return _disfa(s, d, frozen=labels.read_frozen(s, path))


@query(
    "load_affectnet",
    f"SELECT 'img' || event_id AS \"subDirectory_filePath\", event_id % 9 AS expression_int, event_id % 50 AS \"FaceRectX\", CASE event_id % 9 {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(labels.EXPRESSIONS))} END AS expression FROM events WHERE event_id % 9 < 7",
)
def _(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "events").selectExpr("concat('img', event_id) AS subDirectory_filePath", "event_id % 9 AS expression_int", "event_id % 50 AS face_x")
    out = labels.load("affectnet_val", s, _csv(s, df), subset_size=None).labels
    return out.select("subDirectory_filePath", F.col("expression_int").cast("long").alias("expression_int"), F.col("FaceRectX").cast("long").alias("FaceRectX"), "expression")


def _pairs(s: SparkSession, name: str) -> DataFrame:
    root = _folder(s)
    _put(s, f"{root}/pairs.txt", "".join(f"a{i}.jpg {i % 2 * (i + 1)}\nb{i}.jpg {i % 2 * (i + 1)}\n" for i in range(1000)))
    cut = lambda c: F.substring_index(c, "/", -1).alias(c)
    return labels.load(name, s, root).labels.select("pair", cut("path_a"), cut("path_b"), "same_id", "fold", cut("landmark_a"))


for _name in ("calfw", "cplfw"):
    query(f"load_{_name}", "SELECT i AS pair, 'a' || i || '.jpg' AS path_a, 'b' || i || '.jpg' AS path_b, CAST(i % 2 AS INT) AS same_id, i // 300 AS fold, 'a' || i || '_5loc_attri.txt' AS landmark_a FROM range(1000) t(i)")(lambda s, d, n=_name: _pairs(s, n))


@query("load_tinyface", "SELECT i % 20 AS id, 'g' || i AS path FROM range(60) t(i) UNION ALL SELECT -1, 'd' || i FROM range(15) t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    root = _folder(s)
    for name, n in (("probe", 40), ("gallery", 60)):
        _csv(s, s.range(n).select((F.col("id") % 20).alias("id"), F.concat(F.lit(name[0]), F.col("id")).alias("path")), f"{root}/{name}.csv")
    _csv(s, s.range(15).select(F.concat(F.lit("d"), F.col("id")).alias("path")), f"{root}/distractors.csv")
    return labels.load("tinyface", s, root).extras["gallery"].select(F.col("id").cast("long").alias("id"), "path")


@query("load_columbia_gaze", "SELECT lpad(CAST(i AS VARCHAR), 4, '0') AS subject, 0 AS head_pose_deg, round(radians(v), 9) AS pitch, round(radians(h), 9) AS yaw FROM range(1, 4) t(i), (VALUES (-10), (0)) a(v), (VALUES (5), (15)) b(h)")
def _(s: SparkSession, d: str) -> DataFrame:
    root = _folder(s)
    for name in [f"{i:04d}_2m_{p}P_{v}V_{h}H.jpg" for i in (1, 2, 3) for p in (0, 15) for v in (-10, 0) for h in (5, 15)]:
        _put(s, f"{root}/{name}", "x")
    return labels.load("columbia_gaze", s, root).labels.select("subject", "head_pose_deg", F.round("gaze_pitch_rad", 9).alias("pitch"), F.round("gaze_yaw_rad", 9).alias("yaw"))


query("available_splits", "SELECT 'disfa' AS name")(lambda s, d: s.createDataFrame([(n,) for n in labels.available({"disfa": d, "calfw": f"{d}/none", "other": d})], "name string"))
query("capabilities", "SELECT 'stub' AS model")(lambda s, d: s.createDataFrame([(m,) for k in detect.capabilities().values() for m in k if m == "stub"], "model string").distinct())

# boxes and points

_k = ", ".join(KEY)
_edges = lambda: B.xyxy(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))


def _box_query(name: str, made: Callable[[], Column], sql: dict[str, str]) -> None:
    """Fields of a struct over the boxes of lineitem, each against SQL."""
    query(name, f"SELECT {_k}, {', '.join(f'round({v}, 6) AS "{c}"' for c, v in sql.items())} FROM {BOX_SQL}")(
        lambda s, d: box(s, d).select(*KEY, made().alias("r")).select(*KEY, *[(F.round(F.col(f"r.{c}").cast("double"), 6) + 0.0).alias(c) for c in sql])
    )


_box_query("box_xywh", lambda: B.to_xywh(_edges()), {"x": "x", "y": "y", "w": "w", "h": "h"})
_box_query("box_regress", lambda: B.regress_box(_edges(), [F.lit(v) for v in (0.1, -0.2, 0.3, 0.4)]), {"left": "x + 0.1::DOUBLE * (w + 1)", "top": "y - 0.2::DOUBLE * (h + 1)", "right": "x + w + 0.3::DOUBLE * (w + 1)", "bottom": "y + h + 0.4::DOUBLE * (h + 1)"})
_box_query(
    "box_pixels",
    lambda: B.clip_pixels(B.xyxy(F.col("x") - 5, F.col("y") - 5, F.col("x") + F.col("x2"), F.col("y") + F.col("y2")), 30, 25),
    {"left": "greatest(1, trunc(x - 5))", "top": "greatest(1, trunc(y - 5))", "right": "least(30, trunc(x + x2))", "bottom": "least(25, trunc(y + y2))"},
)
_box_query("box_of_crop", lambda: B.crop_to_box(F.col("x"), F.col("y"), F.col("x2")), {"left": "x", "top": "y", "right": "x + x2", "bottom": "y + x2"})
_box_query("original_size", lambda: B.original_size(F.col("y2") + 100, F.col("x2") + 120, F.lit(4), F.lit(6), F.lit(3), F.lit(5), F.lit(0.5)), {"height": "(y2 + 92) / 0.5::DOUBLE", "width": "(x2 + 110) / 0.5::DOUBLE"})
_prior = lambda: [F.col("x"), F.col("y"), F.lit(20.0), F.lit(30.0)]
_box_query("decode_all_edges", lambda: B.decode_box([F.col("x2") / 40, F.col("y2") / 40, F.col("w") / 100, F.col("h") / 100], _prior()), {
    e: f"{c} + 0.1::DOUBLE * {c}2 / 40 * {n} {sign} {n} * exp(0.2::DOUBLE * {z} / 100) / 2" for e, c, z, n, sign in (("left", "x", "w", 20, "-"), ("top", "y", "h", 30, "-"), ("right", "x", "w", 20, "+"), ("bottom", "y", "h", 30, "+"))
})
_point = lambda p, k: F.struct(F.element_at(p, k)["x"].alias("x"), F.element_at(p, k)["y"].alias("y"))
_box_query("decode_points", lambda: _point(B.decode_points([F.lit(0.0), F.lit(0.0), F.col("x2") / 40, F.col("y2") / 40], _prior()), 2), {"x": "x + 0.1::DOUBLE * x2 / 40 * 20", "y": "y + 0.1::DOUBLE * y2 / 40 * 30"})
_one = lambda: F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
_box_query("points_to_unit", lambda: _point(B.to_unit_points(_one(), _edges()), 1), {"x": "(x2 - x) / w", "y": "(y2 - y) / h"})
_box_query("points_from_unit", lambda: _point(B.from_unit_points(_one(), _edges()), 1), {"x": "x2 * w + x", "y": "y2 * h + y"})
_box_query("points_to_49", lambda: F.struct(*[F.get(B.points_to_49(F.transform(F.sequence(F.lit(0), F.lit(67)), lambda i: F.col("x") + i)), F.lit(k)).alias(f"p{k}") for k in (0, 42, 43, 46, 48)]), {"p0": "x + 17", "p42": "x + 59", "p43": "x + 61", "p46": "x + 65", "p48": "x + 67"})
query("boxes_of_map", f"SELECT image, floor((2 * c + 1) / 0.5) AS left, floor((2 * r + 1) / 0.5) AS top, floor((2 * c + 12) / 0.5) AS right, floor((2 * r + 12) / 0.5) AS bottom, score FROM (SELECT l_orderkey AS image, l_linenumber AS r, (l_partkey % 40)::DOUBLE AS c, (l_quantity / 50)::DOUBLE AS score FROM lineitem) WHERE score >= 0.6")(
    lambda s, d: B.boxes_of_map(table(s, d, "lineitem").selectExpr("l_orderkey AS image", "l_linenumber AS row", "CAST(l_partkey % 40 AS DOUBLE) AS col", "CAST(l_quantity AS DOUBLE) / 50 AS score"), 0.5, 0.6)
)
query(
    "priors_unit",
    " UNION ALL ".join(
        f"SELECT {level} AS level, i * 2 + k AS place, round((i % {-(-96 // step)} + 0.5) * {step} / 96, 9) AS cx, round((i // {-(-96 // step)} + 0.5) * {step} / 128, 9) AS cy, round(size / 96.0, 9) AS w, round(size / 128.0, 9) AS h FROM range({-(-128 // step) * -(-96 // step)}) t(i), (VALUES (0, {a}), (1, {b})) u(k, size)"
        for level, (step, a, b) in enumerate(((8, 16, 32), (16, 64, 128), (32, 256, 512)))
    ),
)(lambda s, d: B.priors(s, 128, 96).select("level", "place", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")]))

# meshes

_value = lambda: F.col("value")
_points = lambda: F.transform(F.sequence(F.lit(0), F.lit(477)), lambda i: F.struct(((i % 7) * _value()).alias("x"), (i % 5 + _value()).alias("y"), ((i % 3) + 1.0 + F.when(i >= 468, _value()).otherwise(0.0)).alias("z")))


def meshes(s: SparkSession, d: str) -> DataFrame:
    """A mesh for each event, behind a generator, so that it is made once and not at every use."""
    return table(s, d, "events").select("event_id", "value", F.explode(F.array(_points())).alias("mesh"))


def _event_query(name: str, made: Callable[[], Column], sql: dict[str, str], frm: str = "events") -> None:
    query(name, f"SELECT event_id, {', '.join(f'round({v}, 6) AS "{c}"' for c, v in sql.items())} FROM {frm}")(
        lambda s, d: meshes(s, d).select("event_id", made().alias("r")).select("event_id", *[(F.round(F.col("r")[c], 6) + 0.0).alias(c) for c in sql])
    )


_at = lambda p, i: F.element_at(p, i + 1)
_event_query("canonical_axes", lambda: _at(M.to_canonical_axes(F.col("mesh")), 13), {"x": "6 * value", "y": "-(3 + value)", "z": "-2.0"})
_event_query(
    "mesh_to_frame",
    lambda: _at(M.unit_mesh_to_frame(F.col("mesh"), F.lit(10.0), F.lit(20.0), F.lit(60.0), F.lit(90.0), F.lit(4.0), F.lit(2.0), F.lit(0.5)), 13),
    {"x": "(6 * value * 50 + 10 - 4) / 0.5::DOUBLE", "y": "((3 + value) * 70 + 20 - 2) / 0.5::DOUBLE", "z": "2.0"},
)
_far = lambda ring, c: "(" + " + ".join(f"sqrt(pow(({i % 7} - {c % 7}) * value, 2) + pow({i % 5} - {c % 5}, 2) + pow({i % 3} - {c % 3}, 2))" for i in ring) + ") / 4"
_event_query("iris_radii", lambda: M.iris_radii(F.col("mesh")), {"left": _far(range(469, 473), 468), "right": _far(range(474, 478), 473)})
_event_query(
    "pupil_shift",
    lambda: M.pupil_shift(F.struct(_value().alias("left"), F.lit(2.0).alias("right")), _value() / 100, _value() / 200),
    {"x": "-0.45::DOUBLE * (value + 2) / 2 * sin(value / 200) * cos(value / 100)", "y": "0.45::DOUBLE * (value + 2) / 2 * sin(value / 100)"},
)


def _eye_sql(outline: tuple[int, ...], iris: tuple[int, ...]) -> list[str]:
    mean = lambda of, m: f"({'+'.join(str(i % m) for i in of)}) / {len(of)}.0::DOUBLE"
    v = [f"({mean(iris, 7)} - {mean(outline, 7)}) * value", f"({mean(iris, 5)} - {mean(outline, 5)})", f"({mean(iris, 3)} - {mean(outline, 3)} + value)"]
    return v


_eyes = {"l": _eye_sql(G.LEFT_EYE, G.LEFT_IRIS), "r": _eye_sql(G.RIGHT_EYE, G.RIGHT_IRIS)}
_eye_from = "(SELECT event_id, value, " + ", ".join(f"{v} AS {e}{a}" for e, vs in _eyes.items() for a, v in zip("xyz", vs, strict=True)) + " FROM events)"
_unit_from = "(SELECT event_id, " + ", ".join(f"{e}{a} / greatest(sqrt({e}x * {e}x + {e}y * {e}y + {e}z * {e}z), 1e-12) AS {e}{a}" for e in "lr" for a in "xyz") + f" FROM {_eye_from})"
_gaze = lambda: G.estimate_gaze(F.col("mesh"))
_angle = lambda e: {"pitch": f"atan2({e}y, sqrt({e}x * {e}x + {e}z * {e}z))", "yaw": f"atan2(-{e}x, {e}z)"}
_event_query("gaze_left", lambda: _gaze()["left"], _angle("l"), _unit_from)
_event_query("gaze_right", lambda: _gaze()["right"], _angle("r"), _unit_from)
_event_query("gaze_combined", lambda: _gaze()["combined"], _angle("m"), "(SELECT event_id, " + ", ".join(f"(l{a} + r{a}) / 2 AS m{a}" for a in "xyz") + f" FROM {_unit_from})")


@query("head_angles", "SELECT event_id, round(((event_id * 7) % 200 - 100) / 100.0::DOUBLE, 6) AS a, round(((event_id * 11) % 200 - 100) / 100.0::DOUBLE, 6) AS b, round(((event_id * 13) % 200 - 100) / 100.0::DOUBLE, 6) AS c FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b, c = (F.expr(f"CAST(((event_id * {k}) % 200 - 100) AS DOUBLE) / 100") for k in (7, 11, 13))
    sa, sb, sc, ca, cb, cc = F.sin(a), F.sin(b), F.sin(c), F.cos(a), F.cos(b), F.cos(c)
    # about x, then y, then z
    m = F.array(cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, -sb, cb * sa, cb * ca)
    found = table(s, d, "events").select("event_id", R.head_angles_of_matrix(m).alias("r"))
    return found.select("event_id", *[(F.round(f"r.{n}", 6) + 0.0).alias(k) for k, n in (("a", "pitch"), ("b", "roll"), ("c", "yaw"))])


# scores of evaluated frames

query("gaze_errors", "SELECT round(avg(e), 4) AS mean_error FROM (SELECT degrees(abs(value / 100 - value / 200)) AS e FROM events)")(
    lambda s, d: metrics.gaze_errors(table(s, d, "events").select((_value() / 100).alias("p"), F.lit(0.0).alias("y"), (_value() / 200).alias("p2"), F.lit(0.0).alias("y2")), ("p", "y"), ("p2", "y2")).select(F.round("gaze_angular_error_deg", 4).alias("mean_error"))
)
query("emotion_class", "SELECT event_id AS frame, " + f"[6, 5, 4, 1, 2, 3, 0][list_position(l, list_max(l))] AS k FROM (SELECT event_id, [{', '.join(_number(e) for e in EMOTIONS)}] AS l FROM events)")(
    lambda s, d: face_frames(s, d).select("frame", metrics.emotion_class(EMOTIONS).alias("k"))
)
query("align_to_frames", "SELECT i AS frame, CASE WHEN i % 2 = 0 THEN i * 1.0::DOUBLE END AS score FROM range(100) t(i)")(
    lambda s, d: metrics.align_to_frames(s.range(100).filter("id % 2 = 0").select(F.col("id").alias("frame"), F.col("id").cast("double").alias("score")), 100)
)
