"""Column groups, grouping key and order of a frame table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: Column names of frame tables.
FACEBOX = ("FaceRectX", "FaceRectY", "FaceRectWidth", "FaceRectHeight", "FaceScore")
EMOTIONS = ("anger", "disgust", "fear", "happiness", "sadness", "surprise", "neutral")
EMOTIONS_MULTITASK = ("Neutral", "Happy", "Sad", "Surprise", "Fear", "Disgust", "Anger")
POSE = ("Pitch", "Roll", "Yaw", "X", "Y", "Z")
GAZE = ("gaze_pitch", "gaze_yaw", "gaze_angle")
AUS = tuple(f"AU{k:02d}" for k in (1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15, 17, 20, 23, 24, 25, 26, 28, 43))
OPENFACE_INTENSITY = tuple(f"AU{k:02d}_r" for k in (1, 2, 4, 5, 6, 7, 9, 10, 12, 14, 15, 17, 20, 23, 25, 26, 45))
OPENFACE_PRESENCE = tuple(f"AU{k:02d}_c" for k in (1, 2, 4, 5, 6, 7, 9, 10, 12, 14, 15, 17, 20, 23, 25, 26, 28, 45))
TIME = ("frame", "approx_time", "Timestamp", "timestamp", "MediaTime", "FrameNo", "FrameTime")
DESIGN = ("StimulusName", "SlideType", "EventSource", "Annotation")
GROUPS = ("aus", "emotions", "facebox", "landmarks", "poses", "gazes", "blendshapes", "identity", "identity_embeddings", "time", "design")
_LANDMARK = re.compile(r"(mesh_)?[xyz]_\d+")


def mesh_names(points: int = 478) -> list[str]:
    """x_i, y_i, z_i point by point."""
    return [f"{axis}_{i}" for i in range(points) for axis in "xyz"]


def landmark_names(points: int = 68) -> list[str]:
    """All x, then all y."""
    return [f"{axis}_{i}" for axis in "xy" for i in range(points)]


@dataclass(frozen=True)
class FrameSchema:
    """What the columns of a frame table are. Operators return new ones.

    ``session`` names the grouping column, ``order_by`` the columns that put rows
    in order, the last of them unique within a session. ``landmark_layout`` is
    'axis' (all x, then all y) or 'point' (x, y, z of each point).
    """

    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    session: str | None = None
    order_by: tuple[str, ...] = ()
    sampling_freq: float | None = None
    landmark_layout: str = "axis"
    dialect: str = "v1"
    features: tuple[str, ...] = ()

    def group(self, name: str) -> list[str]:
        found = self.groups.get(name, ())
        if not found:
            raise AttributeError(f"no columns are known as {name}")
        return list(found)

    @property
    def numeric(self) -> list[str]:
        """Columns that hold measurements, each once."""
        out: dict[str, None] = {}
        for g in ("aus", "emotions", "facebox", "landmarks", "poses", "gazes", "blendshapes", "identity_embeddings"):
            out |= dict.fromkeys(self.groups.get(g, ()))
        return list(out)

    def with_session(self, session: str | None) -> FrameSchema:
        return replace(self, session=session)

    def with_prefix(self, prefix: str) -> FrameSchema:
        """The same groups after columns have been given a prefix."""
        return replace(self, groups={g: tuple(prefix + c for c in cols) if g not in ("time", "design") else cols for g, cols in self.groups.items()})

    def without_prefix(self, prefix: str) -> FrameSchema:
        cut = lambda c: c[len(prefix) :] if c.startswith(prefix) else c
        return replace(self, groups={g: tuple(map(cut, cols)) for g, cols in self.groups.items()})

    def resolve(self, spec: str | list[str]) -> list[str]:
        """Columns of a comma-separated list of groups, or the columns given."""
        if not isinstance(spec, str):
            return list(spec)
        out: list[str] = []
        for name in map(str.strip, spec.split(",")):
            if name == "sessions":
                if self.session is None:
                    raise ValueError("no session column is set")
                out.append(self.session)
            elif name in self.groups:
                out += self.groups[name]
            else:
                out.append(name)
        return out


def detect_dialect(columns: list[str]) -> str:
    """'v2' for tables with valence and arousal or a mesh, else 'v1'."""
    if {"valence", "arousal"} <= set(columns) or any(c.startswith("mesh_x_") for c in columns):
        return "v2"
    return "v1"


def infer_schema(columns: list[str], **known: object) -> FrameSchema:
    """Groups by name: any column with 'AU' in it is an action unit; absent groups are absent."""
    have = set(columns)
    some = lambda names: tuple(c for c in names if c in have)
    marks = tuple(c for c in columns if _LANDMARK.fullmatch(c))
    embeddings = tuple(c for c in columns if re.fullmatch(r"Identity_\d+", c))
    shapes = tuple(c for c in columns if c.startswith(("brow", "cheek", "eye", "jaw", "mouth", "nose", "tongue")) and c[-1:].isalpha() or c == "_neutral")
    dialect = detect_dialect(columns)
    groups = {
        "aus": tuple(c for c in columns if "AU" in c),
        "emotions": some(EMOTIONS_MULTITASK if dialect == "v2" else EMOTIONS) or some(EMOTIONS) or some(EMOTIONS_MULTITASK),
        "facebox": some(FACEBOX), "landmarks": marks, "poses": some(POSE), "gazes": some(GAZE), "blendshapes": shapes,
        "identity": some(("Identity",)), "identity_embeddings": embeddings, "time": some(TIME), "design": some(DESIGN),
    }
    layout = "point" if len(marks) > 2 and marks[0].replace("mesh_", "")[0] == "x" and marks[1].replace("mesh_", "")[0] == "y" else "axis"
    base = {"groups": {g: c for g, c in groups.items() if c}, "dialect": dialect, "landmark_layout": layout, "order_by": some(("input", "frame")) or some(("frame",))}
    return FrameSchema(**(base | known))
