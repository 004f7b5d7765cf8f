"""Frame tables: a DataFrame with its schema, and grouped operators on it.

Every operator returns a new FrameTable and declares a plan; nothing is
collected. The session is a column and row order is explicit, so results do not
depend on how rows happen to lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..nulls import nan_to_null, safe_divide, safe_log10
from ..schema import FrameSchema, infer_schema
from ..storage import materialize

SUMMARIES: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(c),
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.when(F.count(c) > 0, F.count(c))),
    "std": lambda c: F.stddev_samp(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
}
#: Of a 478-point mesh, the points that stand for the 68 of the other convention, in its order.
DLIB68_OF_MESH = (
    127, 234, 93, 132, 58, 172, 136, 150, 176, 148, 152, 377, 400, 379, 365, 397, 356,
    70, 63, 105, 66, 107,
    336, 296, 334, 293, 300,
    168, 6, 195, 4,
    240, 75, 1, 305, 460,
    33, 160, 158, 133, 153, 144,
    362, 385, 387, 263, 373, 380,
    61, 39, 37, 0, 267, 269, 291, 405, 314, 17, 84, 181,
    78, 82, 13, 312, 308, 317, 14, 87,
)


def q(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class FrameTable:
    """``df`` and what its columns mean. NaN has become NULL."""

    df: DataFrame
    schema: FrameSchema

    @staticmethod
    def of(df: DataFrame, schema: FrameSchema | None = None, **known: object) -> FrameTable:
        return FrameTable(nan_to_null(df), schema or infer_schema(df.columns, **known))

    # projections

    def keys(self) -> list[str]:
        """Session and order columns that the table has."""
        wanted = [*((self.schema.session,) if self.schema.session else ()), *self.schema.order_by]
        return [c for c in dict.fromkeys(wanted) if c in self.df.columns]

    def group(self, name: str) -> DataFrame:
        """The columns of a group, AttributeError if the table has none."""
        return self.df.select(*map(q, self.schema.group(name)))

    def __getattr__(self, name: str) -> DataFrame:
        alias = {
            "landmark": "landmarks", "facepose": "poses", "input": "inputs", "landmark_x": "landmarks_x", "landmark_y": "landmarks_y",
            "facebox": "faceboxes", "identity": "identities",
        }.get(name, name)
        if alias in ("aus", "emotions", "landmarks", "poses", "gazes", "blendshapes", "time", "design", "identity_embeddings"):
            return self.group(alias)
        if alias == "faceboxes":
            return self.group("facebox")
        if alias == "identities":
            return self.group("identity")
        if alias == "inputs":
            return self.df.select("input")
        if alias in ("landmarks_x", "landmarks_y"):
            return self.df.select(*[q(c) for c in self.schema.group("landmarks") if c.replace("mesh_", "").startswith(alias[-1])])
        raise AttributeError(name)

    def select(self, spec: str | list[str]) -> DataFrame:
        """Columns by a list such as 'aus,poses'."""
        return self.df.select(*map(q, self.schema.resolve(spec)))

    def dlib68(self) -> DataFrame:
        """Keys and x_0 … x_67, y_0 … y_67: as they are, or gathered from a mesh."""
        marks = self.schema.group("landmarks")
        xs, ys = ([c for c in marks if c.replace("mesh_", "").startswith(a)] for a in "xy")
        if len(xs) == 68:
            pick = range(68)
        elif len(xs) in (468, 478):
            pick = DLIB68_OF_MESH
        else:
            raise ValueError(f"{len(xs)} points have no 68-point view")
        number = lambda cols: {int(c.rpartition("_")[2]): c for c in cols}
        at = {"x": number(xs), "y": number(ys)}
        return self.df.select(*map(q, self.keys()), *[q(at[a][p]).alias(f"{a}_{i}") for a in "xy" for i, p in enumerate(pick)])

    def info(self) -> str:
        """Groups, session, order and sampling rate, as text."""
        s = self.schema
        lines = [f"{g}: {len(c)} columns" for g, c in s.groups.items()]
        return "\n".join([*lines, f"session: {s.session}", f"order: {', '.join(s.order_by)}", f"sampling_freq: {s.sampling_freq}"])

    # sessions and set operations

    def update_sessions(self, new: Mapping[object, object] | Column | str, name: str = "session") -> FrameTable:
        """Set the grouping key: a column, or a map from old labels (an unmapped label becomes NULL)."""
        if isinstance(new, str):
            return replace(self, schema=self.schema.with_session(new))
        if isinstance(new, Mapping):
            if self.schema.session is None:
                raise ValueError("there are no sessions to map from")
            pairs = [F.lit(x) for kv in new.items() for x in kv]
            column = F.element_at(F.create_map(*pairs), q(self.schema.session)) if pairs else F.lit(None).cast("string")
        elif isinstance(new, Column):
            column = new
        else:
            raise TypeError("sessions are set by a column, its name, or a map")
        return FrameTable(self.df.withColumn(name, column), self.schema.with_session(name))

    def itersessions(self) -> Iterator[tuple[object, FrameTable]]:
        """(label, rows of it) of one session after another; labels come to the driver a partition at a time."""
        if self.schema.session is None:
            raise ValueError("no session column is set")
        label = q(self.schema.session)
        for (name,) in self.df.select(label).distinct().toLocalIterator():
            yield name, replace(self, df=self.df.filter(label.eqNullSafe(F.lit(name))))

    def append(self, other: FrameTable, session_id: object = None, axis: int = 0) -> FrameTable:
        """axis 0: union all by name, of equal sampling rates. axis 1: columns bound by the keys."""
        if axis == 0:
            if self.schema.sampling_freq != other.schema.sampling_freq:
                raise ValueError("sampling rates differ")
            add = other.df
            if session_id is not None:
                add = add.withColumn(self.schema.session or "session", F.lit(session_id))
            schema = self.schema.with_session(self.schema.session or ("session" if session_id is not None else None))
            return FrameTable(self.df.unionByName(add, allowMissingColumns=True), schema)
        if axis == 1:
            keys = self.keys()
            if not keys:
                raise ValueError("binding columns needs key columns")
            new = [c for c in other.df.columns if c not in self.df.columns]
            groups = {g: (*self.schema.groups.get(g, ()), *(c for c in cols if c in new)) for g, cols in other.schema.groups.items()}
            return FrameTable(self.df.join(other.df.select(*map(q, keys), *map(q, new)), keys, "full"), replace(self.schema, groups=self.schema.groups | groups))
        raise ValueError("axis is 0 or 1")

    # summaries

    def summary(self, kinds: Sequence[str] = ("mean", "sem", "std", "max", "min"), ignore_sessions: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
        """Summaries of each numeric column by session in one aggregation, named kind_column."""
        unknown = set(kinds) - set(SUMMARIES)
        if unknown or not kinds:
            raise ValueError(f"summaries are some of {', '.join(SUMMARIES)}")
        columns = list(columns or self.schema.numeric)
        by = [] if ignore_sessions or not self.schema.session else [q(self.schema.session)]
        return self.df.groupBy(*by).agg(*[SUMMARIES[k](f"`{c}`").alias(f"{k}_{c}") for k in kinds for c in columns])

    # order-aware operators

    def ordered(self, ignore_sessions: bool = False) -> Window:
        """A window in row order within sessions; it asks for an order."""
        if not self.schema.order_by:
            raise ValueError("this needs order_by, ending in a column that is unique within a session")
        by = [] if ignore_sessions or not self.schema.session else [q(self.schema.session)]
        return Window.partitionBy(*by).orderBy(*map(q, self.schema.order_by))

    def baseline(self, baseline: str | Mapping[str, float] = "median", normalize: str | None = None, ignore_sessions: bool = False, columns: Sequence[str] | None = None) -> FrameTable:
        """Less its session's median, mean or first row, or given values.

        normalize: 'pct' is 100·(x - b)/b, 'db' is 10·log10(x - b)/b (of a
        negative argument NULL, of zero minus infinity). Averages are one small
        aggregation, joined back; a session's rows do not meet in one task.
        """
        columns = list(columns or self.schema.numeric)
        by = [] if ignore_sessions or not self.schema.session else [self.schema.session]
        if isinstance(baseline, Mapping):
            base, df = {c: F.lit(float(baseline[c])) if c in baseline else F.lit(None).cast("double") for c in columns}, self.df
        elif baseline in ("median", "mean", "begin"):
            if baseline == "begin":
                if not self.schema.order_by:
                    raise ValueError("the first row needs order_by")
                order = F.struct(*map(q, self.schema.order_by))
                made = [F.min_by(F.struct(q(c).alias("v")), order)["v"].alias(f"__b{i}") for i, c in enumerate(columns)]
            else:
                made = [(F.median if baseline == "median" else F.avg)(q(c)).alias(f"__b{i}") for i, c in enumerate(columns)]
            df = self.df.withColumn("__s", q(by[0]) if by else F.lit(0))
            bases = df.groupBy("__s").agg(*made)
            df = df.join(bases.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left").drop("__s", "__t")
            base = {c: F.col(f"__b{i}") for i, c in enumerate(columns)}
        else:
            raise ValueError("baseline is median, mean, begin or values by column")
        if normalize is None:
            change = lambda x, b: x - b
        elif normalize == "pct":
            change = lambda x, b: safe_divide(100 * (x - b), b)
        elif normalize == "db":
            change = lambda x, b: safe_divide(10 * safe_log10(x - b), b)
        else:
            raise ValueError("normalize is None, 'db' or 'pct'")
        out = df.select(*[change(q(c).cast("double"), base[c]).alias(c) if c in columns else q(c) for c in self.df.columns])
        return replace(self, df=out)

    def rectification(self, std: float = 3, columns: Sequence[str] | None = None) -> FrameTable:
        """Box, AU and emotion values of rows whose box lies more than ``std`` deviations off become NULL; rows stay."""
        groups = self.schema.groups
        if columns is None and not all(groups.get(g) for g in ("facebox", "aus", "emotions")):
            raise ValueError("face box, action unit and emotion columns are needed")
        blank = set(columns or (*groups["facebox"], *groups["aus"], *groups["emotions"]))
        made = [f(c).alias(f"__{n}{i}") for i, c in enumerate(("FaceRectX", "FaceRectY")) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
        # one row of four numbers
        df = self.df.crossJoin(F.broadcast(self.df.agg(*made)))
        off = reduce(lambda a, b: a | b, [(F.col(c) > F.col(f"__m{i}") + std * F.col(f"__s{i}")) | (F.col(c) < F.col(f"__m{i}") - std * F.col(f"__s{i}")) for i, c in enumerate(("FaceRectX", "FaceRectY"))])
        off = F.coalesce(off, F.lit(False))
        return replace(self, df=df.select(*[F.when(~off, q(c)).alias(c) if c in blank else q(c) for c in self.df.columns]))

    def downsample(self, target: float, target_type: str = "samples", method: str = "mean", columns: Sequence[str] | None = None) -> FrameTable:
        """Mean or median of blocks of rows in order; a last block may be short.

        A block is ``target`` rows ('samples'), seconds, or what makes
        ``target`` Hz; halves round to even.
        """
        rows = rows_per_bin(target, target_type, self.schema.sampling_freq)
        if method not in ("mean", "median"):
            raise ValueError("method is mean or median")
        columns = list(columns or self.schema.numeric)
        by = [self.schema.session] if self.schema.session else []
        binned = self.df.withColumn("bin", F.floor((F.row_number().over(self.ordered()) - 1) / rows))
        out = binned.groupBy(*map(q, by), "bin").agg(*[(F.avg if method == "mean" else F.median)(q(c)).alias(c) for c in columns])
        freq = self.schema.sampling_freq / rows if self.schema.sampling_freq else None
        return FrameTable(out, replace(self.schema, sampling_freq=freq, order_by=("bin",)))

    def distance(self, metric: str = "euclidean", columns: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
        """(a, b, distance) of all pairs a < b of rows by key, computed block by block."""
        from .identity import pair_distances

        columns = list(columns or self.schema.numeric)
        key = key or self.schema.order_by[-1]
        vectors = self.df.select(q(key).alias("id"), F.array(*[q(c).cast("double") for c in columns]).alias("v"))
        return pair_distances(vectors, metric)

    # the names that summaries and analyses go by elsewhere

    def extract_mean(self, ignore_sessions: bool = False) -> DataFrame:
        return self.summary(["mean"], ignore_sessions)

    def extract_std(self, ignore_sessions: bool = False) -> DataFrame:
        return self.summary(["std"], ignore_sessions)

    def extract_sem(self, ignore_sessions: bool = False) -> DataFrame:
        return self.summary(["sem"], ignore_sessions)

    def extract_min(self, ignore_sessions: bool = False) -> DataFrame:
        return self.summary(["min"], ignore_sessions)

    def extract_max(self, ignore_sessions: bool = False) -> DataFrame:
        return self.summary(["max"], ignore_sessions)

    def extract_summary(self, mean: bool = True, std: bool = True, sem: bool = True, max: bool = True, min: bool = True, ignore_sessions: bool = False) -> DataFrame:  # noqa: A002
        if not (mean or max or min):
            raise ValueError("at least one of mean, max and min is needed")
        wanted = {"mean": mean, "sem": sem, "std": std, "max": max, "min": min}
        return self.summary([k for k, on in wanted.items() if on], ignore_sessions)

    def regress(self, X: str | list[str], y: str | list[str], fit_intercept: bool = True):  # noqa: ANN201
        from .stats import regress

        return regress(self.df, self.schema.resolve(X), self.schema.resolve(y), fit_intercept)

    def predict(self, X: str | list[str], y: str, k: int = 5) -> DataFrame:
        """r2 of least squares on each fold; any other estimator goes through stats.cross_val_fit."""
        from .stats import cross_val_regress

        return cross_val_regress(self.df, self.schema.resolve(X), y, k, self.schema.order_by)

    def ttest_1samp(self, popmean: float = 0.0) -> DataFrame:
        from .stats import ttest_1samp

        return ttest_1samp(self.df, self.schema.numeric, popmean)

    def ttest_ind(self, col: str, sessions: Sequence[object] | None = None) -> DataFrame:
        from .stats import ttest_ind

        if self.schema.session is None:
            raise ValueError("no session column is set")
        return ttest_ind(self.df, col, self.schema.session, sessions)

    def isc(self, col: str, index: str = "frame", columns: str = "input", method: str = "pearson") -> DataFrame:
        from .stats import isc

        return isc(self.df, col, index, columns, method)

    def decompose(self, algorithm: str = "pca", n_components: int | None = None, columns: Sequence[str] | None = None):  # noqa: ANN201
        from .stats import decompose

        return decompose(self.df, list(columns or self.schema.numeric), algorithm, n_components)

    def clean(self, **how: object) -> FrameTable:
        from .signal import clean

        return clean(self, **how)

    def upsample(self, target: float, target_type: str = "hz", **how: object) -> FrameTable:
        from .signal import upsample

        return upsample(self, target, target_type, **how)

    def extract_wavelet(self, freq: float, num_cyc: float = 3, mode: str = "complex", ignore_sessions: bool = False) -> FrameTable:
        from .signal import wavelets

        return wavelets(self, [freq], num_cyc, mode, ignore_sessions=ignore_sessions)

    def extract_multi_wavelet(self, min_freq: float = 0.06, max_freq: float = 0.66, bank: int = 8, **how: object) -> FrameTable:
        from .signal import multi_wavelet

        return multi_wavelet(self, min_freq, max_freq, bank, **how)

    def extract_boft(self, min_freq: float = 0.06, max_freq: float = 0.66, bank: int = 8, **how: object) -> DataFrame:
        from .signal import boft

        return boft(self, min_freq, max_freq, bank, **how)

    def compute_identities(self, threshold: float = 0.8, method: str = "gallery", min_cluster_size: int = 2, scope: str | None = None) -> FrameTable:
        """Adds Identity from the embedding columns, or from an array column 'embedding'."""
        from .identity import cluster_identities

        if not self.schema.order_by:
            raise ValueError("this needs order_by, ending in a column that is unique")
        vector = F.col("embedding") if "embedding" in self.df.columns else F.array(*map(q, self.schema.group("identity_embeddings")))
        # rows are numbered in their order within the scope, by their keys alone
        place = F.row_number().over(Window.partitionBy(q(scope) if scope else F.lit(0)).orderBy(*map(q, self.schema.order_by)))
        keys = list(dict.fromkeys([*((scope,) if scope else ()), *self.schema.order_by]))
        number = materialize(self.df.select(*map(q, keys)).withColumn("__id", place.cast("long")), "order")
        marks = number.select("__id", *[q(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        same = reduce(lambda x, y: x & y, [q(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        joined = self.df.withColumn("__v", vector).join(marks, same)
        named = cluster_identities(joined.select(F.col("__id").alias("id"), F.col("__v").alias("v"), *([q(scope)] if scope else [])), threshold, method, min_cluster_size, scope, with_scope=True)
        named = named.select(F.col("id").alias("__n"), F.col("scope").alias("__scope"), "Identity")
        back = (F.col("__id") == F.col("__n")) & (q(scope).eqNullSafe(F.col("__scope")) if scope else F.lit(True))
        old = [c for c in self.df.columns if c != "Identity"]
        df = joined.drop("Identity").join(named, back).select(*map(q, old), "Identity")
        return FrameTable(df, replace(self.schema, groups=self.schema.groups | {"identity": ("Identity",)}))


def rows_per_bin(target: float, target_type: str, sampling_freq: float | None) -> int:
    if target_type == "samples":
        rows = round(target)
    elif target_type in ("seconds", "hz"):
        if not sampling_freq:
            raise ValueError(f"{target_type} needs a sampling rate")
        rows = round(sampling_freq * target) if target_type == "seconds" else round(sampling_freq / target)
    else:
        raise ValueError("target_type is samples, seconds or hz")
    if rows < 1:
        raise ValueError("a block would have no rows")
    return rows


def binarize(x: Column, threshold: float) -> Column:
    return (x >= threshold).cast("int")
