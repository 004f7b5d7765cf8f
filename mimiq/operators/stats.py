"""Statistics of a table: least squares, t-tests, correlation between subjects, distances, decomposition, cross-validation.

Each is one or two aggregations of moments; only matrices of the number of
columns reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_p_value, t_two_sided
from ..storage import materialize
from .frame import q


def _moments(df: DataFrame, columns: Sequence[str], weights: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and centred cross products of rows without NULL, in two passes for conditioning."""
    whole = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    k = len(columns)
    first = whole.agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    if not first["n"]:
        return 0, np.zeros(k), np.zeros((k, k))
    mean = np.array([first[f"m{i}"] for i in range(k)])
    centred = [F.col(f"c{i}") - float(mean[i]) for i in range(k)]
    row = whole.agg(*[F.sum(centred[i] * centred[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cross = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = row[f"p{i}_{j}"]
    return first["n"], mean, cross


@dataclass(frozen=True)
class Regression:
    """Coefficients by predictor (rows; 'intercept' last if fitted) and outcome (columns)."""

    predictors: tuple[str, ...]
    outcomes: tuple[str, ...]
    b: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    df: int
    intercept: bool

    def table(self, spark) -> DataFrame:  # noqa: ANN001
        rows = [(x, y, float(self.b[i, j]), float(self.se[i, j]), float(self.t[i, j]), float(self.p[i, j]), self.df) for i, x in enumerate(self.predictors) for j, y in enumerate(self.outcomes)]
        return spark.createDataFrame(rows, "predictor string, outcome string, b double, se double, t double, p double, df long")

    def residuals(self, df: DataFrame) -> DataFrame:
        """``df`` with a residual_ column for each outcome."""
        xs = [c for c in self.predictors if c != "intercept"]
        out = {}
        for j, y in enumerate(self.outcomes):
            fit = F.lit(float(self.b[-1, j]) if self.intercept else 0.0)
            for i, x in enumerate(xs):
                fit = fit + float(self.b[i, j]) * q(x)
            out[f"residual_{y}"] = q(y) - fit
        return df.withColumns(out)


def regress(df: DataFrame, X: Sequence[str], y: Sequence[str], fit_intercept: bool = True, mode: str = "ols") -> Regression:
    """Least squares of each outcome on the predictors, by pseudoinverse.

    Rows with a NULL in any column are left out. The input is not changed.
    """
    if mode != "ols":
        raise NotImplementedError(f"mode {mode}")
    X, y = list(X), list(y)
    n, mean, cross = _moments(df, [*X, *y])
    p = len(X)
    if not fit_intercept:
        cross = cross + n * np.outer(mean, mean)
    inverse = np.linalg.pinv(cross[:p, :p], hermitian=True) if p else np.zeros((0, 0))
    b = inverse @ cross[:p, p:]
    rss = np.maximum(np.diag(cross[p:, p:]) - 2 * np.sum(b * cross[:p, p:], 0) + np.sum(b * (cross[:p, :p] @ b), 0), 0)
    free = max(n - p - int(fit_intercept), 1)
    variance = np.diag(inverse)[:, None]
    names = X
    if fit_intercept:
        b = np.vstack([b, mean[p:] - mean[:p] @ b])
        variance = np.vstack([variance, [[1 / max(n, 1) + mean[:p] @ inverse @ mean[:p]]]])
        names = [*X, "intercept"]
    se = np.sqrt(variance * rss / free)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = b / se
    return Regression(tuple(names), tuple(y), b, se, t, t_two_sided(t, np.full(t.shape, free)), free, fit_intercept)


def ttest_1samp(df: DataFrame, columns: Sequence[str], popmean: float = 0.0) -> DataFrame:
    """column, n, t, p: one row per column."""
    made = [F.struct(F.lit(c).alias("column"), F.count(q(c)).alias("n"), F.avg(q(c)).alias("m"), F.stddev_samp(q(c)).alias("s")) for c in columns]
    rows = df.agg(F.array(*made).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    t = F.when(F.col("s") > 0, (F.col("m") - popmean) / (F.col("s") / F.sqrt("n")))
    return rows.select("column", "n", t.alias("t"), t_p_value(t, F.col("n") - 1).alias("p"))


def ttest_ind(df: DataFrame, column: str, session: str, sessions: Sequence[object] | None = None) -> DataFrame:
    """t, p, df of two sessions with pooled variance; by default the table must have exactly two."""
    if sessions is None:
        found = [r[0] for r in df.select(q(session)).filter(q(session).isNotNull()).distinct().orderBy(q(session)).limit(3).collect()]
        if len(found) != 2:
            raise ValueError("exactly two sessions are needed")
        sessions = found
    elif len(sessions) != 2:
        raise ValueError("exactly two sessions are needed")
    made = []
    for k, s in enumerate(sessions):
        x = F.when(q(session) == F.lit(s), q(column))
        made += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}")]
    c = F.col
    free = c("n0") + c("n1") - 2
    pooled = ((c("n0") - 1) * c("v0") + (c("n1") - 1) * c("v1")) / F.when(free > 0, free)
    t = (c("m0") - c("m1")) / F.sqrt(F.when(pooled > 0, pooled) * (1 / c("n0") + 1 / c("n1")))
    return df.agg(*made).select(t.alias("t"), free.alias("df"), t_p_value(t, free).alias("p"))


def isc(df: DataFrame, col: str, index: str, columns: str, method: str = "pearson") -> DataFrame:
    """(a, b, n, r): correlation of each pair of subjects over the index values both have.

    Values are first averaged by index and subject. All ordered pairs are given. n is the number of
    index values in common; r is NULL where either side does not vary.
    """
    cell = df.groupBy(q(index).alias("i"), q(columns).alias("s")).agg(F.avg(q(col)).alias("v")).filter("v is not null and s is not null and i is not null")
    pair = cell.select("i", F.col("s").alias("a"), F.col("v").alias("x")).join(cell.select("i", F.col("s").alias("b"), F.col("v").alias("y")), "i")
    if method == "pearson":
        return _corr(pair)
    if method == "spearman":
        for v in ("x", "y"):
            w = Window.partitionBy("a", "b", v)
            order = Window.partitionBy("a", "b").orderBy(v)
            pair = pair.withColumn(f"r{v}", F.rank().over(order) + (F.count("*").over(w) - 1) / 2)
        return _corr(pair.select("a", "b", F.col("rx").alias("x"), F.col("ry").alias("y")))
    if method == "kendall":
        # tau-b, by counting over pairs of index values of one pair of subjects
        left, right = pair, pair.select("a", "b", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        both = left.join(right, ["a", "b"]).filter("i < j")
        dx, dy = F.signum(F.col("x") - F.col("x2")), F.signum(F.col("y") - F.col("y2"))
        t = both.groupBy("a", "b").agg(F.sum(dx * dy).alias("c"), F.sum(dx * dx).alias("nx"), F.sum(dy * dy).alias("ny"))
        n = pair.groupBy("a", "b").agg(F.count("*").alias("n"))
        base = F.sqrt(F.col("nx") * F.col("ny"))
        return n.join(t, ["a", "b"], "left").select("a", "b", "n", (F.col("c") / F.when(base > 0, base)).alias("r"))
    raise ValueError("method is pearson, spearman or kendall")


def _corr(pair: DataFrame) -> DataFrame:
    spread = (F.stddev_samp("x") > 0) & (F.stddev_samp("y") > 0)
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.when(spread, F.corr("x", "y")).alias("r"))


@dataclass(frozen=True)
class Decomposition:
    """components: (k, columns). weights of a row: (row - mean) · transform."""

    columns: tuple[str, ...]
    mean: np.ndarray
    components: np.ndarray
    transform: np.ndarray
    explained: np.ndarray

    def weights(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = []
        for k in range(self.transform.shape[1]):
            parts = [(q(c) - float(m)) * float(w) for c, m, w in zip(self.columns, self.mean, self.transform[:, k], strict=True)]
            out.append(sum(parts[1:], parts[0]).alias(f"c{k}"))
        return df.select(*map(q, keep), *out)


def decompose(df: DataFrame, columns: Sequence[str], algorithm: str = "pca", n_components: int | None = None, seed: int = 0, rounds: int = 300) -> Decomposition:
    """Columns into components.

    pca and fa come from the covariance of all rows. ica and nnmf are iterative: each
    round adds up sums over all rows, and only these reach the driver.
    """
    columns = list(columns)
    k = n_components or len(columns)
    if algorithm in ("pca", "fa"):
        n, mean, cross = _moments(df, columns)
        cov = cross / max(n - 1, 1)
        if algorithm == "pca":
            value, vector = np.linalg.eigh(cov)
            order = np.argsort(-value)[:k]
            parts = vector[:, order] * np.sign(vector[np.abs(vector[:, order]).argmax(0), order])
            return Decomposition(tuple(columns), mean, parts.T, parts, value[order])
        loadings, noise = _factors(cov, k, rounds)
        weighted = loadings / noise[:, None]
        back = weighted @ np.linalg.inv(np.eye(k) + loadings.T @ weighted)
        return Decomposition(tuple(columns), mean, loadings.T, back, (loadings**2).sum(0))
    if algorithm not in ("ica", "nnmf"):
        raise ValueError("algorithm is pca, ica, nnmf or fa")
    rows = materialize(df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna(), "rows")
    n, mean, cross = _moments(rows, rows.columns)
    if algorithm == "ica":
        return _ica(rows, n, mean, cross, columns, k, seed, rounds)
    if n and min(rows.agg(*[F.min(c) for c in rows.columns]).first()) < 0:
        raise ValueError("nnmf is for values of zero or more")
    return _nnmf(rows, mean, columns, k, seed, rounds)


def _sum_rows(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``sums`` over all rows, which it gets in blocks; each task hands on one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sums(np.column_stack([c.to_numpy() for c in b.columns])).ravel() for b in batches if len(b))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    return np.sum([r["s"] for r in rows.mapInArrow(run, "s array<double>").collect()], axis=0)


def _least_squares(b: np.ndarray, gram: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Rows w >= 0 of least squared error, by coordinate: b are products with the components, gram those among them."""
    w = np.zeros_like(b)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(gram)):
            if gram[j, j] > 0:
                new = np.maximum(w[:, j] + (b[:, j] - w @ gram[:, j]) / gram[j, j], 0)
                moved = max(moved, float(np.abs(new - w[:, j]).max()))
                w[:, j] = new
        if moved <= 1e-10 * max(float(w.max()), 1e-300):
            break
    return w


def _factors(cov: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood factor analysis by expectation maximisation on the covariance."""
    d = np.diag(cov).copy()
    value, vector = np.linalg.eigh(cov)
    top = np.argsort(-value)[:k]
    load = vector[:, top] * np.sqrt(np.maximum(value[top], 1e-9))
    noise = np.maximum(d - (load**2).sum(1), 1e-6 * np.maximum(d, 1e-12))
    for _ in range(rounds):
        weighted = load / noise[:, None]
        inner = np.linalg.inv(np.eye(k) + load.T @ weighted)
        beta = inner @ weighted.T
        second = np.eye(k) - beta @ load + beta @ cov @ beta.T
        new = cov @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(d - np.einsum("ij,ji->i", new, beta @ cov), 1e-9 * np.maximum(d, 1e-12) + 1e-15)
        done = np.abs(new - load).max() < 1e-10
        load = new
        if done:
            break
    return load, noise


def _ica(rows: DataFrame, n: int, mean: np.ndarray, cross: np.ndarray, columns: list[str], k: int, seed: int, rounds: int) -> Decomposition:
    """Symmetric fixed-point iteration with the log-cosh contrast, on whitened rows."""
    value, vector = np.linalg.eigh(cross / max(n - 1, 1))
    top = np.argsort(-value)[:k]
    white = vector[:, top] / np.sqrt(np.maximum(value[top], 1e-12))
    k = len(top)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):

        def sums(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) @ white
            g = np.tanh(z @ w.T)
            return np.column_stack([g.T @ z, (1 - g**2).sum(0)])

        total = _sum_rows(rows, sums).reshape(k, k + 1) / n
        u, _, v = np.linalg.svd(total[:, :k] - np.diag(total[:, k]) @ w)
        new = u @ v
        done = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max() < 1e-8
        w = new
        if done:
            break
    transform = white @ w.T
    return Decomposition(tuple(columns), mean, np.linalg.pinv(transform), transform, np.ones(k))


def _nnmf(rows: DataFrame, mean: np.ndarray, columns: list[str], k: int, seed: int, rounds: int) -> Decomposition:
    """Squared error by turns: weights of each row for given components, then components from sums over the weights."""
    d = len(columns)
    h = np.random.default_rng(seed).random((k, d)) * np.sqrt(max(mean.mean(), 1e-12) / k) + 1e-6
    errors: list[float] = []
    for _ in range(rounds):

        def sums(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            w = _least_squares(x @ h.T, h @ h.T)
            return np.column_stack([w.T @ x, w.T @ w])

        total = _sum_rows(rows, sums).reshape(k, d + k)
        used = np.diag(total[:, d:]) > 0
        new = np.where(used[:, None], _least_squares(total[:, :d].T, total[:, d:]).T, h)
        # the squared error less that of the rows themselves
        errors.append(np.sum((new @ new.T) * total[:, d:]) - 2 * np.sum(new * total[:, :d]))
        h = new
        if len(errors) > 1 and errors[-2] - errors[-1] <= 1e-6 * abs(errors[0]):
            break
    return Decomposition(tuple(columns), np.zeros(d), h, np.linalg.pinv(h), (h**2).sum(1))


def with_folds(df: DataFrame, k: int, order_by: Sequence[str], stratify: str | None = None) -> DataFrame:
    """Add fold 0 … k-1: contiguous blocks in order, the first ones longer by one; or so within each class."""
    by = [q(stratify)] if stratify else []
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*map(q, order_by))) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    small, extra = F.floor(n / k), n % k
    head = extra * (small + 1)
    fold = F.when(place < head, F.floor(place / (small + 1))).otherwise(extra + F.floor((place - head) / F.greatest(small, F.lit(1))))
    return df.withColumn("fold", F.least(fold, F.lit(k - 1)).cast("int"))


def cross_val_regress(df: DataFrame, X: Sequence[str], y: str, k: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """fold, n, r2 of least squares fitted on the other folds. Moments are taken once, by fold."""
    folded = with_folds(df.select(*map(q, dict.fromkeys([*X, y, *order_by]))).dropna(subset=[*X, y]), k, order_by)
    names = [*X, y]
    p = len(X)
    cells = [F.sum(q(a) * q(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    rows = folded.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(q(c)).alias(f"s{i}") for i, c in enumerate(names)], *cells).orderBy("fold").collect()

    def gram(r) -> np.ndarray:  # noqa: ANN001
        g = np.zeros((p + 2, p + 2))
        g[0, 0] = r["n"]
        for i in range(p + 1):
            g[0, i + 1] = g[i + 1, 0] = r[f"s{i}"]
            for j in range(i, p + 1):
                g[i + 1, j + 1] = g[j + 1, i + 1] = r[f"p{i}_{j}"]
        return g

    parts = [gram(r) for r in rows]
    total = sum(parts)
    out = []
    for r, g in zip(rows, parts, strict=True):
        rest = total - g
        b = np.linalg.pinv(rest[: p + 1, : p + 1]) @ rest[: p + 1, p + 1]
        rss = g[p + 1, p + 1] - 2 * b @ g[: p + 1, p + 1] + b @ g[: p + 1, : p + 1] @ b
        tss = g[p + 1, p + 1] - g[0, p + 1] ** 2 / g[0, 0]
        out.append((r["fold"], r["n"], float(1 - rss / tss) if tss > 0 else None))
    return df.sparkSession.createDataFrame(out, "fold int, n long, r2 double")


def cross_val_fit(df: DataFrame, estimator, evaluator, k: int = 5, order_by: Sequence[str] = (), stratify: str | None = None):  # noqa: ANN001, ANN201
    """(scores by fold, model of all rows) of any Spark ML estimator or pipeline; folds are contiguous or stratified."""
    folded = with_folds(df, k, order_by, stratify)
    scores = [evaluator.evaluate(estimator.fit(folded.filter(F.col("fold") != f)).transform(folded.filter(F.col("fold") == f))) for f in range(k)]
    return scores, estimator.fit(df)
