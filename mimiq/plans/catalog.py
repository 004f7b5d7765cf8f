"""One query per operator on the supplied tables, with SQL that gives the same rows.

events stand in for a frame series (session: event_type or user_id), lineitem for a wide numeric table,
embeddings for identities, labels and documents for truth and score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import gaze as G
from ..functions import rotations as R
from ..nulls import nan_to_null
from ..operators import geometry, identity, metrics, signal, stats
from ..operators.frame import FrameTable, binarize, rows_per_bin
from ..schema import FrameSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def events(spark: SparkSession, sf_dir: str, session: str | None = "event_type", freq: float | None = 1.0) -> FrameTable:
    schema = FrameSchema(groups={"aus": ("value",)}, session=session, order_by=("ts", "event_id"), sampling_freq=freq)
    return FrameTable(table(spark, sf_dir, "events"), schema)


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lines(spark: SparkSession, sf_dir: str, session: str | None = "l_returnflag") -> FrameTable:
    df = table(spark, sf_dir, "lineitem").withColumns({c: F.col(c).cast("double") for c in LINE})
    return FrameTable(df, FrameSchema(groups={"aus": LINE}, session=session))


KINDS = {"mean": "avg({c})", "sem": "stddev_samp({c}) / sqrt(count({c}))", "std": "stddev_samp({c})", "max": "max({c})", "min": "min({c})"}


def _summary_sql(frm: str, columns: tuple[str, ...], kinds: list[str], by: str = "", cast: str = "::DOUBLE", head: str = "") -> str:
    cells = [KINDS[k].format(c=f"{c}{cast}") + f" AS {k}_{c}" for k in kinds for c in columns]
    return f"SELECT {head}{by + ', ' if by and not head else ''}{', '.join(cells)} FROM {frm}{' GROUP BY ' + by if by else ''}"


query("session_summary", _summary_sql("events", ("value",), list(KINDS), "event_type"))(lambda s, d: events(s, d).summary())
for _k in KINDS:
    query(f"session_{_k}", _summary_sql("lineitem", LINE, [_k], "l_returnflag"))(lambda s, d, k=_k: lines(s, d).summary([k]))
query("global_summary", _summary_sql("lineitem", LINE, list(KINDS)))(lambda s, d: lines(s, d).summary(ignore_sessions=True))


@query("update_sessions_map", "SELECT CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'view' THEN 'see' END AS session, avg(value) AS mean_value FROM events GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).update_sessions({"click": "act", "purchase": "act", "view": "see"}).summary(["mean"])


@query("append_union", "SELECT event_type, count(*) AS n, sum(value) AS total FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 50) GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    t = events(s, d)
    more = FrameTable(t.df.filter("value > 50"), t.schema)
    return t.append(more).df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("append_columns", "SELECT event_id, value, value * 2 AS doubled FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    t = FrameTable(table(s, d, "events").select("event_id", "value"), FrameSchema(groups={"aus": ("value",)}, order_by=("event_id",)))
    other = FrameTable(t.df.select("event_id", (F.col("value") * 2).alias("doubled")), FrameSchema(groups={"aus": ("doubled",)}, order_by=("event_id",)))
    return t.append(other, axis=1).df


@query("group_projection", "SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem WHERE l_quantity > 45")
def _(s: SparkSession, d: str) -> DataFrame:
    t = lines(s, d)
    return FrameTable(t.df.filter("l_quantity > 45"), t.schema).aus


_BASE = {"median": "median(value) OVER w", "mean": "avg(value) OVER w", "begin": "first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)"}


def _baseline_sql(base: str, change: str = "value - b") -> str:
    return f"SELECT event_id, user_id, {change} AS value FROM (SELECT event_id, user_id, value, {_BASE[base]} AS b FROM events WINDOW w AS (PARTITION BY user_id))"


def _baseline(s: SparkSession, d: str, base: str, how: str | None = None) -> DataFrame:
    return events(s, d, "user_id").baseline(base, how).df.select("event_id", "user_id", "value")


for _k in _BASE:
    query(f"baseline_{_k}", _baseline_sql(_k))(lambda s, d, k=_k: _baseline(s, d, k))
query("baseline_pct", _baseline_sql("mean", "100 * (value - b) / b"))(lambda s, d: _baseline(s, d, "mean", "pct"))
query("baseline_db", _baseline_sql("median", "CASE WHEN value > b THEN 10 * log10(value - b) / b WHEN value = b THEN '-inf'::DOUBLE END"))(lambda s, d: _baseline(s, d, "median", "db"))


@query(
    "rectification",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DOUBLE AS a, l_quantity::DOUBLE AS b FROM lineitem),
    m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN a > ma + 1.5 * sa OR a < ma - 1.5 * sa OR b > mb + 1.5 * sb OR b < mb - 1.5 * sb THEN NULL ELSE a END AS "FaceRectX",
      CASE WHEN a > ma + 1.5 * sa OR a < ma - 1.5 * sa OR b > mb + 1.5 * sb OR b < mb - 1.5 * sb THEN NULL ELSE b END AS "FaceRectY" FROM x, m""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    df = lines(s, d).df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("FaceRectX"), F.col("l_quantity").alias("FaceRectY"))
    return FrameTable(df, FrameSchema()).rectification(1.5, columns=("FaceRectX", "FaceRectY")).df


_BINS = "SELECT event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // {k} AS BIGINT) AS bin, value FROM events"
for _m in ("mean", "median"):
    query(f"downsample_{_m}", f"SELECT event_type, bin, {'avg' if _m == 'mean' else 'median'}(value) AS value FROM ({_BINS.format(k=10)}) GROUP BY event_type, bin")(lambda s, d, m=_m: events(s, d).downsample(10, method=m).df)
query("downsample_hz", f"SELECT event_type, bin, avg(value) AS value FROM ({_BINS.format(k=rows_per_bin(7, 'hz', 30))}) GROUP BY event_type, bin")(lambda s, d: events(s, d, freq=30.0).downsample(7, "hz").df)

_CELL = "WITH c AS (SELECT CAST(ts AS DATE) AS i, event_type AS s, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT a.s AS a, b.s AS b, a.i, a.v AS x, b.v AS y FROM c a JOIN c b ON a.i = b.i)"


def _isc(s: SparkSession, d: str, method: str) -> DataFrame:
    return stats.isc(table(s, d, "events").withColumn("day", F.to_date("ts")), "value", "day", "event_type", method)


query("isc_pearson", f"{_CELL} SELECT a, b, count(*) AS n, corr(x, y) AS r FROM p GROUP BY a, b")(lambda s, d: _isc(s, d, "pearson"))
query(
    "isc_spearman",
    f"""{_CELL}, r AS (SELECT a, b,
      rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x,
      rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y FROM p)
    SELECT a, b, count(*) AS n, corr(x, y) AS r FROM r GROUP BY a, b""",
)(lambda s, d: _isc(s, d, "spearman"))
query(
    "isc_kendall",
    f"""{_CELL}, k AS (SELECT p.a, p.b, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS c, sum(abs(sign(p.x - q.x))) AS nx, sum(abs(sign(p.y - q.y))) AS ny
      FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.i < q.i GROUP BY p.a, p.b),
    n AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b)
    SELECT a, b, n, c / nullif(sqrt(nx * ny), 0) AS r FROM n LEFT JOIN k USING (a, b)""",
)(lambda s, d: _isc(s, d, "kendall"))

query(
    "ols_single",
    """WITH m AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS c, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx
      FROM (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem)),
    e AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM m)
    SELECT 'l_quantity' AS predictor, 'l_extendedprice' AS outcome, round(k, 4) AS b, round(sqrt(s2 / sxx), 4) AS se, n - 2 AS df FROM e
    UNION ALL SELECT 'intercept', 'l_extendedprice', round(c, 4), round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4), n - 2 FROM e""",
)(lambda s, d: stats.regress(lines(s, d).df, ["l_quantity"], ["l_extendedprice"]).table(s).select("predictor", "outcome", F.round("b", 4).alias("b"), F.round("se", 4).alias("se"), "df"))
query(
    "ols_multi",
    """WITH x AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem),
    m AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
    k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ka, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM m)
    SELECT 'l_quantity' AS predictor, round(ka, 3) AS b FROM k UNION ALL SELECT 'l_discount', round(kb, 3) FROM k UNION ALL SELECT 'intercept', round(my - ka * ma - kb * mb, 3) FROM k""",
)(lambda s, d: stats.regress(lines(s, d).df, ["l_quantity", "l_discount"], ["l_extendedprice"]).table(s).select("predictor", F.round("b", 3).alias("b")))
query(
    "regress_residuals",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem),
    m AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM x)
    SELECT l_orderkey, l_linenumber, round(y - (k * x + c), 4) AS residual FROM x, m""",
)(lambda s, d: stats.regress(lines(s, d).df, ["l_quantity"], ["l_extendedprice"]).residuals(lines(s, d).df).select("l_orderkey", "l_linenumber", F.round("residual_l_extendedprice", 4).alias("residual")))
query("ttest_1samp", "SELECT 'value' AS \"column\", count(value) AS n, (avg(value) - 40) / (stddev_samp(value) / sqrt(count(value))) AS t FROM events")(lambda s, d: stats.ttest_1samp(table(s, d, "events"), ["value"], 40).select("column", "n", "t"))
query(
    "ttest_ind",
    """WITH m AS (SELECT count(value) FILTER (WHERE g = 1) AS n0, avg(value) FILTER (WHERE g = 1) AS m0, var_samp(value) FILTER (WHERE g = 1) AS v0,
      count(value) FILTER (WHERE g = 0) AS n1, avg(value) FILTER (WHERE g = 0) AS m1, var_samp(value) FILTER (WHERE g = 0) AS v1
      FROM (SELECT value, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 END AS g FROM events))
    SELECT (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t, n0 + n1 - 2 AS df FROM m""",
)(lambda s, d: stats.ttest_ind(table(s, d, "events"), "value", "event_type", ["click", "purchase"]).select("t", "df"))
query("ttest_p")(lambda s, d: stats.ttest_1samp(lines(s, d).df, LINE, 0.05))
_ROWS = "SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events"
query(
    "detrend",
    f"WITH r AS ({_ROWS}), k AS (SELECT event_type, regr_slope(value, i) AS k, regr_intercept(value, i) AS c FROM r GROUP BY event_type) SELECT event_id, round(value - (k * i + c), 6) AS value FROM r JOIN k USING (event_type)",
)(lambda s, d: signal.detrend(events(s, d), ["value"]).df.select("event_id", F.round("value", 6).alias("value")))
query("standardize", "SELECT event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM events WINDOW w AS (PARTITION BY event_type)")(lambda s, d: signal.standardize(events(s, d), ["value"]).df.select("event_id", "value"))
query("clean_filter")(lambda s, d: signal.clean(events(s, d), low_pass=0.2, high_pass=0.02).df)
query("upsample_fft")(lambda s, d: signal.upsample(events(s, d), 2.0).df)
query("wavelet_power")(lambda s, d: signal.multi_wavelet(events(s, d), bank=4, mode="power").df)
query("wavelet_complex")(lambda s, d: signal.wavelets(events(s, d), [0.1], mode="complex").df)
query("boft")(lambda s, d: signal.boft(events(s, d), bank=4))

_PAIRS = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


query("distance_euclid", f"{_PAIRS} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) ** 2))), 6) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id")(
    lambda s, d: identity.pair_distances(vectors(s, d)).select("a", "b", F.round("distance", 6).alias("distance"))
)
query(
    "cosine_pairs",
    f"{_PAIRS} SELECT a.vec_id AS id, round(list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-12) * (sqrt(list_dot_product(b.e, b.e)) + 1e-12)), 9) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
)(lambda s, d: vectors(s, d).select("id", "v").join(vectors(s, d).select((F.col("id") - 1).alias("id"), F.col("v").alias("w")), "id").select("id", F.round(identity.cosine("v", "w"), 9).alias("similarity")))
query(
    "similar_pairs",
    f"{_PAIRS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) > 0.4",
)(lambda s, d: identity.similar_pairs(vectors(s, d), 0.4).select("a", "b", F.round("similarity", 9).alias("similarity")))
query(
    "rank_k",
    f"""{_PAIRS}, n AS (SELECT p.vec_id AS probe, p.label = g.label AS hit, row_number() OVER (PARTITION BY p.vec_id
      ORDER BY list_dot_product(p.e, g.e) / sqrt(list_dot_product(p.e, p.e) * list_dot_product(g.e, g.e)) DESC, g.vec_id) AS r FROM v p JOIN v g ON p.vec_id % 2 = 1 AND g.vec_id % 2 = 0),
    h AS (SELECT probe, bool_or(hit AND r <= 1) AS h1, bool_or(hit AND r <= 5) AS h5, bool_or(hit AND r <= 10) AS h10, bool_or(hit AND r <= 20) AS h20 FROM n GROUP BY probe)
    SELECT avg(h1::INT) AS rank_1, avg(h5::INT) AS rank_5, avg(h10::INT) AS rank_10, avg(h20::INT) AS rank_20, count(*) AS n_probes FROM h""",
)(lambda s, d: metrics.rank_k(identity.rank_k_table(vectors(s, d).filter("id % 2 = 0"), vectors(s, d).filter("id % 2 = 1"))))
query(
    "identity_connected",
    f"""{_PAIRS}, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) > 0.4),
    g AS (WITH RECURSIVE r(id, root) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id) SELECT id, min(root) AS first FROM r GROUP BY id)
    SELECT id, 'Person_' || dense_rank() OVER (ORDER BY first) AS "Identity" FROM g""",
)(lambda s, d: identity.cluster_identities(vectors(s, d), 0.4, "connected"))
query("identity_gallery")(lambda s, d: identity.cluster_identities(vectors(s, d), 0.4, "gallery"))
query("identity_hdbscan")(lambda s, d: identity.cluster_identities(vectors(s, d), 0.4, "hdbscan"))

_TOP = "SELECT l_orderkey, l_extendedprice::DOUBLE AS l_extendedprice, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1"


def _top(s: SparkSession, d: str) -> DataFrame:
    return metrics.top_face(lines(s, d).df, "l_orderkey", "l_extendedprice", ("l_partkey", "l_suppkey", "l_quantity")).select("l_orderkey", "l_extendedprice", "l_partkey")


query("top_face", _TOP)(_top)
query("left_reindex", f"SELECT i AS l_orderkey, l_extendedprice, l_partkey FROM range(5000) t(i) LEFT JOIN ({_TOP}) ON l_orderkey = i")(lambda s, d: metrics.align_to_frames(_top(s, d), 5000, "l_orderkey"))
_XY = "(SELECT l_quantity::DOUBLE AS x, l_tax::DOUBLE * 500 AS y, l_returnflag AS g FROM lineitem)"
xy = lambda s, d: lines(s, d).df.select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 500).alias("y"), F.col("l_returnflag").alias("g"))
query("au_f1", "SELECT CASE WHEN 2 * tp + o = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + o)::DOUBLE END AS f1 FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> toxic) AS o FROM labels)")(
    lambda s, d: table(s, d, "labels").agg(metrics.f1_of(F.col("quality"), F.col("toxic")).alias("f1"))
)
query("au_icc", f"SELECT g, (msr - mse) / (msr + mse) AS icc FROM (SELECT g, 2 * var_samp((x + y) / 2) AS msr, var_samp(x - y) / 2 AS mse FROM {_XY} GROUP BY g)")(lambda s, d: xy(s, d).groupBy("g").agg(metrics.icc_of(F.col("x"), F.col("y")).alias("icc")))
query("ccc", f"SELECT g, 2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) ** 2) AS ccc FROM {_XY} GROUP BY g")(lambda s, d: xy(s, d).groupBy("g").agg(metrics.ccc_of(F.col("x"), F.col("y")).alias("ccc")))
query("accuracy", "SELECT avg((quality = toxic)::INT) AS accuracy FROM labels")(lambda s, d: table(s, d, "labels").agg(metrics.accuracy_of(F.col("quality"), F.col("toxic")).alias("accuracy")))
query(
    "macro_f1",
    """WITH p AS (SELECT l_linenumber AS t, 1 + l_partkey % 7 AS p FROM lineitem), c AS (SELECT t AS c FROM p UNION SELECT p FROM p),
    f AS (SELECT c, (SELECT count(*) FROM p WHERE t = c AND p = c) AS tp, (SELECT count(*) FROM p WHERE t = c) + (SELECT count(*) FROM p WHERE p = c) AS n FROM c)
    SELECT avg(2.0 * tp / n) AS f1_macro FROM f""",
)(lambda s, d: metrics.f1_macro(table(s, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("t"), (1 + F.col("l_partkey") % 7).cast("long").alias("p")), "t", "p"))
query(
    "summarize_aus",
    """WITH u AS (SELECT 'AU01' AS au, floor(l_quantity::DOUBLE / 10) AS t, l_discount::DOUBLE * 10 AS p FROM lineitem UNION ALL SELECT 'AU02', floor(l_quantity::DOUBLE / 20), l_tax::DOUBLE * 12 FROM lineitem)
    SELECT au, count(*) AS n, 2.0 * count(*) FILTER (WHERE t >= 2 AND p >= 0.5) / (2 * count(*) FILTER (WHERE t >= 2 AND p >= 0.5) + count(*) FILTER (WHERE (t >= 2) <> (p >= 0.5))) AS f1,
      round((2 * var_samp((t + p) / 2) - var_samp(t - p) / 2) / (2 * var_samp((t + p) / 2) + var_samp(t - p) / 2), 9) AS icc FROM u GROUP BY au""",
)(
    lambda s, d: metrics.summarize_aus(
        metrics.unpivot_pairs(lines(s, d).df.select(F.floor(F.col("l_quantity") / 10).alias("t1"), F.floor(F.col("l_quantity") / 20).alias("t2"), (F.col("l_discount") * 10).alias("p1"), (F.col("l_tax") * 12).alias("p2")), ["t1", "t2"], ["p1", "p2"], ["AU01", "AU02"])
    ).select("au", "n", "f1", F.round("icc", 9).alias("icc"))
)
_VER = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), r AS (SELECT round(list_dot_product(a.e, b.e), 9) AS s, (a.label = b.label)::INT AS y, a.vec_id % 10 AS f FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def _verification(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    after = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"), F.col("label").alias("m"))
    return v.join(after, "id").select(F.round(identity.dot("v", "w"), 9).alias("similarity"), (F.col("label") == F.col("m")).cast("int").alias("same_id"), (F.col("id") % 10).alias("fold"))


query(
    "verification_10fold",
    f"""{_VER}, e AS (SELECT min(s) AS lo, max(s) AS hi FROM r), t AS (SELECT i, lo + i * ((hi - lo) / 399) AS t FROM e, range(400) g(i)),
    c AS (SELECT f, i, any_value(t) AS t, count(*) FILTER (WHERE (s >= t) = (y = 1)) AS ok, count(*) AS n FROM r, t GROUP BY f, i),
    a AS (SELECT *, (sum(ok) OVER (PARTITION BY i) - ok)::DOUBLE / (sum(n) OVER (PARTITION BY i) - n) AS acc FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY acc DESC, i) AS k FROM a)
    SELECT round(avg(ok::DOUBLE / n), 9) AS accuracy_mean, round(stddev_pop(ok::DOUBLE / n), 9) AS accuracy_std, round(avg(t), 9) AS threshold_mean, count(*) AS n_folds FROM b WHERE k = 1""",
)(lambda s, d: metrics.verification_10fold(_verification(s, d)).select(*[F.round(c, 9).alias(c) for c in ("accuracy_mean", "accuracy_std", "threshold_mean")], "n_folds"))
query(
    "auc_rank",
    """WITH r AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT sum(k) FILTER (WHERE y = 1) AS r, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM r) SELECT (r - p * (p + 1) / 2.0) / (p * n) AS auc FROM s""",
)(lambda s, d: metrics.rank_auc(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars"))
_ANG = "(SELECT event_id, (event_id % 200 - 100) / 100.0::DOUBLE AS p, (event_id % 300 - 150) / 100.0::DOUBLE AS y, value / 1000 AS q, value / 500 - 0.5 AS z FROM events)"
angles = lambda s, d: table(s, d, "events").select("event_id", ((F.col("event_id") % 200 - 100) / 100.0).alias("p"), ((F.col("event_id") % 300 - 150) / 100.0).alias("y"), (F.col("value") / 1000).alias("q"), (F.col("value") / 500 - 0.5).alias("z"))
query("gaze_vector", f"SELECT event_id, round(-cos(p) * sin(y), 9) AS x, round(-sin(p), 9) AS y, round(-cos(p) * cos(y), 9) AS z FROM {_ANG}")(
    lambda s, d: angles(s, d).select("event_id", G.gaze_unit_vector(F.col("p"), F.col("y")).alias("g")).select("event_id", *[F.round(f"g.{c}", 9).alias(c) for c in "xyz"])
)
query("gaze_angle", f"SELECT event_id, round(degrees(acos(greatest(-1.0, least(1.0, cos(p) * sin(y) * cos(q) * sin(z) + sin(p) * sin(q) + cos(p) * cos(y) * cos(q) * cos(z))))), 5) AS angle FROM {_ANG}")(
    lambda s, d: angles(s, d).select("event_id", F.round(G.angular_error_degrees(F.col("p"), F.col("y"), F.col("q"), F.col("z")), 5).alias("angle"))
)
query("gaze_pitch_yaw", f"SELECT event_id, round(atan2(y, sqrt(p * p + q * q)), 9) AS pitch, round(atan2(-p, q), 9) AS yaw FROM {_ANG}")(
    lambda s, d: angles(s, d).select("event_id", G.vector_to_pitch_yaw(F.col("p"), F.col("y"), F.col("q")).alias("g")).select("event_id", F.round("g.pitch", 9).alias("pitch"), F.round("g.yaw", 9).alias("yaw"))
)
query("pupil_offsets", f"SELECT event_id, round(15 * sin(y), 9) AS left_x, round(15 * sin(p), 9) AS left_y FROM {_ANG}")(
    lambda s, d: angles(s, d).select("event_id", G.pupil_offsets(F.col("p"), F.col("y")).alias("g")).select("event_id", F.round("g.left_x", 9).alias("left_x"), F.round("g.left_y", 9).alias("left_y"))
)
_BOX = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS x, l_linenumber * 3.0::DOUBLE AS y, 10 + l_discount::DOUBLE * 100 AS w, 8 + l_tax::DOUBLE * 100 AS h, (l_partkey % 40)::DOUBLE AS x2, (l_suppkey % 20)::DOUBLE AS y2 FROM lineitem)"
_KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def box(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return lines(s, d).df.select(*_KEY, c("l_quantity").alias("x"), (c("l_linenumber") * 3.0).alias("y"), (10 + c("l_discount") * 100).alias("w"), (8 + c("l_tax") * 100).alias("h"), (c("l_partkey") % 40).cast("double").alias("x2"), (c("l_suppkey") % 20).cast("double").alias("y2"))


_key = ", ".join(_KEY)
query("iou", f"SELECT {_key}, round(i / (w * h + 400 - i), 9) AS iou FROM (SELECT *, greatest(0.0, least(x + w, x2 + 20) - greatest(x, x2)) * greatest(0.0, least(y + h, y2 + 20) - greatest(y, y2)) AS i FROM {_BOX})")(
    lambda s, d: box(s, d).select(*_KEY, F.round(B.iou_xywh([F.col(c) for c in "xywh"], [F.col("x2"), F.col("y2"), F.lit(20.0), F.lit(20.0)]), 9).alias("iou"))
)
_edges = lambda s, d: box(s, d).withColumn("a", B.xyxy(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))).withColumn("b", B.xyxy(F.col("x2"), F.col("y2"), F.col("x2") + 20, F.col("y2") + 20))
_spread = lambda df, c: df.select(*_KEY, *[F.round(f"{c}.{e}", 6).alias(e) for e in B.EDGES])
query("box_intersect", f"SELECT {_key}, greatest(x, x2) AS left, greatest(y, y2) AS top, round(least(x + w, x2 + 20), 6) AS right, round(least(y + h, y2 + 20), 6) AS bottom FROM {_BOX}")(lambda s, d: _spread(_edges(s, d).withColumn("c", B.intersect(F.col("a"), F.col("b"))), "c"))
query("box_hull", f"SELECT {_key}, least(x, x2) AS left, least(y, y2) AS top, round(greatest(x + w, x2 + 20), 6) AS right, round(greatest(y + h, y2 + 20), 6) AS bottom FROM {_BOX}")(lambda s, d: _spread(_edges(s, d).withColumn("c", B.hull(F.col("a"), F.col("b"))), "c"))
query(
    "box_square",
    f"SELECT {_key}, round(x + w * 0.5 - m * 0.5, 6) AS left, round(y + h * 0.5 - m * 0.5, 6) AS top, round(x + w * 0.5 + m * 0.5, 6) AS right, round(y + h * 0.5 + m * 0.5, 6) AS bottom FROM (SELECT *, greatest(round(w, 9), round(h, 9)) AS m FROM {_BOX})",
)(lambda s, d: _spread(_edges(s, d).withColumn("c", B.square(F.col("a"))), "c"))
query("box_clip", f"SELECT {_key}, greatest(x, 5) AS left, greatest(y, 2) AS top, round(least(x + w, 40), 6) AS right, round(least(y + h, 18), 6) AS bottom FROM {_BOX}")(lambda s, d: _spread(_edges(s, d).withColumn("c", B.clip(F.col("a"), 5.0, 2.0, 40.0, 18.0)), "c"))
query("box_overlap", f"SELECT {_key}, round(greatest(0.0, least(x + w, x2 + 20) - greatest(x, x2)) * greatest(0.0, least(y + h, y2 + 20) - greatest(y, y2)) / (w * h), 9) AS overlap FROM {_BOX}")(lambda s, d: _edges(s, d).select(*_KEY, F.round(B.overlap(F.col("a"), F.col("b")), 9).alias("overlap")))
query("pad_inverse", f"SELECT {_key}, round((x - 4) / 0.5, 9) AS x, round((y - 2) / 0.5, 9) AS y, round(w / 0.5, 9) AS w FROM {_BOX}")(
    lambda s, d: B.invert_padding_columns(box(s, d).withColumns({"pad_left": F.lit(4), "pad_top": F.lit(2), "scale": F.lit(0.5)}), ["x"], ["y"], ["w"]).select(*_KEY, *[F.round(c, 9).alias(c) for c in "xyw"])
)
query(
    "rescale_terms",
    """SELECT p_partkey, CAST(nh AS BIGINT) AS height, CAST(nw AS BIGINT) AS width, CAST(floor((256 - nw) / 2) AS BIGINT) AS left, CAST(256 - nw - floor((256 - nw) / 2) AS BIGINT) AS right, round(sc, 9) AS scale FROM (
      SELECT *, floor(h * sc) AS nh, floor(w * sc) AS nw FROM (SELECT *, least(256.0::DOUBLE / h, 256.0::DOUBLE / w) AS sc FROM (SELECT p_partkey, 100 + p_size * 7 AS h, 90 + p_partkey % 300 AS w FROM part)))""",
)(
    lambda s, d: (
        table(s, d, "part").select("p_partkey", B.rescale_terms(100 + F.col("p_size") * 7, 90 + F.col("p_partkey") % 300, 256).alias("r")).select("p_partkey", "r.height", "r.width", "r.left", "r.right", F.round("r.scale", 9).alias("scale"))
    )
)
query("decode_boxes", f"SELECT {_key}, round(x + 0.1 * w * 0.5 - 20 * exp(0.2 * h / 100) / 2, 6) AS left, round(x + 0.1 * w * 0.5 + 20 * exp(0.2 * h / 100) / 2, 6) AS right FROM {_BOX}")(
    lambda s, d: box(s, d).select(*_KEY, B.decode_box([F.lit(0.5) * F.col("w") / 20, F.lit(0.0), F.col("h") / 100, F.lit(0.0)], [F.col("x"), F.col("y"), F.lit(20.0), F.lit(20.0)]).alias("b")).select(*_KEY, F.round("b.left", 6).alias("left"), F.round("b.right", 6).alias("right"))
)
query("priors")(lambda s, d: B.priors(s, 128, 96))
query("approx_time", "SELECT event_id, lpad(CAST(CAST(floor(least(event_id, 5000) / 30.0 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(least(event_id, 5000) / 30.0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS t FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", B.approx_time(F.col("event_id"), 30.0, 5000).alias("t"))
)
query("evidence_probability", "SELECT event_id, round(1 / (1 + pow(10, -(value - 50) / 50)), 9) AS p FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.round(B.evidence_to_probability((F.col("value") - 50) / 50), 9).alias("p")))
query("binarize", "SELECT event_id, (value >= 50)::INT AS b FROM events")(lambda s, d: table(s, d, "events").select("event_id", binarize(F.col("value"), 50).alias("b")))
query(
    "quaternion",
    f"SELECT event_id, round(cos(t / 2), 7) AS w, round(p / t * sin(t / 2), 7) AS x, round(y / t * sin(t / 2), 7) AS y, round(q / t * sin(t / 2), 7) AS z FROM (SELECT *, sqrt(p * p + y * y + q * q) AS t FROM {_ANG}) WHERE t < 2",
)(
    lambda s, d: (
        angles(s, d)
        .filter("sqrt(p * p + y * y + q * q) < 2")
        .select("event_id", R.quaternion_of_matrix(R.matrix_of_rotvec(F.col("p"), F.col("y"), F.col("q"))).alias("r"))
        .select("event_id", *[(F.round(f"r.{c}", 7) + 0.0).alias(c) for c in "wxyz"])
    )
)
query("axis_angle", f"SELECT event_id, round(p, 6) AS x, round(y, 6) AS y, round(q, 6) AS z FROM {_ANG}")(
    lambda s, d: angles(s, d).select("event_id", R.rotvec_of_matrix(R.matrix_of_rotvec(F.col("p"), F.col("y"), F.col("q"))).alias("r")).select("event_id", *[(F.round(f"r.{c}", 6) + 0.0).alias(c) for c in "xyz"])
)
query("euler", f"SELECT event_id, round(p, 6) AS roll FROM {_ANG}")(lambda s, d: angles(s, d).select("event_id", (F.round(R.euler_of_rotvec(F.col("p"), F.lit(0.0), F.lit(0.0))["roll"], 6) + 0.0).alias("roll")))
query("pose_degrees", f"SELECT event_id, round(-degrees(p), 5) AS pitch FROM {_ANG}")(lambda s, d: angles(s, d).select("event_id", (F.round(R.pose_degrees_of_rotvec(F.col("p"), F.lit(0.0), F.lit(0.0))["pitch"], 5) + 0.0).alias("pitch")))


@query("nms")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = box(s, d).select("l_orderkey", F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"), (F.col("l_partkey") % 1000 / 1000).alias("score"), "l_linenumber", "l_partkey")
    return geometry.nms(rows, 0.3, ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("smooth_boxes")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_id", F.col("value").alias("left"), (F.col("value") * 2).alias("top"), (F.col("value") + 80).alias("right"), (F.col("value") * 2 + 80).alias("bottom"))
    return signal.smooth_box_table(e, 0.4, "user_id", "event_id")


query("pca")(lambda s, d: stats.decompose(lines(s, d).df, LINE, "pca", 2).weights(lines(s, d).df, ("l_orderkey", "l_linenumber")))
query("factor_analysis")(lambda s, d: stats.decompose(lines(s, d).df, LINE, "fa", 2).weights(lines(s, d).df, ("l_orderkey", "l_linenumber")))
query("ica")(lambda s, d: stats.decompose(lines(s, d).df, LINE, "ica", 2).weights(lines(s, d).df, ("l_orderkey", "l_linenumber")))
query("nnmf")(lambda s, d: stats.decompose(lines(s, d).df, LINE, "nnmf", 2).weights(lines(s, d).df, ("l_orderkey", "l_linenumber")))
query("cross_val")(lambda s, d: stats.cross_val_regress(lines(s, d).df, ["l_quantity", "l_discount"], "l_extendedprice", 5, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
query("contiguous_folds", "SELECT event_id, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)")(
    lambda s, d: stats.with_folds(table(s, d, "events"), 5, ("ts", "event_id"), "event_type").select("event_id", "fold")
)
query("ease_in_out")(lambda s, d: signal.ease_in_out(s, [0.0, 1.0], [1.0, 3.0], 12, 3))
query("subset_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")
)
query("stratified_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761) % 1000003, event_id) AS r FROM events) WHERE r <= 20")(
    lambda s, d: table(s, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy((F.col("event_id") * 2654435761) % 1000003, "event_id"))).filter("r <= 20").select("event_type", "event_id")
)
query("flatten_props", "SELECT event_id, key, props ->> ('$.' || key) AS value_text FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")(
    lambda s, d: table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value_text"))
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
