"""Approximate nearest neighbours by additive quantisation.

A vector is stored as one entry of each of several full-dimensional
codebooks, whose sum approximates it, found by beam search over residuals, with the
squared norm of that sum. A query's inner products with all entries make a
lookup table; a candidate's approximate distance is its stored norm less twice
a sum of table entries. The nearest by that measure are ranked again exactly.

Equal vectors are one candidate, so copies neither take each other's places nor
meet in one task. Queries and codes meet in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Bounded sample that the codebooks are fitted on; every row is indexed.
SAMPLE = 8192
ENTRIES, BEAM = 256, 3


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector, in doubles, is whole, finite, not zero, and of the most frequent length."""
    v = F.col(vector_col)
    rows = table.filter(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (size["d"] if size else 0))


def fit_codebooks(sample: np.ndarray, books: int = 8, entries: int = ENTRIES, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """(books, entries, dimensions): k-means of what earlier codebooks leave."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32).copy()
    out = np.zeros((books, entries, sample.shape[1]), np.float32)
    for m in range(books):
        centre = left[rng.choice(len(left), entries, replace=len(left) < entries)].copy()
        for _ in range(rounds):
            near = (np.square(centre).sum(1) - 2 * left @ centre.T).argmin(1)
            total = np.zeros_like(centre)
            np.add.at(total, near, left)
            count = np.bincount(near, minlength=entries)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        out[m] = centre
        left -= centre[(np.square(centre).sum(1) - 2 * left @ centre.T).argmin(1)]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and squared norms of the sums they stand for."""
    m, entries, d = books.shape
    norms = np.square(books).sum(2)
    codes = np.zeros((len(x), m), np.uint8)
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024].astype(np.float32)
        n = len(part)
        left, cost, path = part[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        for k in range(m):
            new = cost[:, :, None] + norms[k] - 2 * (left @ books[k].T)
            flat = new.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(flat, best, 1)
            best = np.take_along_axis(best, np.argsort(cost, axis=1, kind="stable"), 1)
            cost = np.take_along_axis(flat, best, 1)
            who, entry = best // entries, best % entries
            rows = np.arange(n)[:, None]
            left = left[rows, who] - books[k][entry]
            path = np.concatenate([path[rows, who], entry[:, :, None].astype(np.uint8)], axis=2)
        codes[a : a + n] = path[:, 0]
    sums = sum(books[k][codes[:, k]] for k in range(m)) if len(x) else np.zeros((0, d), np.float32)
    return codes, np.square(sums).sum(1)


def approximate(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the ``keep`` candidates of least approximate distance: indices, values."""
    table = np.einsum("qd,med->meq", queries.astype(np.float32), books, optimize=True)
    best_i, best_v = None, None
    for a in range(0, len(codes), 8192):
        part = codes[a : a + 8192]
        score = np.repeat(norms[a : a + 8192, None].astype(np.float32), len(queries), 1)
        for m in range(len(books)):
            score -= 2 * table[m, part[:, m]]
        index = np.broadcast_to(np.arange(a, a + len(part))[:, None], score.shape)
        if best_v is not None:
            score, index = np.concatenate([best_v, score]), np.concatenate([best_i, index])
        if len(score) > keep:
            top = np.argpartition(score, keep - 1, axis=0)[:keep]
            score, index = np.take_along_axis(score, top, 0), np.take_along_axis(index, top, 0)
        best_v, best_i = score, index
    return best_i.T, best_v.T


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, books: int = 24, rerank: int = 512, shard_rows: int = 32768, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest rows of ``table``, itself excepted.

    score is the exact Euclidean distance on the original vectors. Ties go to
    the smaller id. Vectors that are null, zero, of another length, or hold null or non-finite
    components take no part. A repeated id and vector counts once. Other columns are
    ignored; an empty table gives no rows. ``rerank`` different vectors a query
    are compared exactly; with so many or fewer in all, the result is exact.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vector_col).distinct()
    alike = Window.partitionBy("v").orderBy("vec_id")
    # k + 1 least ids of a vector are all that any answer can hold
    first = rows.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v")))
    members = materialize(first.select("rep", "vec_id", F.when(F.col("r") == 1, F.col("v")).alias("v")), "members")
    reps = members.filter(F.col("v").isNotNull()).select("rep", "v")
    asked = valid_vectors(queries, id_col, vector_col).distinct()
    asked = materialize(asked.join(reps, "v").select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    n, nq = reps.count(), asked.select("rep").distinct().count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not nq:
        return spark.createDataFrame([], schema)
    sample = np.array([r["v"] for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()], np.float32)
    shipped = spark.sparkContext.broadcast(fit_codebooks(sample, books))

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, sample.shape[1]))
            codes, norms = encode(x, shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], names=["rep", "codes", "norm"])

    index = materialize(reps.mapInArrow(to_codes, "rep long, codes binary, norm float"), "codes")
    shards, blocks = -(-n // shard_rows), -(-nq // block_rows)
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    codes = index.select("rep", "codes", "norm", shard, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ask = asked.select("rep").distinct().join(reps, "rep").select("rep", "v", block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qrep": [], "rep": [], "near": []}).astype({"qrep": "int64", "rep": "int64", "near": "float64"})
        left = left.sort_values("rep")
        c = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        i, v = approximate(np.stack(right["v"].to_numpy()), shipped.value, c, left["norm"].to_numpy(), rerank)
        return pd.DataFrame({"qrep": np.repeat(right["rep"].to_numpy(), i.shape[1]), "rep": left["rep"].to_numpy()[i.ravel()], "near": v.ravel().astype(np.float64)})

    near = codes.groupBy("block", "shard").cogroup(ask.groupBy("block", "shard")).applyInPandas(search, "qrep long, rep long, near double")
    if shards > 1:
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy("near", "rep"))).filter(F.col("r") <= rerank)
    near = near.select("qrep", "rep").join(reps.withColumnRenamed("v", "x"), "rep").join(reps.select(F.col("rep").alias("qrep"), F.col("v").alias("q")), "qrep")
    square = F.zip_with("x", "q", lambda a, b: (a - b) * (a - b))
    exact = near.select("qrep", "rep", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    best = Window.partitionBy("qrep").orderBy("score", "rep")
    exact = exact.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("qrep", "rep", "score")
    each = exact.join(members.select("rep", "vec_id"), "rep").select("qrep", "vec_id", "score")
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    own = each.join(asked.withColumnRenamed("rep", "qrep"), "qrep").filter("vec_id != query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return nearest(table, table.filter(F.col("vec_id") % 100 == 0))


def op8_sql() -> str:
    """Exact search, which the operator's result equals where ``rerank`` covers all vectors."""
    return """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
    pairs AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
      sqrt(list_reduce(list_transform(range(1, len(x.e) + 1), lambda i: (x.e[i] - q.e[i]) * (x.e[i] - q.e[i])), lambda s, t: s + t)) AS score
      FROM v q JOIN v x ON x.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10"""
