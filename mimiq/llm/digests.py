"""Document fingerprints by improbable features, in chained Bloom filters.

The entropy of each byte window ranks it: the farther from what text usually
has, the rarer. In each neighbourhood of windows the rarest is a candidate,
and one that is rarest in several neighbourhoods is a feature. Features
set bits in Bloom filters; a full filter is followed by a new one. Two
digests are alike by the overlap of their filters' bits, normalised between the
overlap of chance and the greatest possible.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, text_or_empty

#: Bytes of a window, windows of a neighbourhood, neighbourhoods that a feature must win: alike for texts of any length.
WINDOW, NEAR, WINS = 8, 8, 3
#: Bits of a filter, features in it, bits per feature; overlap below this share of the range counts as chance.
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS, CHANCE = 2048, 128, 5, 0.3
#: Entropy of common windows of text, in bits, from which rarity is measured.
USUAL = 2.6
#: Bytes handled at once within arrays, small enough for the processor's cache.
STEP = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SCALE = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    c = np.arange(WINDOW + 2)
    f = np.round(_SCALE * c * np.log2(np.maximum(c, 1))).astype(np.int64)
    gain = np.zeros(WINDOW + 1, np.int64)
    gain[1:] = f[1 : WINDOW + 1] - f[:WINDOW]
    return f, gain


_F, _GAIN = _tables()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_INVERSE = pow(int(_ODD), -1, 1 << 64)


def window_keys(x: np.ndarray) -> np.ndarray:
    """For each window of x: rarity in the top bits (small is rare), a hash of its bytes below."""
    n = len(x)
    came = np.ones(n, np.uint8)  # the byte's occurrences among the WINDOW up to and with it
    goes = np.ones(n, np.uint8)  # and among the WINDOW from it on
    for d in range(1, min(WINDOW, n)):
        same = (x[d:] == x[:-d]).view(np.uint8)
        came[d:] += same
        goes[:-d] += same
    change = _GAIN[came]
    change[WINDOW:] -= _GAIN[goes[:-WINDOW]]
    repeats = np.cumsum(change)[WINDOW - 1 :]  # sum of c·log2(c) in each window
    entropy = np.int64(_SCALE * np.log2(WINDOW)) - repeats // WINDOW
    rarity = np.abs(entropy - np.int64(USUAL * _SCALE)) >> 14
    worth = np.uint64(511) - np.minimum(rarity, 511).astype(np.uint64)
    return (worth << np.uint64(54)) | _window_hashes(x)


def _window_hashes(x: np.ndarray) -> np.ndarray:
    """54-bit hashes of all windows: differences of running polynomial sums, moved to position 0."""
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(n, int(_ODD)), out=sums[1:])
    h = (sums[WINDOW:] - sums[:-WINDOW]) * _powers(n - WINDOW + 1, _INVERSE)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h >> np.uint64(10)


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours, from running minima of blocks."""
    n = len(x)
    full = np.full(-(-n // k) * k, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, k)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - k + 1], ahead[k - 1 : n])


def features(data: bytes) -> np.ndarray:
    """Keys of a text's features, in the order of the text, each once.

    A text of less than a window is filled up with zeros; one of less than a neighbourhood is one neighbourhood.
    """
    if not data:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8)
    found = []
    lap = WINDOW + 2 * NEAR
    for at in range(0, len(x), STEP):
        keys = window_keys(x[max(0, at - lap) : at + STEP])
        least = _sliding_min(keys, min(NEAR, len(keys)))
        cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        runs = np.diff(np.concatenate([cuts, [len(least)]]))
        found.append(least[cuts[runs >= min(WINS, len(least))]])
    chosen = np.concatenate(found)
    if not len(chosen):
        # nothing wins often enough: the rarest window of all
        return np.array([min(window_keys(x[max(0, at - lap) : at + STEP]).min() for at in range(0, len(x), STEP))], np.uint64)
    return _once(chosen)


def _once(x: np.ndarray) -> np.ndarray:
    _, first = np.unique(x, return_index=True)
    return x[np.sort(first)]


def filters_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature counts, filters as bits packed in rows) of chained Bloom filters."""
    n = len(found)
    chain = -(-n // FILTER_FEATURES)
    bits = np.zeros((chain, FILTER_BITS), np.uint8)
    rows = np.arange(n) // FILTER_FEATURES
    h = found * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    for k in range(FEATURE_BITS):
        bits[rows, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    counts = np.full(chain, FILTER_FEATURES, np.int64)
    if chain:
        counts[-1] = n - FILTER_FEATURES * (chain - 1)
    return counts, np.packbits(bits, axis=1)


def digest_text(filters: tuple[np.ndarray, np.ndarray]) -> str:
    """The filters as text: number of features, colon, bits in base 64; joined by dots."""
    counts, rows = filters
    return ".".join(f"{c}:{base64.b64encode(r.tobytes()).decode()}" for c, r in zip(counts.tolist(), rows, strict=True))


def parse_digest(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not text:
        return np.zeros(0, np.int64), np.zeros((0, FILTER_BITS // 8), np.uint8)
    parts = [p.split(":") for p in text.split(".")]
    return np.array([int(c) for c, _ in parts]), np.stack([np.frombuffer(base64.b64decode(b), np.uint8) for _, b in parts])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: for each filter of the shorter digest its best match in the other, on average by features.

    Two empty digests are alike, an empty and another not at all.
    """
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    if (len(a[0]), int(a[0].sum()), a[1].tobytes()) > (len(b[0]), int(b[0].sum()), b[1].tobytes()):
        a, b = b, a
    x, y = a[1].view(np.uint64), b[1].view(np.uint64)
    ones_x, ones_y = np.bitwise_count(x).sum(1).astype(float), np.bitwise_count(y).sum(1).astype(float)
    best = np.zeros(len(x))
    for i in range(len(x)):
        both = np.bitwise_count(x[i] & y).sum(1).astype(float)
        most = np.minimum(ones_x[i], ones_y)
        chance = ones_x[i] * ones_y / FILTER_BITS
        floor = chance + CHANCE * (most - chance) * (most > chance)
        best[i] = np.max(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1))
    return float(np.average(best, weights=a[0]))


def _edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(documents: DataFrame, bytes_per_bucket: int = 16 << 20, most_buckets: int = 16384, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows dealt by ranges of id, each range sorted by id from large to small and ended by the row that follows it.

    Columns: bucket int, tail boolean, doc_id, text. Texts are shuffled once, and streamed.
    Only quantiles of the ids and each range's first id go to the driver, for ``most_buckets`` ranges at most
    of rows with an id, and as many of rows without; those are dealt by the hash of the text. After
    the last row comes the first. Equal ids are ordered by a hash of the text;
    null ids come last.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("rank", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    lack = F.col("doc_id").isNull()
    size = rows.agg(F.sum(F.when(lack, 0).otherwise(F.octet_length("text"))), F.sum(F.when(lack, F.octet_length("text"))), F.count_if(~lack)).first()
    buckets, pieces = (min(most_buckets, max(1, -(-(b or 0) // bytes_per_bucket))) for b in size[:2])
    marks = np.array(sorted(set(rows.filter(~lack).approxQuantile("rank", [k / buckets for k in range(1, buckets)], 0.1 / buckets))) if buckets > 1 and size[2] else [])
    bounds = documents.sparkSession.sparkContext.broadcast(marks)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), rows.schema["rank"], T.StructField("tie", T.LongType())])
    keys = rows.select("rank", F.xxhash64("text").alias("tie"))

    def bucket_of(rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
        # from large ids to small, then from large hashes to small
        of_id = len(bounds.value) - np.searchsorted(bounds.value, rank.astype(np.float64), "right")
        of_none = len(bounds.value) + 1 + np.floor((0.5 - tie / 2.0**64) * pieces).clip(0, pieces - 1)
        return np.where(rank == -(2**63), of_none, of_id).astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = bucket_of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(0), batch.column(1)], names=["bucket", "rank", "tie"])

    firsts = keys.mapInArrow(number, schema).groupBy("bucket").agg(F.max(F.struct("rank", "tie")).alias("m")).orderBy("bucket").collect()
    order = [r["bucket"] for r in firsts]
    # a number for each range that Spark's hash deals to a task of its own
    spread = documents.sparkSession.range(32 * max(1, len(order))).select(F.col("id").cast("int").alias("k"))
    spread = spread.groupBy(F.pmod(F.hash("k"), F.lit(max(1, len(order)))).alias("p")).agg(F.min("k").alias("k")).orderBy("p").collect()
    own = dict(zip(order, [r["k"] for r in spread] if len(spread) == len(order) else order, strict=True))
    follows = {(firsts[(k + 1) % len(order)]["m"]["rank"], firsts[(k + 1) % len(order)]["m"]["tie"]): b for k, b in enumerate(order)}
    heads = documents.sparkSession.sparkContext.broadcast(follows)
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("tail", T.BooleanType()), T.StructField("rank", T.LongType()), T.StructField("tie", T.LongType()), rows.schema["doc_id"], T.StructField("text", T.StringType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, tie = batch.column(0), batch.column(1)
            b = np.array([own[x] for x in bucket_of(rank.to_numpy(), tie.to_numpy()).tolist()], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.zeros(len(b), bool)), *batch.columns], names=out.names)
            pick = [(i, heads.value[k]) for i, k in enumerate(zip(rank.to_pylist(), tie.to_pylist(), strict=True)) if k in heads.value]
            if pick:
                some = batch.take(pa.array([i for i, _ in pick], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([own[t] for _, t in pick], pa.int32()), pa.array([True] * len(pick)), *some.columns], names=out.names)

    dealt = rows.select("rank", F.xxhash64("text").alias("tie"), "doc_id", "text").mapInArrow(deal, out)
    return dealt.repartition(max(1, len(order)), "bucket").sortWithinPartitions("bucket", "tail", F.desc("rank"), F.desc("tie")).select("bucket", "tail", "doc_id", "text")


def fingerprint_documents(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digest of each whole text, of its edited text, and their likeness.

    The edited text has its last third replaced by the start of the next
    document's, by descending id. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null text counts as empty, with
    an empty digest. Texts of up to a window have one feature, the whole text. Repeated rows follow one another. Other columns are ignored.
    """
    dealt = with_next(documents, text_col=text_col, id_col=id_col)
    schema = f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row whose next has not come yet: bucket, id, text, filters

        def done(row: tuple, text: str, filters: tuple) -> list:
            edited = _edited(row[2], text)
            edited_filters = row[3] if edited == row[2] else filters_of(features(edited.encode("utf-8", "replace")))
            sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
            return [row[1], len(row[2]), sha, digest_text(row[3]), digest_text(edited_filters), likeness(row[3], edited_filters), likeness(row[3], filters)]

        for batch in batches:
            out = []
            for bucket, tail, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and (waiting is None or waiting[0] != bucket):
                    continue  # a repeated tail
                filters = filters_of(features(text.encode("utf-8", "replace")))
                if waiting is not None:
                    out.append(done(waiting, text, filters))
                waiting = None if tail else (bucket, who, text, filters)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)


def op4_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
