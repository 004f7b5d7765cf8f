"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprint bits are grouped into partitions, correlated bits together. A
partition i gets a threshold t_i, with sum(t_i + 1) = distance + 1: then two
fingerprints within the distance agree to within t_i bits in some partition i
(t_i = -1: the partition is not used). A dynamic programme chooses the
thresholds of least estimated cost. Index values are probed, candidates
verified on the whole fingerprint.

Only different fingerprints are searched; copies share one. A key that more than
``dense`` fingerprints have would give all pairs of a group: its
fingerprints instead meet at the points one bit away. Two fingerprints
within 2 bits share such a point, any two at one point are within 2 bits, and a
point has at most 65 of them, so the links there are exact and their number linear.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_groups, join_split, materialize, read_table, release, text_or_empty
from .lines import SKETCH, alike_pairs, keep_mapped, row_key
from ..operators.graph import connected_components

BITS = 64
SEED = 42
#: Cost of making and shuffling a probe, in candidates.
PROBE_COST = 2.0


def fingerprints_of(texts: list[str], words_per_shingle: int = 3) -> np.ndarray:
    """Signed 64-bit SimHash of each text, over XXH64 of its word shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes, sizes = array("Q"), []
    for t in texts:
        words = t.encode("utf-8", "replace").lower().split()
        n = len(words)
        if n >= words_per_shingle:
            runs = zip(*[words[k:] for k in range(words_per_shingle)], strict=False)
            hashes.extend([digest(b" ".join(r), SEED) for r in runs])
            sizes.append(n - words_per_shingle + 1)
        elif n:
            hashes.append(digest(b" ".join(words), SEED))
            sizes.append(1)
        else:
            sizes.append(0)
    size = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not len(hashes):
        return out.view(np.int64)
    h = np.frombuffer(hashes, np.uint64)
    # eight counters of eight bits in a word: add up at most 255 hashes at a time
    full = size[size > 0]
    first = np.cumsum(full) - full
    runs_of = -(-full // 255)
    run_first = np.repeat(first, runs_of) + 255 * (np.arange(runs_of.sum()) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of))
    lanes = np.empty((len(run_first), 8, 8), np.int64)
    for k in range(8):
        packed = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), run_first)
        lanes[:, :, k] = packed.view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(lanes.reshape(-1, BITS), np.cumsum(runs_of) - runs_of, axis=0)
    bits = (2 * counts > full[:, None]).astype(np.uint8)
    out[size > 0] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprint_documents(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = in_groups((t.as_py() for t in batch.column(1)), 1 << 20)
            found = [fingerprints_of(g, words_per_shingle) for g in groups]
            fp = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(x), 1 << 16):
                total += (x[k : k + (1 << 16)].T @ x[k : k + (1 << 16)]).astype(np.int64)
            n += len(x)
        i, j = np.triu_indices(BITS)
        cells = [pa.array([*i, BITS], pa.int32()), pa.array([*j, BITS], pa.int32()), pa.array([*total[i, j], n], pa.int64())]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] == BITS:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        room = len(free) // (parts - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        free.discard(group[0])
        while len(group) < room:
            best = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate_thresholds(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least total cost.

    costs[i][s] is the cost of partition i at threshold s - 1. The programme runs
    over partitions and what remains to be spent.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for s in range(min(len(cost) - 1, distance + 1 - spent) + 1):
                x = (c + cost[s], [*chosen, s - 1])
                if spent + s not in after or x < after[spent + s]:
                    after[spent + s] = x
        best = after
    return best[distance + 1][1]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def plan_search(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, from counts over all fingerprints."""
    n, both = bit_statistics(fps)
    groups = group_bits(n, both, distance + 1)
    p = np.diag(both) / max(n, 1)
    tags = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_long(_mask(g))).alias("v")) for i, g in enumerate(groups)]))
    sizes = fps.select(tags.alias("k")).groupBy("k").agg(F.count("*").alias("c")).groupBy("k.part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).collect()
    alike = {r["part"]: r["s"] for r in sizes}
    costs = []
    for i, g in enumerate(groups):
        # of bits taken as independent: the odds that two fingerprints differ in b, elementary symmetric sums over the bits
        odds = [2 * p[b] * (1 - p[b]) / (p[b] ** 2 + (1 - p[b]) ** 2) for b in g]
        sums = [1.0] + [0.0] * distance
        for r in odds:
            for k in range(distance, 0, -1):
                sums[k] += r * sums[k - 1]
        cost, near, probes = [0.0], 0.0, 0
        for t in range(distance + 1):
            near += sums[t]
            probes += comb(len(g), t)
            cost.append(alike.get(i, 0.0) * near + PROBE_COST * n * probes)
        costs.append(cost)
    return list(zip(groups, allocate_thresholds(costs, distance), strict=True))


def _around(fp: Column, bits: list[int], radius: int) -> Column:
    """All values at most ``radius`` flips among ``bits`` away."""
    flips = [_mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)]
    return F.transform(F.array(*[_long(x) for x in flips]), lambda x: x.bitwiseXOR(fp))


def link_fingerprints(fps: DataFrame, distance: int = 2, dense: int = 64) -> DataFrame:
    """Edges (a, b) that connect exactly what links within ``distance`` connect.

    ``fps`` has different fingerprints in column fp and is already written.
    """
    if distance != 2:
        raise ValueError("the exact way for dense keys is for a distance of 2")
    plan = [(i, g, t) for i, (g, t) in enumerate(plan_search(fps, distance)) if t >= 0]
    part = lambda i, v: F.struct(F.lit(i).alias("part"), v.alias("v"))
    index = fps.select("fp", F.explode(F.array(*[part(i, F.col("fp").bitwiseAND(_long(_mask(g)))) for i, g, _ in plan])).alias("k"))
    wide = [(i, g, t) for i, g, t in plan if t > 0]
    rows = index.withColumn("probe", F.lit(False))
    for i, g, t in wide:
        probes = fps.select("fp", F.explode(_around(F.col("fp"), g, t)).alias("x"))
        rows = rows.unionByName(probes.select("fp", part(i, F.col("x").bitwiseAND(_long(_mask(g)))).alias("k"), F.lit(True).alias("probe")))
    rows = rows.select("fp", F.col("k.part").alias("part"), F.col("k.v").alias("v"), "probe")
    sizes = rows.groupBy("part", "v").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("indexed")).filter("n > 1 and indexed > 0")
    met = materialize(rows.join(sizes.select("part", "v", "n"), ["part", "v"]), "met")
    few, many = met.filter(F.col("n") <= dense), met.filter(F.col("n") > dense).select("fp").distinct()
    left = few.select("part", "v", F.col("fp").alias("a"), F.col("probe").alias("pa"))
    right = few.filter(~F.col("probe")).select("part", "v", F.col("fp").alias("b"))
    # without probes each pair is met from both sides; one is enough
    once = (F.col("a") < F.col("b")) | (F.col("pa") & (F.col("a") != F.col("b")))
    pairs = left.join(right, ["part", "v"]).filter(once & (_differ("a", "b") <= distance)).select("a", "b")
    points = many.select("fp", F.explode(_around(F.col("fp"), list(range(BITS)), 1)).alias("x"))
    least = points.groupBy("x").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("x", "b")
    stars = points.join(least, "x").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(documents: DataFrame, distance: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the least doc_id that links reach, the row's own included.
    Null text counts as empty; texts without words have fingerprint 0 and link
    like any other. Repeated rows share a component. A null doc_id never
    names a component, unless all of its rows are null. Other columns are ignored.
    """
    rows = materialize(fingerprint_documents(documents, text_col, id_col), "fp")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "fps")
    edges = materialize(link_fingerprints(fps, distance).distinct(), "links")
    comps = connected_components(edges).select(F.col("node").alias("fp"), "component")
    known = materialize(fps.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "known")
    named = known.groupBy("component").agg(F.min("first").alias("component_id"))
    label = materialize(join_split(known.select("fp", "component", "copies"), named, "component").select("fp", "component_id", "copies"), "label")
    out = join_split(rows, label, "fp", "copies").select("doc_id", "fp", "component_id")
    release(fps, edges, known)
    return out


def shingles_of(text: str, words_per_shingle: int) -> np.ndarray:
    """Different XXH64 of a text's word shingles, in order; of a shorter text, that of all its words."""
    words = text.encode("utf-8", "replace").lower().split()
    last = max(1, len(words) - words_per_shingle + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + words_per_shingle]), SEED) for k in range(last)], np.uint64).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.int64)[0])


def alike_by_fingerprint(sets: DataFrame, distance: int = 2) -> DataFrame:
    """Candidates (a, b), a < b, of rows (h, fp): each with the least h of its fingerprint, and those leads of linked fingerprints."""
    fps = materialize(sets.groupBy("fp").agg(F.min("h").alias("lead"), F.count("*").alias("copies")), "fps")
    lead = lambda c: fps.select(F.col("fp").alias(c), F.col("lead").alias(f"h{c}"))
    far = link_fingerprints(fps, distance).join(lead("a"), "a").join(lead("b"), "b").select("ha", "hb")
    same = join_split(sets.select("h", "fp"), fps.filter("copies > 1"), "fp", "copies").select(F.col("h").alias("ha"), F.col("lead").alias("hb"))
    both = far.unionByName(same).filter("ha != hb")
    found = materialize(both.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "alike-fps")
    release(fps)
    return found


def alike_documents(documents: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id", dense: int = 8, keys: int = 12) -> DataFrame:
    """(row_key, doc_id, component, first) of every row: rows of a component are linked by the Jaccard similarity of word shingles.

    row_key is a hash of id and text, so rows that repeat both share it. first
    is whether the row's key is that of the component's row of least doc_id (null ids come last), then least key.
    Candidates are, by generalised pigeonhole search, sets whose SimHashes link within 2 bits. Few sets alike
    are that near, so there is a second way for the rest: sets alike share two of the ``keys`` least hashes of each, but for two pairs in ten
    million by the chance of the hash (sets of up to 50 shingles: always). Of all candidates whole sets are compared.
    Texts without words, null ones among them, are alike. An empty table gives no rows; other columns are ignored.
    """
    if similarity < 0.8:
        raise ValueError("candidates are found by two shared shingles from a similarity of 0.8 on")
    id_type = documents.schema[id_col].dataType.simpleString()
    hashed = ["h", "fp", "n", "keys", *SKETCH]

    def sets_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            yield part, [shingles_of(t, words_per_shingle) for t in part.column(at).to_pylist()]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch, 2):
                bits = np.array([sketch_of(s) for s in sets], np.uint64).reshape(-1, len(SKETCH)).view(np.int64)
                whole = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                least = [s[: min(keys, len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 2)] for s in sets]
                columns = [part.column(0), part.column(1), pa.array(whole), pa.array([set_fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(least, pa.list_(pa.int64())), *[pa.array(bits[:, k]) for k in range(len(SKETCH))]]
                yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_id", *hashed])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in sets_of(batch, 1):
                # half of each hash is enough to compare two sets
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32()))], names=["h", "shingles"])

    texts = documents.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = materialize(texts.mapInArrow(sign, f"row_key long, doc_id {id_type}, h long, fp long, n int, keys array<long>, " + ", ".join(f"{x} long" for x in SKETCH)), "signs")
    where = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    # rows of one set are one: its keys, and the place of the first of them
    sets = rows.withColumn("place", where).groupBy("h").agg(F.min("place").alias("place"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in hashed[1:]])
    sets = materialize(sets, "sets")

    def facts_of(ends: DataFrame) -> DataFrame:
        need = materialize(sets.join(ends, "h").select("h", F.col("place.row_key").alias("row_key"), *SKETCH), "need")
        some = keep_mapped(texts.select("row_key", "text"), "row_key", need.select("row_key")).join(need.select("row_key", "h"), "row_key").select("h", "text")
        full = some.mapInArrow(whole_sets, "h long, shingles array<int>").groupBy("h").agg(F.min("shingles").alias("shingles"))
        facts = materialize(full.join(need.select("h", *SKETCH), "h"), "facts")
        release(need)
        return facts

    def prove(links: DataFrame, facts: DataFrame) -> DataFrame:
        side = lambda c: facts.select(F.col("h").alias(c), F.col("shingles").alias(f"s{c}"))
        both = F.size(F.array_intersect("sa", "sb"))
        alike = both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9
        return materialize(links.join(side("a"), "a").join(side("b"), "b").filter(alike).select("a", "b"), "proved")

    turns = f"cast(floor((na + nb) * {(1 - similarity) / (1 + similarity)} + 1e-9) as int)"
    near = alike_by_fingerprint(sets.filter("n > 1").select("h", "fp"))
    proved = alike_pairs(sets.filter("n > 1").select("h", "n", "keys"), similarity, dense, facts_of, prove, turns, near)
    comps = connected_components(proved).select(F.col("node").alias("h"), "component")
    known = materialize(sets.join(comps, "h", "left").select("h", "place", "copies", F.coalesce("component", "h").alias("component")), "known")
    named = known.groupBy("component").agg(F.min("place").alias("least")).select("component", F.col("least.row_key").alias("first_key"))
    label = materialize(join_split(known.select("h", "component", "copies"), named, "component"), "label")
    out = materialize(join_split(rows.select("row_key", "doc_id", "h"), label, "h", "copies").select("row_key", "doc_id", "component", (F.col("row_key") == F.col("first_key")).alias("first")), "alike")
    release(rows, sets, near, proved, known, label)
    return out


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """As lines.sketch has it."""
    h = hashes.view(np.uint64)
    odd = np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256) & 1
    # bit p of lane k is place 4 * p + k
    lanes = np.ascontiguousarray(odd.reshape(64, 4).T.astype(np.uint8))
    return np.ascontiguousarray(np.packbits(lanes, axis=1, bitorder="little")).view(np.uint64).ravel()


def fingerprint_text(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")
