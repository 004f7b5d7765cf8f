"""Similarity of embeddings, and identities from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release
from .graph import connected_components

#: Rows of a block: two blocks and their product fit in a Python worker.
BLOCK_ROWS = 2048
#: Blocks for work side by side; beyond, a block takes as many times BLOCK_ROWS.
FEW_BLOCKS = 8
#: Pairs that are made at once.
STRIP_PAIRS = 1 << 20
METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "correlation")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str) -> Column:
    """Divided by its length, of at least 1e-12."""
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays, with 1e-12 added to each length."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def finite(a: Column | str) -> Column:
    return F.coalesce(~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _blocks(df: DataFrame, n: int) -> int:
    return max(1, -(-n // BLOCK_ROWS))


def _large_blocks(df: DataFrame, n: int) -> int:
    """Few blocks, as a row is shuffled once for each."""
    return max(-(-n // (FEW_BLOCKS * BLOCK_ROWS)), min(_blocks(df, n), FEW_BLOCKS))


def _cells(df: DataFrame, blocks: int) -> DataFrame:
    """Each row once in every pair of blocks that its own is part of; ``cell`` numbers the pair."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    tagged = df.withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return tagged.withColumn("other", other).select("id", "v", "block", (F.least("block", "other") * blocks + F.greatest("block", "other")).alias("cell"))


def _by_cell(cells: DataFrame, work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], kind: str, parts: int | None = None) -> DataFrame:
    """What ``work`` gives for the rows of each cell, in ``parts`` partitions if given: for long work on few bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for cell, rows in batch.groupby("cell", sort=True):
                if held and held[-1]["cell"].iloc[0] != cell:
                    yield from work(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    dealt = cells.repartition(parts, "cell") if parts else cells.repartition("cell")
    return dealt.sortWithinPartitions("cell").mapInPandas(run, kind)


def _metric(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("euclidean", "sqeuclidean"):
        d = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)
        # products cancel for near rows: those are taken again as differences
        i, j = np.nonzero(d < 1e-6 * ((x**2).sum(1)[:, None] + (y**2).sum(1)[None]))
        for a in range(0, len(i), 65536):
            d[i[a : a + 65536], j[a : a + 65536]] = ((x[i[a : a + 65536]] - y[j[a : a + 65536]]) ** 2).sum(1)
        return np.sqrt(d) if metric == "euclidean" else d
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    out = np.empty((len(x), len(y)))
    for k in range(len(x)):
        gap = np.abs(x[k] - y)
        out[k] = gap.sum(1) if metric == "cityblock" else gap.max(1)
    return out


def pair_distances(vectors: DataFrame, metric: str = "euclidean", within: float | None = None) -> DataFrame:
    """(a, b, distance) of pairs a < b of rows (id, v), all or those ``within`` a distance, block by block.

    A row is shuffled once for each block, so blocks are large (few only for the sake of side by side work);
    pairs of two blocks are made and handed on a strip at a time.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    kind = vectors.schema["id"].dataType.simpleString()
    n = vectors.count()
    blocks = _large_blocks(vectors, n)
    cells = _cells(vectors.filter(F.col("v").isNotNull()), blocks)

    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lo, hi = divmod(int(pdf["cell"].iloc[0]), blocks)
        left, right = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        if not len(left) or not len(right):
            return
        x, y = (np.stack(side["v"].to_numpy()).astype(float) for side in (left, right))
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        strip = max(1, STRIP_PAIRS // len(b))
        for k in range(0, len(a), strip):
            d = _metric(x[k : k + strip], y, metric)
            keep = a[k : k + strip, None] < b[None] if lo == hi else np.ones(d.shape, bool)
            if within is not None:
                keep &= d <= within
            i, j = np.nonzero(keep)
            if len(i):
                p, q = a[k + i], b[j]
                yield pd.DataFrame({"a": np.where(p > q, q, p), "b": np.where(p > q, p, q), "distance": d[i, j]})

    return _by_cell(cells, pairs, f"a {kind}, b {kind}, distance double")


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs a < b with cosine strictly above the threshold."""
    unit = vectors.filter(finite("v")).select("id", normalized("v").alias("v"))
    near = pair_distances(unit, "cosine", 1 - threshold + 1e-9)
    return near.select("a", "b", (1 - F.col("distance")).alias("similarity")).filter(F.col("similarity") > threshold)


def nearest_in_gallery(probes: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """(probe, rank, gallery_id, label, similarity): top k of the gallery by cosine.

    ``probes`` has (id, v), ``gallery`` (id, v, label). Probes and gallery meet in blocks, each
    giving its own k best; ties go to the smaller id. A gallery of fewer rows gives fewer.
    """
    unit = lambda df, *more: df.filter(finite("v")).select("id", normalized("v").alias("v"), *more)
    p, g = unit(probes), unit(gallery, F.col("label").cast("string").alias("label"))
    pb, gb = _blocks(p, p.count()), _blocks(g, g.count())
    side = lambda df, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    left, right = side(p, "pb", pb, "gb", gb), side(g, "gb", gb, "pb", pb)
    kinds = probes.schema["id"].dataType.simpleString(), gallery.schema["id"].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"probe": [], "gallery_id": [], "label": [], "similarity": []})
        b = b.sort_values("id")
        s = np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"probe": np.repeat(a["id"].to_numpy(), top.shape[1]), "gallery_id": b["id"].to_numpy()[top.ravel()], "label": b["label"].to_numpy()[top.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel()})

    found = left.groupBy("pb", "gb").cogroup(right.groupBy("pb", "gb")).applyInPandas(run, f"probe {kinds[0]}, gallery_id {kinds[1]}, label string, similarity double")
    order = Window.partitionBy("probe").orderBy(F.desc("similarity"), "gallery_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("probe", "rank", "gallery_id", "label", "similarity")


def gallery_labels(unit: np.ndarray, threshold: float, state: tuple[list[np.ndarray], list[int]] | None = None, block: int = 256) -> np.ndarray:
    """Leader clustering in order: join the nearest centroid of cosine >= threshold, else lead a new one.

    Blocks of rows are scored against all centroids in one product; when a row moves a centroid or makes one,
    that column is scored again for the rows after it. ``state`` (centroids, counts) is carried and
    changed in place. A row that is not finite gets -1.
    """
    centroids, counts = state if state is not None else ([], [])
    labels = np.full(len(unit), -1, np.int64)
    whole = np.flatnonzero(np.isfinite(unit).all(1))
    for rows in np.split(whole, range(block, len(whole), block)):
        x = unit[rows]
        score = np.full((len(x), len(counts) + len(x)), -np.inf)  # with a column for each that may be made
        if counts:
            score[:, : len(counts)] = x @ np.stack(centroids).T
        for i, best in enumerate(score):
            to = int(best.argmax())
            if best[to] >= threshold:
                counts[to] += 1
                mean = ((counts[to] - 1) * centroids[to] + x[i]) / counts[to]
                centroids[to] = mean / max(float(np.sqrt(mean @ mean)), 1e-12)
            else:
                to = len(counts)
                centroids.append(x[i])
                counts.append(1)
            score[i + 1 :, to] = x[i + 1 :] @ centroids[to]
            labels[rows[i]] = to
    return labels


def _core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th neighbour, itself the first, a strip of rows at a time."""
    n = len(x)
    core, strip = np.empty(n), max(1, STRIP_PAIRS // n)
    for i in range(0, n, strip):
        d = _metric(x[i : i + strip], x, "euclidean")
        d[np.arange(len(d)), np.arange(i, i + len(d))] = 0
        core[i : i + strip] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return core.round(12)


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """(length, from, to) of the least spanning tree from row 0, over distances raised to core distances.

    Distances are made from one row at a time; rows not yet reached lie at the front of the arrays.
    """
    n = len(x)
    row, rest, c, sq = np.arange(n), x.copy(), core.copy(), (x**2).sum(1)
    best, link = np.full(n, np.inf), np.zeros(n, np.int64)
    edges, place, norm = [], 0, sq.copy()
    for m in range(n - 1, 0, -1):
        at = int(row[place])
        for a in (row, rest, c, sq, best, link):
            a[place] = a[m]
        d = np.maximum(norm[at] + sq[:m] - 2 * (rest[:m] @ x[at]), 0)
        near = np.flatnonzero(d < 1e-6 * (norm[at] + sq[:m]))
        d[near] = ((rest[near] - x[at]) ** 2).sum(1)
        # rounded as core distances are: a distance and the core distance it is stay equal
        d = np.maximum(np.sqrt(d).round(12), np.maximum(core[at], c[:m]))
        closer = np.flatnonzero(d < best[:m])
        best[closer], link[closer] = d[closer], at
        least = np.flatnonzero(best[:m] == best[:m].min())
        place = int(least[row[least].argmin()])
        edges.append((best[place], int(link[place]), int(row[place])))
    return edges


def density_labels(unit: np.ndarray, threshold: float, min_cluster_size: int = 2) -> np.ndarray:
    """Hierarchical density clustering of unit rows in one worker; noise is -1. Memory grows with the rows, time with their square.

    Distances are raised to the core distances (to the min_cluster_size-th
    neighbour, itself included), a spanning tree of them gives the
    hierarchy, branches of fewer rows than min_cluster_size fall out as noise, and the most
    stable branches are clusters; below sqrt(2 - 2·threshold) branches are not divided.
    """
    n, least = len(unit), max(2, int(min_cluster_size))
    if n < least:
        return np.full(n, -1, np.int64)
    return _tree_labels(n, _spanning_tree(unit, _core_distances(unit, least)), threshold, least)


def _tree_labels(n: int, edges: list[tuple[float, int, int]], threshold: float, least: int) -> np.ndarray:
    """density_labels of n rows from the edges of any least spanning tree."""
    out = np.full(n, -1, np.int64)
    edges = sorted(edges, key=lambda e: e[0])
    # merge tree: node n + k joins two nodes at a height
    up, size, kids, height = list(range(n)), [1] * n, [None] * n, [0.0] * n

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for h, a, b in edges:
        a, b = root(a), root(b)
        k = len(up)
        up.append(k)
        up[a] = up[b] = k
        size.append(size[a] + size[b])
        kids.append((a, b))
        height.append(float(h))
    # condensed clusters: (birth, nodes whose members leave with their level, children)
    clusters: list[dict] = []

    def leaves(x: int) -> list[int]:
        todo, got = [x], []
        while todo:
            y = todo.pop()
            if kids[y] is None:
                got.append(y)
            else:
                todo += kids[y]
        return got

    def parts(x: int) -> list[int]:
        """What meets at the height of x: merges of one height are one, so that the choice of the tree does not matter."""
        todo, got = list(kids[x]), []
        while todo:
            y = todo.pop()
            if kids[y] is not None and height[y] == height[x]:
                todo += kids[y]
            else:
                got.append(y)
        return got

    level = lambda h: np.inf if h <= 0 else 1 / h
    stack = [(len(up) - 1, -1, 0.0)]
    while stack:
        node, parent, birth = stack.pop()
        me = len(clusters)
        clusters.append({"birth": birth, "parent": parent, "out": [], "split": [], "at": None})
        if parent >= 0:
            clusters[parent]["split"].append(me)
        while kids[node] is not None:
            some = parts(node)
            lam = level(height[node])
            big = [x for x in some if size[x] >= least]
            if len(big) > 1:
                clusters[me]["at"] = height[node]
                clusters[me]["out"].append((node, lam))
                stack += [(x, me, lam) for x in big]
                break
            clusters[me]["out"] += [(x, lam) for x in some if size[x] < least]
            if not big:
                break
            node = big[0]
        else:
            clusters[me]["out"].append((node, level(0.0)))
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    stable = [sum(size[x] * (min(lam, 1e12) - min(c["birth"], 1e12)) for x, lam in c["out"]) for c in clusters]
    chosen = [False] * len(clusters)
    for k in range(len(clusters) - 1, 0, -1):
        below = sum(stable[j] for j in clusters[k]["split"])
        chosen[k] = not clusters[k]["split"] or stable[k] >= below
        stable[k] = max(stable[k], below)

    def clear(k: int) -> None:
        todo = list(clusters[k]["split"])
        while todo:
            j = todo.pop()
            chosen[j] = False
            todo += clusters[j]["split"]

    for k in range(1, len(clusters)):
        if chosen[k]:
            clear(k)
    # a chosen cluster born below eps gives way to the ancestor born above it
    for k in [k for k, c in enumerate(chosen) if c]:
        if not chosen[k]:
            continue
        top = k
        while clusters[top]["parent"] > 0 and (np.inf if clusters[top]["birth"] <= 0 else 1 / clusters[top]["birth"]) < eps:
            top = clusters[top]["parent"]
        if top != k:
            clear(top)
            chosen[top] = True
    inside: dict[int, list[int]] = {}
    for k, c in enumerate(chosen):
        if c:
            inside[k] = sorted(y for x, _ in clusters[k]["out"] for y in leaves(x))
    for label, k in enumerate(sorted(inside, key=lambda k: inside[k][0])):
        out[inside[k]] = label
    return out


def _reach(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Distances raised to core distances, rounded as these are."""
    d = _metric(x, y, "euclidean").round(12)
    np.maximum(d, cx[:, None], out=d)
    return np.maximum(d, cy, out=d)


def _bipartite_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the edges of a least spanning tree between rows and columns."""
    flip = np.ascontiguousarray(d.T)
    sides, best, link = (d, flip), [np.full(n, np.inf) for n in d.shape], [np.zeros(n, np.int64) for n in d.shape]
    open_ = [np.ones(n, bool) for n in d.shape]
    at, side, edges = 0, 0, []
    while True:
        open_[side][at], best[side][at] = False, np.inf
        row, other = sides[side][at], 1 - side
        closer = np.flatnonzero((row < best[other]) & open_[other])
        best[other][closer], link[other][closer] = row[closer], at
        first = [int(b.argmin()) for b in best]
        side = int(best[1][first[1]] < best[0][first[0]])
        at = first[side]
        if not best[side][at] < np.inf:
            return tuple(np.array(edges, np.int64).reshape(-1, 2).T)
        edges.append((link[1][at], at) if side else (at, link[0][at]))


def _least_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a least spanning forest of nodes 0 to n - 1."""
    order, up, kept = np.argsort(d, kind="stable"), list(range(n)), []
    for e, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[y] = x
            kept.append(e)
    return np.array(kept, np.int64)


def _unit_rows(vs: pd.Series, d: int) -> np.ndarray:
    """Rows divided by their length; NaN where a vector is null, of another size than d, or holds nulls."""
    x = np.full((len(vs), d), np.nan)
    for i, v in enumerate(vs):
        if v is not None and len(v) == d and not any(e is None for e in v):
            x[i] = v
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def density_clusters(rows: DataFrame, threshold: float, min_cluster_size: int = 2) -> DataFrame:
    """(id, first) of finite rows (id, v): the least id of a row's density cluster, NULL for noise; as density_labels.

    Distances are taken block against block, side by side: first for core distances, then for a
    spanning tree between the rows of two blocks. The trees of all pairs of blocks hold one of all rows;
    one worker makes the hierarchy from their edges, without vectors.
    """
    least = max(2, int(min_cluster_size))
    kind = rows.schema["id"].dataType.simpleString()
    d = rows.agg(F.max(F.when(F.col("v").isNotNull(), F.size("v")))).first()[0] or 1

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _unit_rows(pdf["v"], d)
            good = np.isfinite(x).all(1)
            yield pd.DataFrame({"node": pdf["node"][good], "key": pdf["key"][good], "v": list(x[good])})

    numbered = rows.select(F.monotonically_increasing_id().alias("node"), F.col("id").alias("key"), "v")
    numbered = materialize(numbered.mapInPandas(unit, f"node long, key {kind}, v array<double>"), "unit")
    n = numbered.count()
    blocks = _large_blocks(numbered, n)

    def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
        lo, hi = divmod(int(pdf["cell"].iloc[0]), blocks)
        return pdf[pdf["block"] == lo], pdf[pdf["block"] == hi], lo == hi

    def nearest(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left, right, same = sides(pdf)
        if not len(left) or not len(right):
            return
        x, y = (np.stack(side["v"].to_numpy()) for side in (left, right))
        strip, below = max(1, STRIP_PAIRS // len(y)), np.full((least, len(y)), np.inf)
        for k in range(0, len(x), strip):
            gap = _metric(x[k : k + strip], y, "euclidean")
            if same:
                gap[np.arange(len(gap)), np.arange(k, k + len(gap))] = 0
            few = min(least, len(y))
            yield pd.DataFrame({"id": left["id"].to_numpy()[k : k + strip], "near": list(np.partition(gap, few - 1, axis=1)[:, :few])})
            if not same:
                below = np.partition(np.vstack([below, gap]), least - 1, axis=0)[:least]
        if not same:
            yield pd.DataFrame({"id": right["id"].to_numpy(), "near": list(below.T)})

    plain = numbered.select(F.col("node").alias("id"), "v")
    near = _by_cell(_cells(plain, blocks), nearest, "id long, near array<double>", blocks * (blocks + 1))
    core = near.groupBy("id").agg(F.element_at(F.sort_array(F.flatten(F.collect_list("near"))), least).alias("core"))
    cored = materialize(plain.join(core, "id").select("id", F.struct("v", "core").alias("v")), "core")

    def tree(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left, right, same = sides(pdf)
        if not len(left) or not len(right):
            return
        (x, cx), (y, cy) = ((np.stack([v["v"] for v in side["v"]]), np.array([v["core"] for v in side["v"]]).round(12)) for side in (left, right))
        got = []
        for i in range(0, len(x), BLOCK_ROWS):
            for j in range(i if same else 0, len(y), BLOCK_ROWS):
                gap = _reach(x[i : i + BLOCK_ROWS], y[j : j + BLOCK_ROWS], cx[i : i + BLOCK_ROWS], cy[j : j + BLOCK_ROWS])
                if same and i == j:
                    np.fill_diagonal(gap, np.inf)
                p, q = _bipartite_tree(gap)
                got.append((i + p, j + q, gap[p, q]))
        a, b, length = (np.concatenate(c) for c in zip(*got, strict=True))
        kept = _least_forest(len(x) + len(y), a, b if same else len(x) + b, length)
        yield pd.DataFrame({"a": left["id"].to_numpy()[a[kept]], "b": right["id"].to_numpy()[b[kept]], "length": length[kept]})

    edges = materialize(_by_cell(_cells(cored, blocks), tree, "a long, b long, length double", blocks * (blocks + 1)), "tree")

    def label(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["key", "node"]).reset_index(drop=True)
        by_node = nodes["node"].sort_values()
        place = lambda c: by_node.index.to_numpy()[np.searchsorted(by_node.to_numpy(), pairs[c].to_numpy())]
        a, b, length = place("a"), place("b"), pairs["length"].to_numpy()
        kept = _least_forest(len(nodes), a, b, length)
        got = np.full(len(nodes), -1)
        if len(nodes) >= least:
            got = _tree_labels(len(nodes), list(zip(length[kept].tolist(), a[kept].tolist(), b[kept].tolist(), strict=True)), threshold, least)
        first = nodes["key"].groupby(got).transform("min") if len(nodes) else nodes["key"]
        return pd.DataFrame({"id": nodes["key"], "first": first.where(pd.Series(got) >= 0, None)})

    one = lambda df: df.groupBy(F.lit(0).alias("all"))
    found = one(numbered.select("node", "key")).cogroup(one(edges)).applyInPandas(label, f"id {kind}, first {kind}")
    found = materialize(found, "density")
    release(numbered, cored, edges)
    return found


def cluster_identities(faces: DataFrame, threshold: float = 0.8, method: str = "gallery", min_cluster_size: int = 2, scope: str | None = None, id_col: str = "id", vector_col: str = "v", with_scope: bool = False) -> DataFrame:
    """(id, Identity), and scope if asked for: Person_k numbered by first appearance in the order of id.

    gallery: leader clustering in order of id (cosine >= threshold). connected: components of cosine >
    threshold, distributed. hdbscan: by density, distributed but for the hierarchy. Noise is 'Unknown', a vector that is not finite NULL.
    ``scope`` names the column (a recording) that gallery and hdbscan run within, a whole scope in order, side by side.
    """
    rows = faces.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), (F.col(scope) if scope else F.lit(0)).alias("scope"))
    kind = rows.schema["id"].dataType.simpleString()
    if method == "connected":
        if scope:
            raise ValueError("components are of all rows")
        unit = rows.filter(finite("v")).select("id", "v")
        links = materialize(similar_pairs(unit, threshold).select("a", "b"), "similar")
        comp = connected_components(links).withColumnRenamed("node", "id")
        firsts = unit.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("first"), F.lit(0).alias("scope"))
    elif method == "hdbscan" and not scope:
        firsts = density_clusters(rows, threshold, min_cluster_size).withColumn("scope", F.lit(0))
    elif method in ("gallery", "hdbscan"):

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").reset_index(drop=True)
            x = _unit_rows(pdf["v"], max(len(v) for v in pdf["v"] if v is not None) if pdf["v"].notna().any() else 1)
            good = np.isfinite(x).all(1)
            label = np.full(len(pdf), -2)
            label[good] = gallery_labels(x[good], threshold) if method == "gallery" else density_labels(x[good], threshold, min_cluster_size)
            first = pdf["id"].where(good).groupby(label).transform("min") if len(pdf) else pdf["id"]
            return pd.DataFrame({"id": pdf["id"], "first": first.where(pd.Series(label) >= 0, None), "scope": pdf["scope"], "noise": label == -1})[good]

        found = rows.groupBy("scope").applyInPandas(run, f"id {kind}, first {kind}, scope {rows.schema['scope'].dataType.simpleString()}, noise boolean")
        firsts = found.select("id", "first", "scope")
    else:
        raise ValueError("method is gallery, connected or hdbscan")
    number = firsts.filter("first is not null").select("scope", "first").distinct()
    number = number.withColumn("k", F.dense_rank().over(Window.partitionBy("scope").orderBy("first")))
    named = firsts.join(number, ["scope", "first"], "left").select("id", "scope", F.when(F.col("k").isNotNull(), F.concat(F.lit("Person_"), F.col("k").cast("string"))).otherwise("Unknown").alias("Identity"))
    return rows.select("id", "scope").join(named, ["id", "scope"], "left").select("id", *(["scope"] if with_scope else []), "Identity")


def rank_k_table(embeddings: DataFrame, probes: DataFrame, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Nearest gallery rows of each probe with ``hit``: whether the label is the probe's own."""
    near = nearest_in_gallery(probes.select("id", "v"), embeddings, max(ks))
    own = probes.select(F.col("id").alias("probe"), F.col("label").cast("string").alias("own"))
    return near.join(own, "probe").select("probe", "rank", (F.col("label") == F.col("own")).alias("hit"))
