"""Connected components of an edge table, by alternating star steps.

Only built-in DataFrame operations. Each round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its neighbours and itself to its larger neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its smaller neighbours to the others of them and to itself.

    Edges point from the larger node to the smaller.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its least node.

    ``edges`` has columns a and b of one orderable type, in any direction and
    number. Loops and nulls are ignored. Rounds grow with the logarithm of
    the longest chain; a RuntimeError says that ``max_rounds`` did not do.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        release(before)
        found = now.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or found[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(found)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
