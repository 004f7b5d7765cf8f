"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release, shared_dir

__all__ = ["Memo", "fresh_name", "held", "in_groups", "join_split", "materialize", "read_table", "release", "shared_dir", "text_or_empty"]

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def join_split(rows: DataFrame, facts: DataFrame, key: str, weight: str | None = None, share: int = 512, how: str = "inner") -> DataFrame:
    """rows join facts on ``key`` (not null, at most one row of facts each), so that no key makes a task heavy.

    Keys that hold more than one in ``share`` of the rows are at most ``share`` keys: their
    facts are broadcast. The others are shuffled. ``weight`` is a column of
    facts with the number of rows of its key, if facts has it; else rows are counted.
    """
    sizes = facts.select(key, F.col(weight).alias("n_rows")) if weight else rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    hot = [r[0] for r in sizes.filter(F.col("n_rows") > total / share).select(key).collect()]
    facts = facts.drop(weight) if weight else facts
    if not hot:
        return rows.join(facts, key, how)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), key, how).unionByName(rows.filter(~F.coalesce(is_hot, F.lit(False))).join(facts.filter(~is_hot), key, how))


class Memo:
    """A bounded memo of pure results, filled a group of keys at a time.

    Between groups, entries beyond ``limit`` start a new generation; those not
    asked for during a whole generation go. So memory is bounded, and frequent
    keys stay.
    """

    __slots__ = ("learn", "limit", "new", "old")

    def __init__(self, limit: int, learn: Callable[[list], Iterable]):
        self.limit, self.learn, self.new, self.old = limit, learn, {}, {}

    def holding(self, keys: set) -> dict:
        """A dict that has all of ``keys``; it holds until the next call."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        lack = keys.difference(self.new)
        if lack and self.old:
            kept = lack.intersection(self.old)
            self.new.update((k, self.old[k]) for k in kept)
            lack -= kept
        if lack:
            lack = list(lack)
            self.new.update(zip(lack, self.learn(lack), strict=True))
        return self.new


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in the worker process until another key is asked for.

    Workers outlive stages: the model of an earlier stage goes first, and its memory back to the system.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # only the GNU library has it
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)
        _HELD[key] = make()
    return _HELD[key]


def in_groups(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters or one longer text."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
