"""Kernels over many small groups: one Python call per Arrow batch, not per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .frame import q


def map_groups(df: DataFrame, by: Sequence[str], order_by: Sequence[str], kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Rows dealt by ``by`` and sorted by it and ``order_by``; the kernel gets whole groups, many at once.

    It is called with rows and the bounds of groups in them (first rows, and the end). One group must fit in a worker.
    """
    by = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            keys = batch[by]
            same = (keys == keys.iloc[-1]) | (keys.isna() & keys.iloc[-1].isna())
            last = same.all(axis=1).to_numpy()
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                done = pd.concat([*held[:-1], batch.iloc[:cut]], ignore_index=True)
                held = [batch.iloc[cut:]]
                yield kernel(done, _bounds(done[by]))
        if held:
            done = pd.concat(held, ignore_index=True)
            yield kernel(done, _bounds(done[by]))

    dealt = df.repartition(*map(q, by)).sortWithinPartitions(*map(q, [*by, *order_by]))
    return dealt.mapInPandas(run, schema)


def _bounds(keys: pd.DataFrame) -> np.ndarray:
    before = keys.shift()
    new = ((keys != before) & ~(keys.isna() & before.isna())).any(axis=1).to_numpy()
    new[0] = True
    return np.append(np.flatnonzero(new), len(keys))
