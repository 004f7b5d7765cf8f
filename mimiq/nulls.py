"""Missing values: NaN becomes NULL at the border, and only there NULL becomes NaN again.

Spark takes NaN for a value (averages become NaN, it sorts last), so no NaN may reach an aggregate.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLOATS = {"double", "float"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN turned to NULL."""
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t in _FLOATS else F.col(f"`{c}`") for c, t in df.dtypes])


def null_to_nan(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan")).cast(t)).alias(c) if t in _FLOATS else F.col(f"`{c}`") for c, t in df.dtypes])


def safe_log10(x: Column) -> Column:
    """log10 with -inf at 0 and NULL below.

    Spark's own log10 is off by a last bit in one of a hundred values against the C library's, which databases use; so this is the C library's.
    """

    def log10(v: pd.Series) -> pd.Series:
        return pd.Series([math.log10(y) if y > 0 else -math.inf if y == 0 else math.nan for y in v.tolist()], dtype="float64")

    return F.pandas_udf(log10, "double")(x.cast("double"))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b with IEEE results: signed infinity for x/0, NULL for 0/0."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, inf).when(a < 0, -inf)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
