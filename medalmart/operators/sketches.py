"""Quantiles from mergeable sketches: one pass, no sort, no table in between.

Each task folds its values into a KLL sketch of a few kilobytes, and sketches are merged. They can be
stored for each delivery or group and merged later, so that quantiles over many deliveries need no
second look at the rows. :func:`medalmart.operators.runs.exact_quantiles` is the exact way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch, between 8 and 65535.
SIZE = 2000


def rank_error(size: int = SIZE) -> float:
    """How far, as a share of all values, the rank of a sketched quantile is off at most, in 99 of 100 cases.

    The published error of KLL sketches; 0.24 percent for the usual size. A value is never made up:
    each quantile is one of the values seen, and up to ``size`` values are kept whole.
    """
    return 2.296 / size**0.9021


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``*by, column_name, sketch`` of numeric columns; null and NaN are no values. No value, no sketch."""
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    sketches = [F.kll_sketch_agg_double(value(c), F.lit(size)).alias(f"s{i}") for i, c in enumerate(columns)]
    seen = [F.count(value(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    each = df.groupBy(*by).agg(*sketches, *seen)
    long = [F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")).alias("sketch")) for i, c in enumerate(columns)]
    return each.select(*by, F.inline(F.array(*long))).where("sketch IS NOT NULL")


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch for each value of ``by`` and column, of stored ones."""
    return sketches.groupBy(*by, "column_name").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """The sketches' number of values and quantiles, a column for each point."""
    others = [c for c in sketches.columns if c != "sketch"]
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in points.items()]
    return sketches.select(*others, F.kll_sketch_get_n_double("sketch").alias("value_count"), *at)


def approximate_quantiles(df: DataFrame, columns: Sequence[str], points: Mapping[str, float], size: int = SIZE) -> DataFrame:
    """``column_name`` and a column for each point, as the exact way gives, within :func:`rank_error`."""
    return sketched_quantiles(quantile_sketches(df, columns, (), size), points).drop("value_count")
