"""Deterministic deduplication on a natural key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_null(keys: Sequence[str]) -> Column:
    """True where at least one key column is null."""
    test = F.lit(False)
    for k in keys:
        test = test | F.col(k).isNull()
    return test


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a whole key, and rows without one.

    Null keys are not equal to each other, so they must not be deduplicated,
    and as one window group they would also all meet in a single task.
    """
    return df.filter(~any_null(keys)), df.filter(any_null(keys))


def total_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[Column]:
    """Sort columns that leave no ties but between identical rows."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    for c in [*order, *rest]:
        if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)):
            raise ValueError(f"column {c} has no order; store it as text before deduplicating")
    return [F.asc_nulls_last(c) for c in order] + [F.asc_nulls_first(c) for c in rest]


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), mark: str | None = None
) -> DataFrame:
    """One row per key: the first by ``order``, ties broken by every other column.

    Spark turns the rank filter into a group limit that already runs before the
    shuffle, so a key with very many copies sends at most one row per input task
    (two with ``mark``) and never fills a task. ``mark`` names a boolean column
    that tells whether the key had further copies.
    """
    rank = "__rank"
    w = Window.partitionBy(*keys).orderBy(*total_order(df, keys, order))
    ranked = df.withColumn(rank, F.row_number().over(w))
    if mark is None:
        return ranked.filter(F.col(rank) == 1).drop(rank)
    # The same window again finds the rows distributed and sorted already.
    first_two = ranked.filter(F.col(rank) <= 2).withColumn(mark, F.lead(rank).over(w).isNotNull())
    return first_two.filter(F.col(rank) == 1).drop(rank)


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of copies and of surplus rows.

    A counting aggregate with map-side combine: only keys and counts move.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .withColumn("surplus", F.col("copies") - 1)
    )


def surplus_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), removed: str = "removed"
) -> DataFrame:
    """What :func:`keep_first` drops: each distinct content with its number of removed copies.

    Only rows of repeated keys go on, by a join with one row a key. Identical
    rows are counted together, then the kept content of each key gives back one
    copy. Counts stand for copies throughout, so a key or a single content with
    very many copies is never gathered in one task.
    """
    columns = df.columns
    repeated = duplicate_groups(df, keys).select(*keys)
    same = reduce(and_, [F.col(f"__all.{k}").eqNullSafe(F.col(f"__repeated.{k}")) for k in keys])
    df = df.alias("__all").join(repeated.alias("__repeated"), same, "left_semi")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(removed))
    kept = keep_first(df, keys, order).withColumn(removed, F.lit(-1).cast("bigint"))
    return (
        counted.unionByName(kept)
        .groupBy(*columns)
        .agg(F.sum(removed).alias(removed))
        .filter(F.col(removed) > 0)
    )
