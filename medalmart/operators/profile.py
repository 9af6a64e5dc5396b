"""Column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import exact_quantiles
from .sketches import approximate_quantiles


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and percentage per value of each column, nulls included.

    The total is a scalar subquery that reads no column, so that no window has
    to gather the groups.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 2).cast("double"))


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls and null percentage per column, counted in one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot(["__rows"], columns, "column_name", "null_rows")
    pct = F.when(F.col("__rows") > 0, F.round(F.col("null_rows") * 100.0 / F.col("__rows"), 2).cast("double"))
    return long.select("column_name", F.col("__rows").alias("row_count"), "null_rows", pct.alias("null_pct"))


def numeric_profile(
    df: DataFrame, columns: Sequence[str], points: Mapping[str, float] | None = None, exact: bool = True
) -> DataFrame:
    """Count, mean, standard deviation, extremes and quantiles per numeric column.

    ``exact`` quantiles need a sort; the others come from sketches in one more pass.
    """
    points = points or {"median": 0.5}
    per_column = []
    for c in columns:
        value = F.col(c).cast("double")
        per_column.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(value).alias("value_count"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("stddev"),
                F.min(value).alias("minimum"),
                F.max(value).alias("maximum"),
            )
        )
    moments = df.agg(F.array(*per_column).alias("c")).select(F.inline("c"))
    quantiles = exact_quantiles if exact else approximate_quantiles
    return moments.join(quantiles(df, columns, points), "column_name", "left")


def fan_out(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """How many parents have how many children, parents without any included.

    Children are counted per key before the join, so both of its sides have one
    row per key.
    """
    counts = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    per_parent = parent.select(F.col(parent_key).alias("__p")).join(counts, F.col("__p") == F.col("__k"), "left")
    return per_parent.groupBy(F.coalesce("__n", F.lit(0)).cast("bigint").alias("children")).agg(
        F.count(F.lit(1)).alias("parents")
    )
