"""Sorted runs on disk: dense numbering and exact quantiles without a one-task sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

RUN = "__run"
POSITION = "__position"

# Layout of monotonically_increasing_id: the partition number above the low 33
# bits, the row's place within the partition in them.
PLACE_BITS = 33


def sorted_runs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows range-partitioned and sorted by ``by``, with run number and place in the run.

    Runs are written to the shared scratch folder and read back: numbering must
    not change between the uses of the result, and a written table also outlives
    lost executors. Runs follow each other in order of ``by``.
    """
    path = scratch_path(df.sparkSession, "runs")
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    placed.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    run = F.shiftright("__id", PLACE_BITS)
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return stored.withColumns({RUN: run, POSITION: place}).drop("__id")


def run_totals(runs: DataFrame, total: Column, within: Sequence[str] = ()) -> DataFrame:
    """Per run the total, and the running total of the runs before it.

    One row per run (and value of ``within``), which is what the window holds.
    """
    before = Window.partitionBy(*within).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy(*within, RUN).agg(total.alias("__total"))
    return sums.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0).cast("bigint")))


def dense_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number the rows 1..n in order of ``keys``, which must be unique and not null.

    Same result as ``row_number() over (order by keys)``; the work is one range
    shuffle, one write and one count per run.
    """
    runs = sorted_runs(df, keys)
    # One row per run, and there are no more runs than shuffle partitions.
    offsets = F.broadcast(run_totals(runs, F.count(F.lit(1))).select(RUN, "__before"))
    numbered = runs.join(offsets, RUN).withColumn(name, F.col("__before") + F.col(POSITION) + 1)
    return numbered.select(*df.columns, name)


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles of numeric columns as (column_name, one column per point).

    Equal values are counted together first; their runs tell which run holds
    each wanted rank, and only those runs are looked into.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counted = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    runs = sorted_runs(counted, ["column_name", "value"])
    per_run = run_totals(runs, F.sum("n"), ["column_name"])
    # Positions are zero-based: a quantile lies between the two ranks around p*(n-1).
    totals = per_run.groupBy("column_name").agg(F.sum("__total").alias("__rows"))
    wanted = totals.select(
        "column_name",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("point"), ((F.col("__rows") - 1) * F.lit(p)).alias("at")) for k, p in points.items()])
        ).alias("w"),
    ).select("column_name", "w.point", "w.at")
    wanted = wanted.select(
        "column_name", "point", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")
    )
    # Columns x points x 2 ranks, each joined to the one run that holds it.
    holders = per_run.join(F.broadcast(wanted), "column_name").filter(
        (F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__total"))
    )
    inside = runs.join(
        F.broadcast(holders.select("column_name", RUN, "__before").distinct()), ["column_name", RUN]
    )
    upto = Window.partitionBy("column_name", RUN).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("__last", F.col("__before") + F.sum("n").over(upto) - 1).withColumn(
        "__first", F.col("__last") - F.col("n") + 1
    )
    hit = ranked.join(F.broadcast(holders.select("column_name", RUN, "point", "at", "rank")), ["column_name", RUN]).filter(
        F.col("rank").between(F.col("__first"), F.col("__last"))
    )
    ends = hit.groupBy("column_name", "point", "at").agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
    part = F.col("at") - F.floor("at")
    value = F.col("low") + (F.col("high") - F.col("low")) * part
    return ends.groupBy("column_name").agg(*[F.max(F.when(F.col("point") == k, value)).alias(k) for k in points])
