"""Misspelt names: the one known name within a few edits, ties told.

Two texts within ``distance`` edits become equal when at most ``distance`` letters are struck from
each. So every known name is entered under all its strikings, a value looks up all of its own, and
the true edit distance settles what met. No value is compared with every name, and only distinct
values are looked at, however many rows carry them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conform import folded_name
from .lookup import lookup


def strikings(name: str, distance: int) -> set[str]:
    """``name`` and what is left of it when up to ``distance`` letters are struck."""
    return {"".join(c for i, c in enumerate(name) if i not in gone) for k in range(min(distance, len(name)) + 1) for gone in combinations(range(len(name)), k)}


def _struck(name: Column, distance: int) -> Column:
    """The same as an array column."""
    out = F.array(name)
    for _ in range(distance):
        shorter = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def near_names(values: DataFrame, column: str, known: Sequence[str], distance: int = 1) -> DataFrame:
    """Every distinct value of ``column`` as ``value, name, edits, near``.

    ``name`` is the known name with the fewest edits, within ``distance``; null if none is as near or
    two are equally near, and then ``near`` lists them. Case and spaces are folded before. The known
    names are configuration; values are grouped before anything else.
    """
    spark = values.sparkSession
    entries = [(s, n, folded) for n in known for folded in [" ".join(n.split()).lower()] for s in strikings(folded, distance)]
    table = spark.createDataFrame(entries, "__key string, __name string, __folded string")
    distinct = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    folded = distinct.withColumn("__value", folded_name(F.col("value")))
    met = folded.select("value", "__value", F.explode(_struck(F.col("__value"), distance)).alias("__key")).join(F.broadcast(table), "__key")
    edits = met.withColumn("__edits", F.levenshtein("__value", "__folded")).where(F.col("__edits") <= distance)
    best = edits.groupBy("value").agg(F.min("__edits").alias("edits"), F.sort_array(F.collect_set(F.struct("__edits", "__name"))).alias("__met"))
    near = F.transform(F.filter("__met", lambda m: m["__edits"] == F.col("edits")), lambda m: m["__name"])
    told = best.select("value", "edits", near.alias("near")).withColumn("name", F.when(F.size("near") == 1, F.element_at("near", 1)))
    return distinct.join(told, "value", "left").select("value", "name", "edits", "near")


def corrected(df: DataFrame, column: str, known: Sequence[str], distance: int = 1, tied: str = "name_tied", changed: str = "name_corrected") -> DataFrame:
    """``df`` with near values of ``column`` replaced by their known name, and what happened to them.

    ``changed`` is true where letters were corrected, ``tied`` where two names are equally near and
    the value stays as it is. Values that no name is near stay too.
    """
    found = near_names(df, column, known, distance).select("value", F.coalesce("name", "value").alias("__name"), (F.col("edits") > 0).alias("__changed"), (F.size("near") > 1).alias("__tied"))
    out = lookup(df, found, (column, "value"), {"__to": "__name", "__off": "__changed", "__two": "__tied"})
    flags = {tied: F.coalesce("__two", F.lit(False)), changed: F.coalesce(F.col("__off") & ~F.col("__two"), F.lit(False))}
    return out.withColumn(column, F.coalesce("__to", F.col(column))).withColumns(flags).drop("__to", "__off", "__two")
