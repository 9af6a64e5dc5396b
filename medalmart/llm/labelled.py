"""A bounded sample of labelled texts to learn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Lists of tasks meet by the task's number modulo this, then those lists meet.
SALTS = 64


def smallest(rows: DataFrame, group: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """The ``k`` first rows of each group, in two steps, so that no task gets more than ``SALTS * k`` of a group in the last one.

    Every task of either step sends on ``k`` rows of a group at most.
    """
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = rows.withColumn("__salt", F.spark_partition_id() % SALTS).withColumn("__n", nth(group, "__salt")).where(F.col("__n") <= k)
    return some.withColumn("__n", nth(group)).where(F.col("__n") <= k).drop("__n", "__salt")


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, label`` of at most ``per_class`` documents of each label, those with the smallest key hashes.

    Only keys are ranked, so the texts of no other document move. Rows that are held out, or lack a
    key or label, are never read as labels; of several labels of a key the largest counts.
    """
    known = labels.where(~held_out).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    chosen = smallest(known, "label", (F.xxhash64("key"), "key"), per_class)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "key").groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("text").alias("text"))
