"""Surrogate keys that outlive a delivery: a stored registry, and a way out for colliding hashes.

A registry is a folder of batches, each a table of natural key, number and first sight. A delivery
appends one batch with the keys that no earlier one holds. Numbers are never changed or reused.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import HEX_DIGITS, LEVELS, WIDE_DIGITS, WIDE_LEVELS, hash_key
from ..sources.scratch import scratch_path
from ..sources.writers import stored_batches, write_batch, write_table
from .lookup import lookup
from .runs import dense_keys

NATURAL, NUMBER, SEEN = "natural_key", "surrogate_key", "first_seen"


def read_registry(spark: SparkSession, path: str, key_type: str = "string", fmt: str = "parquet") -> DataFrame:
    """All batches as ``natural_key, surrogate_key, first_seen``; no rows if there is no batch yet."""
    schema = f"{NATURAL} {key_type}, {NUMBER} bigint, {SEEN} timestamp"
    batches = stored_batches(spark, path)
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(batches)


def unregistered(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` lacks, as ``natural_key``; null is no key."""
    keys = df.select(F.col(key).alias(NATURAL)).where(F.col(NATURAL).isNotNull()).distinct()
    return keys.join(known.select(NATURAL), NATURAL, "left_anti")


def next_numbers(fresh: DataFrame, known: DataFrame, at: dt.datetime) -> DataFrame:
    """New registry rows: the keys of ``fresh`` in their order, numbered on from the largest number of ``known``."""
    last = known.agg(F.coalesce(F.max(NUMBER), F.lit(0)).alias("last")).first()["last"]
    numbered = dense_keys(fresh, [NATURAL], NUMBER)
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return numbered.select(NATURAL, (F.col(NUMBER) + F.lit(last)).cast("bigint").alias(NUMBER), F.lit(at.isoformat()).cast("timestamp").alias(SEEN))


def register(df: DataFrame, key: str, path: str, at: dt.datetime, fmt: str = "parquet") -> DataFrame:
    """The registry at ``path`` with all keys of ``df``; what it lacked is appended as one batch.

    A batch becomes visible by a rename once it is whole, so a failed delivery leaves nothing behind,
    and the same delivery again finds all its keys and appends nothing. One delivery writes at a time.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    known = read_registry(spark, path, kind, fmt)
    fresh = unregistered(df, key, known)
    # Many deliveries bring no new key.
    if not fresh.isEmpty():
        write_batch(next_numbers(fresh, known, at), path, fmt)
        known = read_registry(spark, path, kind, fmt)
    return known


def numbered(df: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """``df`` with the registered number of ``key`` as ``name``; null where there is none."""
    return lookup(df, known, (key, NATURAL), {name: NUMBER})


def collisions(df: DataFrame, key: str, digits: int = HEX_DIGITS, widen: bool = False) -> DataFrame | None:
    """``natural_key, surrogate_key`` of the keys whose hash a smaller key has too; None if there is none.

    Of keys with one hash the smallest keeps it. The others get a key beyond all plain hashes: the
    hash of the next range (of :data:`LEVELS`), and where these meet again, of the range after that.
    So a moved key's number is a function of the key and of its level, and the same in every run in which it
    moves as often. Each range settles no more keys than there are hashes. With ``widen``, keys that still
    meet after the last range get a hash of :data:`WIDE_DIGITS` digits in a part of the ranges that the short
    hashes leave free, so that any number of keys is settled in a few passes; without it they are an error.

    Hashes are grouped with their least and greatest key, which is all that happens where no hash is
    shared. Only keys of shared hashes are looked at again; n keys have about n * n / 2**61 of them.
    """
    spark = df.sparkSession

    def kept(frame: DataFrame) -> tuple[DataFrame, int]:
        path = scratch_path(spark, "collisions")
        n = write_table(frame, path)["rows"]
        return spark.read.schema(frame.schema).parquet(path), n

    last = LEVELS + WIDE_LEVELS if widen and digits <= WIDE_DIGITS else LEVELS
    moving, level, settled = df.select(F.col(key).alias(NATURAL)).where(F.col(NATURAL).isNotNull()), 0, []
    while True:
        hashed = moving.withColumn("h", hash_key(NATURAL, digits=digits, level=level))
        groups = hashed.groupBy("h").agg(F.min(NATURAL).alias("least"), F.max(NATURAL).alias("most"))
        shared, n = kept(groups.where("least < most").select("h", "least"))
        if level:
            settled.append(groups.select(F.col("least").alias(NATURAL), F.col("h").alias(NUMBER)))
        if not n:
            return reduce(DataFrame.unionByName, settled) if settled else None
        if level == last:
            raise ValueError(f"keys still share a hash of {digits} digits after {last} ranges")
        met = hashed.join(shared, "h").where(F.col(NATURAL) > F.col("least")).select(NATURAL)
        moving, _ = kept(met if level else met.distinct())
        level += 1


def resolved(df: DataFrame, key: str, name: str, moved: DataFrame | None, digits: int = HEX_DIGITS) -> DataFrame:
    """``df`` with the hash key of ``key`` as ``name``, or the number that :func:`collisions` gave it."""
    plain = hash_key(key, digits=digits)
    if moved is None:
        return df.withColumn(name, plain)
    other = "__moved"
    return lookup(df, moved, (key, NATURAL), {other: NUMBER}).withColumn(name, F.coalesce(other, plain)).drop(other)
