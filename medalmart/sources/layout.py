"""Layer tables that are stored by key, so that joins and counts by the key move none of their rows.

Such a table has two parts. Rows of ordinary keys lie in buckets, dealt by hash of the key when they
are written. Rows without a key, and those of keys with a large share of all rows, lie apart, spread
over all tasks, as no bucket could hold them. No key is in both parts, so what is worked out key by
key is worked out for each part. The hot part meets a broadcast of its few keys' partners.

Tables that are joined with each other must have the same number of buckets. A mark in the folder
tells key, buckets, hot keys and schema; readers that don't know it see a partitioned table.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import estimated_bytes, hot_keys, key_counts, lookup, unmatched
from .writers import DRAFT, TRANSACTIONAL, Store, replace_table, restore

#: Bytes of a bucket to aim at, as the optimizer estimates them, and the fewest and most buckets.
BUCKET_BYTES, FEWEST, MOST = 256 << 20, 8, 8192
HOT, DEAL, MARK = "__hot", "__deal", "_stored_by_key"


@dataclass(frozen=True)
class ByKey:
    """A table stored by ``key``. ``frame`` reads it as a whole, ``cold`` and ``hot`` its parts."""

    key: str
    buckets: int
    hot_keys: tuple
    frame: DataFrame
    cold: DataFrame
    hot: DataFrame

    @property
    def keyed(self) -> DataFrame:
        """The rows with a key: from the buckets alone if no key is hot, as in a table of unique keys."""
        return self.frame if self.hot_keys else self.cold


def buckets_for(*tables: DataFrame, packed: int = 1) -> int:
    """Number of buckets for tables that are joined with each other: by the largest, a power of two.

    ``packed`` tells how many bytes one of the tables' files stands for, see :func:`~.readers.packing`.
    """
    largest = max(estimated_bytes(t) for t in tables) * packed
    n = FEWEST
    while n < MOST and n * BUCKET_BYTES < largest:
        n *= 2
    return n


def _elsewhere(spread_by: Sequence[str], kind: T.DataType) -> Column:
    """A value of the key's type that spreads hot rows over the buckets' tasks, the same in every attempt."""
    values = [*spread_by, F.spark_partition_id()]
    if isinstance(kind, T.StringType):
        return F.xxhash64(*values).cast("string")
    if isinstance(kind, T.LongType):
        return F.xxhash64(*values)
    if isinstance(kind, T.IntegerType):
        return F.hash(*values)
    raise ValueError(f"no table can be stored by a key of type {kind.simpleString()}")


def write_by_key(
    df: DataFrame, path: str, key: str, buckets: int, spread_by: Sequence[str],
    hot: Sequence | None = None, fmt: str = "parquet", metrics: Sequence[Column] = (), helpers: Sequence[str] = (),
) -> dict[str, Any]:
    """Replace the table at ``path`` by ``df``, stored by ``key``; returns what ``write_table`` does.

    One shuffle; one task writes one bucket, and its part of the hot rows, which are dealt by
    ``spread_by``. ``hot`` lists the hot keys where they are known (none, if keys are unique);
    otherwise a count by key finds those with more than a thousandth of all rows.
    Files are written beside their place and take it by a rename; a failed job leaves the last table.
    """
    if fmt in TRANSACTIONAL:
        raise ValueError(f"{fmt} tables can't be stored by key")
    spark = df.sparkSession
    if hot is None:
        hot = [r[0] for r in hot_keys(key_counts(df, key), key).collect()]
    known = sorted(v for v in hot if v is not None)
    apart = F.col(key).isNull() | F.col(key).isin(known)
    dealt = df.withColumn(HOT, apart).withColumn(DEAL, F.when(F.col(HOT), _elsewhere(spread_by, df.schema[key].dataType)).otherwise(F.col(key)))
    dealt = dealt.repartition(buckets, DEAL)
    seen, rows = Observation(), [c for c in df.columns if c not in helpers]
    observed = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).select(*[f"`{c}`" for c in rows], HOT)
    store, draft, name = Store(spark, path), path + DRAFT, f"draft_{uuid.uuid4().hex}"
    store.delete(draft)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in observed.schema if f.name != HOT])
    _declare(spark, name, schema, key, buckets, draft, fmt, partitioned=True)
    try:
        observed.write.insertInto(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
    for part in _folders(draft):
        store.make(part)
    told = {"written": uuid.uuid4().hex, "key": key, "buckets": buckets, "hot": known, "format": fmt, "schema": schema.jsonValue()}
    store.put(f"{draft}/{MARK}", json.dumps(told))
    before = _mark(spark, path)
    replace_table(spark, draft, path)
    if before:
        spark.sql(f"DROP TABLE IF EXISTS {_name(before)}")
    return dict(seen.get)


def read_by_key(spark: SparkSession, path: str) -> ByKey | None:
    """The table at ``path`` if it is stored by key, else None. The session's catalogue gets to know its buckets."""
    restore(spark, path)
    told = _mark(spark, path)
    if told is None:
        return None
    schema, name = T.StructType.fromJson(told["schema"]), _name(told)
    cold, hot = _folders(path)
    _declare(spark, name, schema, told["key"], told["buckets"], cold, told["format"])
    plain = spark.read.schema(schema).format(told["format"])
    return ByKey(told["key"], told["buckets"], tuple(told["hot"]), plain.load([cold, hot]), spark.table(name), plain.load(hot))


def linked(big: ByKey, small: ByKey, small_key: str, values: Mapping[str, str], found: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """:func:`lookup` of ``small``, whose keys are unique, by the key of ``big``; no row of ``big`` moves.

    ``prepare`` is done to the rows of ``big`` before.
    """
    on = (big.key, small_key)
    # No more rows than hot keys, which are fewer than a thousand.
    partners = small.frame.where(F.col(small_key).isin(list(big.hot_keys)))
    cold = lookup(prepare(big.cold), small.keyed, on, values, found, hot=())
    return cold.unionByName(lookup(prepare(big.hot), partners, on, values, found, limit=sys.maxsize))


def unlinked_keys(child: ByKey, parent: ByKey, parent_key: str, n: str = "n", prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """:func:`unmatched` for tables stored by key: only counts of hot keys move."""
    each = [unmatched(prepare(part), child.key, known, parent_key, n) for part, known in ((child.cold, parent.keyed), (child.hot, parent.frame))]
    return each[0].unionByName(each[1])


def _folders(path: str) -> tuple[str, str]:
    return f"{path}/{HOT}=false", f"{path}/{HOT}=true"


def _mark(spark: SparkSession, path: str) -> dict | None:
    text = Store(spark, path).text(f"{path}/{MARK}")
    return None if text is None else json.loads(text)


def _name(told: Mapping[str, Any]) -> str:
    """Another name for every write, so that no session meets an old listing of files."""
    return f"by_key_{hashlib.md5(told['written'].encode()).hexdigest()}"


def _declare(spark: SparkSession, name: str, schema: T.StructType, key: str, buckets: int, path: str, fmt: str, partitioned: bool = False) -> None:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"`{HOT}` boolean"] * partitioned
    parts = f"PARTITIONED BY (`{HOT}`) " if partitioned else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING {fmt} {parts}CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
