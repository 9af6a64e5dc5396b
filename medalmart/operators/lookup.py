"""Key lookups from a large table into a smaller one, safe against hot and null keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot when it holds more than one in HOT_SHARE of all rows. At most
# HOT_SHARE keys can do so, which bounds what is broadcast for them.
HOT_SHARE = 1000

# Keys are dealt to so many buckets to find the hot ones. An average bucket holds far less than a hot key.
HOT_BUCKETS = 16384


def broadcast_limit(df: DataFrame) -> int:
    """The session's own limit for broadcasting, in bytes; 0 when it is switched off."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return max(0, int(conf.autoBroadcastJoinThreshold()))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for the frame."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame, limit: int | None = None, size: int | None = None) -> bool:
    """Whether ``size`` (default: the estimate) stays within ``limit`` (default: the session's)."""
    bound = broadcast_limit(df) if limit is None else limit
    return (estimated_bytes(df) if size is None else size) <= bound


def key_counts(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rows per key value, null included. Reads one column and combines before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(n))


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than one in ``share`` of the counted rows (fewer than ``share``), and null."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter((F.col(n) * share > total) | F.col(key).isNull()).select(key)


def hot_keys_of(df: DataFrame, key: str, share: int = HOT_SHARE, buckets: int = HOT_BUCKETS) -> DataFrame:
    """The same as :func:`hot_keys` of the :func:`key_counts` of ``df``, without counting every key.

    A hot key makes the bucket of its hash hot. Only buckets are counted and shuffled at first, so what moves
    does not grow with the number of keys; then the keys of hot buckets are counted, if there are any.
    """
    place, n = F.col("__place"), F.col("n")
    keys = df.select(key, F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets))).alias("__place"))
    counts = key_counts(keys, "__place")
    total = counts.agg(F.sum("n")).scalar()
    # Tests of the place alone would be pushed below the counts, and then the three would not share one pass.
    full = counts.filter(F.when(place.isNotNull(), n) * share > total).select("__place")
    empty = counts.filter(F.when(place.isNull(), n) > 0).select(F.lit(None).cast(df.schema[key].dataType).alias(key))
    held = key_counts(keys.join(F.broadcast(full), "__place", "left_semi"), key)
    return held.filter(n * share > total).select(key).unionByName(empty)


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: tuple[str, str],
    values: Mapping[str, str],
    found: str | None = None,
    limit: int | None = None,
    hot: DataFrame | Sequence | None = None,
    size: int | None = None,
) -> DataFrame:
    """Left join that adds ``values`` (new name -> column of ``small``) to every row of ``big``.

    ``on`` is the key in ``big`` and the key in ``small``, which must be unique
    there. ``found`` names a boolean column telling whether there was a partner.

    A ``small`` within the size limit is broadcast and ``big`` does not move.
    Beyond it both sides are shuffled by key. Where no key is hot, rows without a
    key are dealt over all tasks, and ``big`` is read once. Where keys are hot,
    their rows and those without a key stay where they are, and the hot ones are
    answered from a broadcast of just their keys' partners; ``big`` is read twice. :func:`hot_keys_of`, of which
    fewer than :data:`HOT_SHARE` values reach the driver, tells the hot keys.
    ``hot`` passes them where they are known or come cheaper from a stored table
    than from ``big``; any set of keys gives the same result. ``size`` bounds the
    bytes of ``small`` where the caller knows better than the optimizer, which
    takes joins for products.
    """
    key, small_key = on
    names = list(values)
    if dict(big.dtypes)[key] != dict(small.dtypes)[small_key]:
        raise ValueError(f"{key} and {small_key} differ in type")
    partner = "__partner"
    narrow = small.filter(F.col(small_key).isNotNull()).select(
        F.col(small_key).alias("__key"),
        F.struct(*[F.col(c).alias(v) for v, c in values.items()], F.lit(True).alias("__found")).alias(partner),
    )
    same = F.col(key) == F.col("__key")
    if fits_broadcast(narrow, limit, size):
        joined = big.join(F.broadcast(narrow), same, "left")
    else:
        found_hot = hot_keys_of(big, key) if hot is None else hot
        settled = [r[0] for r in found_hot.select(key).collect()] if isinstance(found_hot, DataFrame) else list(found_hot)
        if not settled:
            joined = big.join(narrow, same, "left")
        elif settled == [None]:
            joined = _dealt_join(big, key, narrow)
        else:
            joined = _split_join(big, key, narrow, settled)
    answer = F.col(partner)
    out = [F.col(c) for c in big.columns] + [answer.getField(v).alias(v) for v in names]
    if found:
        out.append(F.coalesce(answer.getField("__found"), F.lit(False)).alias(found))
    return joined.select(*out)


def _dealt_join(big: DataFrame, key: str, narrow: DataFrame) -> DataFrame:
    """One shuffle by key and place. A row without a key gets a place by its values and partition, the same in every attempt."""
    place, place_of = "__place", "__place_of"
    values = [F.col(f"`{f.name}`") for f in big.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    anywhere = F.xxhash64(*values, F.spark_partition_id())
    dealt = big.withColumn(place, F.when(F.col(key).isNull(), anywhere).otherwise(F.xxhash64(key)))
    same = (F.col(key) == F.col("__key")) & (F.col(place) == F.col(place_of))
    return dealt.join(narrow.withColumn(place_of, F.xxhash64("__key")), same, "left")


def _split_join(big: DataFrame, key: str, narrow: DataFrame, settled: list) -> DataFrame:
    values = [v for v in settled if v is not None]
    hot_partners = F.broadcast(narrow.filter(F.col("__key").isin(values)))
    here = F.col(key).isNull() | F.col(key).isin(values)
    there = F.col(key).isNotNull() & ~F.col(key).isin(values)
    same = F.col(key) == F.col("__key")
    staying = big.filter(here).join(hot_partners, same, "left")
    return staying.unionByName(big.filter(there).join(narrow, same, "left"))


def unmatched(child: DataFrame, key: str, parent: DataFrame, parent_key: str, n: str = "n") -> DataFrame:
    """Key values of ``child`` that ``parent`` lacks, with their number of rows.

    The child rows are counted per key first, so the anti-join meets each key
    once and neither side is skewed. Null keys are no references and not counted.
    """
    counts = key_counts(child.filter(F.col(key).isNotNull()), key, n)
    known = parent.select(F.col(parent_key).alias("__known"))
    return counts.join(known, F.col(key) == F.col("__known"), "left_anti")
