"""What several operators share: tables, stored intermediate results, column clashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from medalmart.sources.scratch import drop_path, scratch_path

#: Rows of keys and numbers (some hundred bytes each at most) up to which a stored frame is broadcast.
FEW_ROWS = 10_000
#: For rows of some MB. Parquet holds 100 rows of a file before it first looks at their size, and readers take a row group's
#: rows at once; so a task would need memory for as many rows as it has.
WIDE = {"parquet.block.size": 32 << 20} | {f"parquet.{of}.size.row.check.{end}": 1 for of in ("block", "page") for end in ("min", "max")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str, options: Mapping[str, int] | None = None) -> DataFrame:
    """The frame written to the shared folder and read back: cuts its lineage, survives lost executors.

    Its ``rows`` are counted by the write. ``options`` are the writer's, as :data:`WIDE`.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**options or {}).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at, out.rows = path, seen.get["rows"]
    return out


def met(frame: DataFrame) -> DataFrame:
    """A stored frame of short rows as the small side of a join: broadcast if it has few rows, else merged."""
    return F.broadcast(frame) if frame.rows <= FEW_ROWS else frame.hint("merge")


def discard(*frames: DataFrame | None) -> None:
    """Remove stored frames that nothing reads any more."""
    for f in frames:
        if f is not None:
            drop_path(f.sparkSession, f.stored_at)


def without(frame: DataFrame, names: Iterable[str]) -> list[Column]:
    """The frame's columns, without those whose name (in any case) a result column needs."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c.replace('`', '``')}`") for c in frame.columns if c.lower() not in taken]


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``limit``; never an empty range."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
