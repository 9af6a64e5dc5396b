"""Bronze: sources as they arrived, with the run's timestamp."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Table, TableRules
from ..operators.rules import Resolver
from ..sources.readers import UNDECLARED, read_csv, read_jsonl

STAMP = "ingestion_timestamp"
MASK = "__issues"


def stamp(df: DataFrame, at: dt.datetime, name: str = STAMP) -> DataFrame:
    """Append one and the same instant to every row. Naive times are taken as UTC."""
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return df.withColumn(name, F.lit(at.isoformat()).cast("timestamp"))


def bronze_frame(spark: SparkSession, table: Table, path: str, at: dt.datetime) -> DataFrame:
    """The source at ``path`` as raw columns plus the stamp."""
    if table.format == "csv":
        raw = read_csv(spark, path, table.schema)
    elif table.format == "json":
        raw = read_jsonl(spark, path, table.schema)
    else:
        raise ValueError(f"{table.name}: no reader for format {table.format!r}")
    return stamp(raw, at)


def nested_columns(table: Table) -> Resolver:
    """Find a flattened column in the still nested bronze frame."""
    paths = {f: f"{s}.{f}" for s, fields in table.flatten.items() for f in fields}

    def resolve(name: str) -> Column:
        return F.col(paths.get(name, name))

    return resolve


def write_bronze(df: DataFrame, table: Table, rules: TableRules, write: Callable[..., dict[str, int]]) -> dict[str, int]:
    """Write the layer table by ``write(df, metrics, helpers)`` and return its row count and the rows per issue type.

    The rules are evaluated while the source passes by; the bits are not stored.
    Source, rules and write are one stage without a shuffle, unless the table is stored by key.
    """
    masked = df.withColumn(MASK, rules.rules.mask(df, nested_columns(table)))
    bits = F.col(MASK)
    dropped = F.count_if(rules.rules.dropped(bits)).alias("dropped")
    extra = F.count(F.col(UNDECLARED)) if UNDECLARED in df.columns else F.count_if(F.lit(False))
    return write(masked, [dropped, extra.alias(UNDECLARED), *rules.rules.counts(bits)], [MASK])
