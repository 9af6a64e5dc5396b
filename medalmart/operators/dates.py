"""Which date format a column has, by all of its values.

``03/04/2024`` is a day in two formats. A value that only one of them can read, as ``25/04/2024``,
settles its column; where no value or values of both kinds are found, the column is told and its
ambiguous values are not guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conform import parse_date

SETTLED, INDIFFERENT, UNSETTLED, MIXED, UNREAD = "SETTLED", "INDIFFERENT", "UNSETTLED", "MIXED", "UNREAD"


def _readings(column: str, formats: Sequence[str]) -> list[Column]:
    return [parse_date(column, [f]) for f in formats]


def date_evidence(df: DataFrame, columns: Sequence[str], formats: Sequence[str]) -> DataFrame:
    """``column_name, format, alone, read, differing, any`` from one pass over the columns.

    ``alone`` counts values that no other format reads as a day, ``read`` those that this one reads,
    ``differing`` those among them that another one reads as another day, ``any`` those that some
    format reads. One row is aggregated.
    """
    counts, names = [], []
    for c in columns:
        days = _readings(c, formats)
        for k, (f, day) in enumerate(zip(formats, days, strict=True)):
            others = [d for i, d in enumerate(days) if i != k]
            alone, differs = F.lit(True), F.lit(False)
            for d in others:
                alone, differs = alone & d.isNull(), differs | (d.isNotNull() & (d != day))
            tests = (day.isNotNull() & alone, day.isNotNull(), day.isNotNull() & differs, F.coalesce(*days).isNotNull())
            counts += [F.count_if(t).alias(f"n{len(names)}_{i}") for i, t in enumerate(tests)]
            names.append((c, f))
    one = df.agg(*counts)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("format"), *[F.col(f"n{k}_{i}").alias(n) for i, n in enumerate(("alone", "read", "differing", "any"))]) for k, (c, f) in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def settle(evidence: DataFrame) -> DataFrame:
    """``column_name, verdict, format, ambiguous`` of every column in the evidence.

    SETTLED: some values can be read in one format alone, none in another alone, and every other one
    in it too. INDIFFERENT: all formats that read anything agree on all days. UNSETTLED: values differ
    and none settles them. MIXED: values of several formats. UNREAD: no value is a day. ``ambiguous``
    counts values that differ and aren't settled.
    """
    wide = evidence.groupBy("column_name").agg(
        F.count_if(F.col("alone") > 0).alias("kinds"),
        F.max_by("format", F.struct(F.col("alone") > 0, "read", "format")).alias("format"),
        F.max("differing").alias("differing"),
        F.max(F.struct(F.col("alone") > 0, "read"))["read"].alias("read"),
        F.max("any").alias("any"),
    )
    verdict = (
        F.when(F.col("any") == 0, UNREAD)
        .when((F.col("kinds") > 1) | (F.col("kinds") == 1) & (F.col("read") < F.col("any")), MIXED)
        .when(F.col("kinds") == 1, SETTLED)
        .when(F.col("differing") > 0, UNSETTLED)
        .when(F.col("read") < F.col("any"), MIXED)
        .otherwise(INDIFFERENT)
    )
    open_ = F.col("verdict").isin(MIXED, UNSETTLED)
    return wide.withColumn("verdict", verdict).select(
        "column_name",
        "verdict",
        F.when(F.col("verdict").isin(SETTLED, INDIFFERENT), F.col("format")).alias("format"),
        F.when(open_, F.col("differing")).otherwise(0).cast("bigint").alias("ambiguous"),
    )


def settled_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str]) -> dict[str, str | None]:
    """The format of each column, None where it can't be settled. As many rows as columns reach the driver."""
    found = {r.column_name: r.format for r in settle(date_evidence(df, columns, formats)).collect()}
    return {c: found.get(c) for c in columns}


def parsed_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str], always: Sequence[str] = (), suffix: str = "_ambiguous") -> DataFrame:
    """``df`` with its date columns parsed: formats in ``always`` first, then the one that its values settle.

    Where they don't, a value is read if all formats that read it mean the same day; if they differ it
    is null and ``<column>_ambiguous`` is true.
    """
    chosen = settled_formats(df, columns, formats)
    out = {}
    for c in columns:
        first = parse_date(c, list(always)) if always else F.lit(None).cast("date")
        days = [parse_date(c, [chosen[c]])] if chosen[c] else _readings(c, formats)
        low, high = (days[0], days[0]) if len(days) == 1 else (F.least(*days), F.greatest(*days))
        out[f"{c}{suffix}"] = F.coalesce(first.isNull() & (low != high), F.lit(False))
        out[c] = F.coalesce(first, F.when(low == high, low))
    return df.withColumns(out)
