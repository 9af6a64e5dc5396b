"""Type conformance. Only ``try_`` functions, so bad input yields null under ANSI."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern dates are normalised to.
ISO_DATE = "yyyy-MM-dd"

# Fixed value: the times of day that ``HH:mm:ss`` reads.
DAY_TIME = r"\A([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parse(text: Column, fmt: str) -> Column:
    if fmt != ISO_DATE:
        return F.try_to_date(text, fmt)
    # The cast is several times faster than a pattern but also reads looser
    # spellings; only text that the date prints back as is fits the pattern.
    # Of texts of ten characters that is told by three of them; printing takes longer.
    date = text.try_cast("date")
    dashes = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & F.substring(text, 10, 1).between("0", "9")
    plain = F.octet_length(text) == 10
    return F.when(F.when(plain, dashes).otherwise(date.cast("string") == text), date)


def parse_date(text: str | Column, formats: Sequence[str] = (ISO_DATE,)) -> Column:
    """Date by the first of ``formats`` that fits the whole text, else null."""
    return F.coalesce(*[_parse(_col(text), f) for f in formats])


def matched_format(text: str | Column, formats: Sequence[str] = (ISO_DATE,)) -> Column:
    """The format that :func:`parse_date` used, else null."""
    return F.coalesce(*[F.when(_parse(_col(text), f).isNotNull(), F.lit(f)) for f in formats])


def compose_timestamp(date: Column, time: Column, pattern: str = f"{ISO_DATE} HH:mm:ss") -> Column:
    """Instant of a DATE and a time-of-day text, both in UTC whatever the session's zone; null if either is missing or bad."""
    parsed = F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), time, F.lit("+00:00")), F.lit(f"{pattern}xxx"))
    if pattern != f"{ISO_DATE} HH:mm:ss":
        return parsed
    # Sums are several times faster than the pattern, which remains for all but plain days and times.
    hours, minutes, seconds = (F.substring(time, i, 2).cast("bigint") for i in (1, 4, 7))
    summed = F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86400 + hours * 3600 + minutes * 60 + seconds)
    plain = time.rlike(DAY_TIME) & date.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
    return F.when(plain, summed).otherwise(parsed)


def folded_name(text: str | Column) -> Column:
    """A name without differences of case and spacing."""
    return F.lower(F.regexp_replace(F.trim(_col(text)), r"\s+", " "))


def canonical_name(
    text: str | Column, names: Sequence[str], aliases: Mapping[str, str] | None = None
) -> Column:
    """Canonical spelling of ``text`` ignoring case and spacing; unknown text is kept.

    The names are a configured enumeration and live in the plan as a literal
    map, so no join is involved.
    """
    known = {n.lower(): n for n in names} | {a.lower(): n for a, n in (aliases or {}).items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, folded_name(text)), _col(text))


def variant_text(value: str | Column) -> Column:
    """Text of a scalar VARIANT exactly as it was delivered, digits included."""
    return F.try_variant_get(_col(value), "$", "string")


def variant_kind(value: str | Column) -> Column:
    """``NUMBER``, ``STRING`` or another JSON type of a VARIANT; null if it holds nothing."""
    kind = F.schema_of_variant(_col(value))
    number = F.lit(False)
    for prefix in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"):
        number = number | kind.startswith(prefix)
    return F.when(number, F.lit("NUMBER")).when(kind != F.lit("VOID"), kind)
