"""Surrogate keys that depend on nothing but the natural key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number of leading hex digits of the digest kept as the key.
# Fifteen digits are 60 bits, so the key is always a non-negative BIGINT.
HEX_DIGITS = 15

# Ranges of keys beyond the plain hashes, each as large as theirs, for keys whose hash another key has.
RANGE, LEVELS = 1 << 60, 7

# Beyond the ranges, for shorter hashes only: slices that these leave free, each for a hash of WIDE_DIGITS.
WIDE_DIGITS = 14
WIDE = 1 << 4 * WIDE_DIGITS
WIDE_LEVELS = (LEVELS + 1) * (RANGE // WIDE - 1)


def _escaped(part: Column) -> Column:
    text = F.replace(part.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def hash_key(*parts: str | Column, digits: int = HEX_DIGITS, level: int = 0) -> Column:
    """BIGINT surrogate key of a natural key of one or more columns.

    One column is hashed as its plain text. Several are joined with ``|`` after
    escaping, so that ``('a|b', 'c')`` and ``('a', 'b|c')`` stay apart. A null
    part gives a null key. ``digits`` shortens the hash. A ``level`` above 0 hashes the level with the
    text, into the range of that level. Levels above :data:`LEVELS`, of which there are
    :data:`WIDE_LEVELS`, have a hash of :data:`WIDE_DIGITS` in a free part of one of the ranges; ``digits``
    may not be more.
    """
    start = level * RANGE
    if level > LEVELS:
        if digits > WIDE_DIGITS or level > LEVELS + WIDE_LEVELS:
            raise ValueError(f"no level {level} for a hash of {digits} digits")
        wide = level - LEVELS - 1
        # The first slice of each range holds its short hashes.
        start, digits = wide % (LEVELS + 1) * RANGE + (wide // (LEVELS + 1) + 1) * WIDE, WIDE_DIGITS
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    if len(cols) == 1:
        text = cols[0].cast("string")
    else:
        pieces = [_escaped(cols[0])]
        for c in cols[1:]:
            pieces += [F.lit("|"), _escaped(c)]
        text = F.concat(*pieces)
    if level:
        text = F.concat(F.lit(f"{level}|"), text)
    number = F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint")
    return number + F.lit(start) if level else number
