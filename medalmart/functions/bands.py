"""Age in whole years and banding by descending thresholds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of a year in the age rule, and the age bands, each with
# its lowest age.
DAYS_PER_YEAR = 365.25
AGE_BANDS: tuple[tuple[int, str], ...] = (
    (18, "18-25"),
    (26, "26-35"),
    (36, "36-45"),
    (46, "46-55"),
    (56, "56-65"),
    (65, "65+"),
)


def whole_years(since: str | Column, until: dt.date) -> Column:
    """Completed years from ``since`` to ``until``, by the 365.25-day year."""
    days = F.date_diff(F.lit(until), F.col(since) if isinstance(since, str) else since)
    return F.floor(days / F.lit(DAYS_PER_YEAR)).cast("int")


def band(value: Column, bands: Sequence[tuple[int, str]] = AGE_BANDS) -> Column:
    """Label of the highest band whose lower bound ``value`` reaches, else null."""
    labels = [F.when(value >= low, F.lit(label)) for low, label in sorted(bands, reverse=True)]
    return F.coalesce(*labels)
