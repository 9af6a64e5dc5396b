"""Silver: typed, linked, deduplicated and flagged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Table, TableRules
from ..functions.conform import ISO_DATE, canonical_name, compose_timestamp, parse_date
from ..operators.dedup import keep_first
from ..operators.lookup import fits_broadcast, hot_keys_of, lookup, unmatched
from ..operators.rules import removed
from ..operators.shape import flatten
from ..sources.layout import ByKey, linked, unlinked_keys
from ..sources.readers import CORRUPT, UNDECLARED
from .bronze import MASK

COPIES = "__copies"


def typed(df: DataFrame, table: Table, rules: TableRules) -> DataFrame:
    """Declared types, composed timestamps, canonical names and constants, in one projection."""
    new: dict[str, Column] = {}
    for name, data_type in table.types.items():
        if data_type == "date":
            new[name] = parse_date(name, rules.formats.get(name, [ISO_DATE]))
        else:
            new[name] = F.col(name).try_cast(data_type)
    for name, (date, time) in table.timestamps.items():
        new[name] = compose_timestamp(new[date], F.col(time))
    for name, known in table.names.items():
        new[name] = canonical_name(name, known)
    for name, value in rules.constants.items():
        new[name] = F.lit(value)
    return df.withColumns(new) if new else df


def link(df: DataFrame, table: Table, rules: TableRules, parent: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Resolve the table's reference; rows without a partner show the orphan issue.

    A null reference is a missing value and not an orphan.
    """
    to = table.link
    out = lookup(df, parent, (to.field, to.column), to.carry, found=to.linked, hot=hot)
    return mark_orphans(out, table, rules, ~F.col(to.linked))


def mark_orphans(df: DataFrame, table: Table, rules: TableRules, unmatched_key: Column) -> DataFrame:
    if rules.orphan is None:
        return df
    orphan = F.col(table.link.field).isNotNull() & unmatched_key
    return df.withColumn(MASK, rules.rules.set_bit(F.col(MASK), rules.orphan, orphan))


def orphan_keys(bronze: DataFrame, table: Table, parent: DataFrame, by_key: tuple[ByKey, ByKey] | None = None) -> DataFrame:
    """Reference values of the source that the parent lacks, with their source rows."""
    if by_key:
        return unlinked_keys(*by_key, table.link.column, prepare=lambda rows: flatten(rows, table.flatten))
    flat = flatten(bronze, table.flatten)
    return unmatched(flat, table.link.field, parent, table.link.column)


def silver_frame(
    bronze: DataFrame, table: Table, rules: TableRules, parent: DataFrame | None = None, by_key: tuple[ByKey, ByKey] | None = None,
    hot: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The silver rows, with the helper columns ``__issues`` and ``__copies`` for metrics.

    Rows that cannot stay leave first (without a shuffle), so they neither travel
    nor win over a good copy. Then one lookup and one deduplication shuffle.
    ``by_key`` are ``bronze`` and ``parent`` if both are stored by the link's key; the lookup then moves no row.
    ``hot`` are the hot keys of the link's column, where they come cheaper than by counting them in ``bronze``.
    ``settle`` gets the linked rows if the lookup shuffles them, and returns them stored, so that this shuffle and
    the deduplication's don't fill the disk at once.
    """

    def remaining(rows: DataFrame) -> DataFrame:
        flat = flatten(rows, table.flatten).drop(UNDECLARED)
        return flat.filter(rules.rules.keeps(flat)).withColumn(MASK, rules.rules.mask(flat, staying=True))

    to = table.link
    if parent is None or to is None:
        staying = remaining(bronze)
    else:
        if by_key:
            staying = mark_orphans(linked(*by_key, to.column, to.carry, to.linked, remaining), table, rules, ~F.col(to.linked))
        else:
            if hot is None:
                hot = hot_keys_of(flatten(bronze, table.flatten), to.field)
            staying = link(remaining(bronze), table, rules, parent, hot)
        if rules.orphan_drops:
            staying = staying.filter(F.col(to.field).isNull() | F.col(to.linked))
        if settle and not by_key and not fits_broadcast(parent.select(to.column, *to.carry.values())):
            staying = settle(staying)
    first = keep_first(typed(staying, table, rules), table.key, table.order, mark=COPIES)
    bits = F.col(MASK)
    if rules.flag_survivors:
        bits = rules.rules.set_bit(bits, rules.duplicate, F.col(COPIES))
    helpers = {MASK, COPIES, CORRUPT, *[f"{c}_kind" for c in table.types]}
    kept = [c for c in first.columns if c not in helpers]
    return first.select(*kept, rules.rules.flag(bits).alias("dq_flag"), bits.alias(MASK), COPIES)


def removed_rows(
    bronze: DataFrame, table: Table, rules: TableRules, orphans: DataFrame | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Source rows that were taken out, still raw, with flag, handling and issues.

    ``orphans`` are the keys from :func:`orphan_keys`. As long as they are few
    this is one pass without a shuffle. ``hot`` is as in :func:`silver_frame`.
    """
    flat = flatten(bronze, table.flatten)
    if orphans is None:
        gone = flat.filter(~rules.rules.keeps(flat))
        return removed(gone.withColumn(MASK, rules.rules.mask(flat)), rules.rules, MASK)
    found, field = "__orphan", table.link.field
    out = lookup(flat, orphans, (field, field), {}, found=found, hot=hot)
    out = out.filter(F.col(found) | ~rules.rules.keeps(flat)).withColumn(MASK, rules.rules.mask(flat))
    out = mark_orphans(out, table, rules, F.col(found)).drop(found)
    return removed(out, rules.rules, MASK)
