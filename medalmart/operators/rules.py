"""Data-quality rules compiled to Column predicates over delivered (raw) values.

The outcome of all rules for a row is one BIGINT with a bit per rule. It is
computed once, is cheap to shuffle, and flag, handling and counts all derive
from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conform import ISO_DATE, compose_timestamp, matched_format, parse_date

# The issue codes a row may carry, in default order of priority.
FLAGS: tuple[str, ...] = (
    "NULL_REQUIRED",
    "TYPE_MISMATCH",
    "DATE_FORMAT",
    "CURRENCY_VARIANT",
    "ORPHANED_ACCOUNT",
    "DUPLICATE_DEDUPED",
)

# The handling names, those that take a row out of silver and
# gold first. FLAGGED keeps the row and only marks it.
DROPPING: tuple[str, ...] = ("QUARANTINED", "EXCLUDED_CAST_FAILED", "EXCLUDED_NULL_PK")
HANDLINGS: tuple[str, ...] = (
    *DROPPING,
    "DEDUPLICATED_KEEP_FIRST",
    "CAST_TO_DECIMAL",
    "NORMALISED_DATE",
    "NORMALISED_CURRENCY",
    "FLAGGED",
)

Resolver = Callable[[str], Column]
Test = Callable[[Resolver], Column]


@dataclass(frozen=True)
class Rule:
    """One issue type: which rows show it, the code they get and what becomes of them.

    ``test`` is None for issues that a join decides (see :meth:`RuleSet.set_bit`).
    ``columns`` are what the test reads; the rule is off for frames without them.
    """

    issue_type: str
    dq_flag: str | None
    handling: str
    test: Test | None = None
    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.dq_flag is not None and self.dq_flag not in FLAGS:
            raise ValueError(f"{self.issue_type}: unknown dq_flag {self.dq_flag!r}")
        if self.handling not in HANDLINGS:
            raise ValueError(f"{self.issue_type}: unknown handling {self.handling!r}")

    @property
    def drops(self) -> bool:
        return self.handling in DROPPING


def missing(*fields: str) -> Test:
    """Any of ``fields`` is null."""

    def test(col: Resolver) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | col(f).isNull()
        return out

    return test


def uncastable(field: str, data_type: str) -> Test:
    """A value is there but is not of the declared type."""
    return lambda col: col(field).isNotNull() & col(field).try_cast(data_type).isNull()


def quoted(field: str, kind: str, data_type: str) -> Test:
    """A number delivered as text that still reads as the declared type."""
    return lambda col: (col(kind) == "STRING") & col(field).try_cast(data_type).isNotNull()


def outside(field: str, allowed: Sequence[str]) -> Test:
    """A value is there but is not in the allowed list."""
    return lambda col: col(field).isNotNull() & ~col(field).isin(list(allowed))


def beyond(
    field: str, low: object = None, high: object = None, data_type: str = "double", formats: Sequence[str] = (ISO_DATE,)
) -> Test:
    """A readable value lies below ``low`` or above ``high``; a bound of None is open."""

    def test(col: Resolver) -> Column:
        value = parse_date(col(field), formats) if data_type == "date" else col(field).try_cast(data_type)
        out = F.lit(False)
        if low is not None:
            out = out | (value < F.lit(low).cast(data_type))
        if high is not None:
            out = out | (value > F.lit(high).cast(data_type))
        return F.coalesce(out, F.lit(False))

    return test


def other_format(fields: Sequence[str], formats: Sequence[str]) -> Test:
    """Some date is readable only by a configured format other than the first (the norm)."""

    def test(col: Resolver) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | F.coalesce(matched_format(col(f), formats) != F.lit(formats[0]), F.lit(False))
        return out

    return test


def unreadable_date(fields: Sequence[str], formats: Sequence[str] = (ISO_DATE,)) -> Test:
    """Some date is there but no configured format fits it."""

    def test(col: Resolver) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | (col(f).isNotNull() & parse_date(col(f), formats).isNull())
        return out

    return test


def uncomposable(date: str, time: str, formats: Sequence[str] = (ISO_DATE,)) -> Test:
    """Date and time of day are there, and the date is readable, but they make no timestamp."""

    def test(col: Resolver) -> Column:
        day = parse_date(col(date), formats)
        return day.isNotNull() & col(time).isNotNull() & compose_timestamp(day, col(time)).isNull()

    return test


def filled(field: str) -> Test:
    """The field holds something, such as the text of a line that could not be read."""
    return lambda col: col(field).isNotNull()


def differs(field: str, target: str) -> Test:
    """A value is there and is not the target."""
    return lambda col: F.coalesce(col(field) != F.lit(target), F.lit(False))


class RuleSet:
    """The rules of one table in bit order, with the priority of their codes."""

    def __init__(self, rules: Iterable[Rule], priority: Sequence[str] = FLAGS):
        self.rules = tuple(rules)
        self.priority = tuple(priority)
        names = [r.issue_type for r in self.rules]
        if len(names) != len(set(names)):
            raise ValueError(f"issue types must differ: {names}")
        if len(names) > 62:
            raise ValueError("at most 62 rules per table")
        if unknown := set(self.priority) - set(FLAGS):
            raise ValueError(f"unknown codes in priority: {sorted(unknown)}")
        used = {r.dq_flag for r in self.rules if r.dq_flag}
        if unranked := used - set(self.priority):
            raise ValueError(f"codes without a priority: {sorted(unranked)}")

    def bit(self, issue_type: str) -> int:
        for i, rule in enumerate(self.rules):
            if rule.issue_type == issue_type:
                return 1 << i
        raise KeyError(issue_type)

    def _active(self, df: DataFrame, resolve: Resolver | None) -> list[Rule]:
        have = set(df.columns)
        return [r for r in self.rules if r.test and (resolve or have.issuperset(r.columns))]

    def mask(self, df: DataFrame, resolve: Resolver | None = None, staying: bool = False) -> Column:
        """The row's bits for all rules that have a test and whose columns exist.

        With ``staying`` the dropping rules are passed over: their rows have
        been filtered out by :meth:`keeps`.
        """
        bits = F.lit(0)
        for rule in self._active(df, resolve):
            if not (staying and rule.drops):
                shown = rule.test(resolve or F.col)
                bits = bits + F.when(shown, F.lit(self.bit(rule.issue_type))).otherwise(0)
        return bits.cast("bigint")

    def keeps(self, df: DataFrame, resolve: Resolver | None = None) -> Column:
        """True for rows that no dropping rule with a test applies to.

        A filter on the mask would be pushed below it and evaluate every rule a
        second time; this reads the dropping rules only.
        """
        dropping = F.lit(False)
        for rule in self._active(df, resolve):
            if rule.drops:
                dropping = dropping | rule.test(resolve or F.col)
        return ~dropping

    def set_bit(self, mask: Column, issue_type: str, where: Column) -> Column:
        """``mask`` with the bit of a join-decided issue set where it applies."""
        return mask.bitwiseOR(F.when(where, F.lit(self.bit(issue_type))).otherwise(0).cast("bigint"))

    def _any(self, mask: Column, rules: Iterable[Rule]) -> Column:
        bits = 0
        for rule in rules:
            bits |= self.bit(rule.issue_type)
        return mask.bitwiseAND(F.lit(bits).cast("bigint")) != 0

    def shows(self, mask: Column, issue_type: str) -> Column:
        return self._any(mask, [r for r in self.rules if r.issue_type == issue_type])

    def dropped(self, mask: Column) -> Column:
        """True for rows that some rule takes out of silver and gold."""
        return self._any(mask, [r for r in self.rules if r.drops])

    def flag(self, mask: Column) -> Column:
        """The one code a row carries: the first by priority; null for a clean row."""
        cases = [
            F.when(self._any(mask, [r for r in self.rules if r.dq_flag == code]), F.lit(code))
            for code in self.priority
        ]
        return F.coalesce(*cases).cast("string")

    def handling(self, mask: Column) -> Column:
        """The handling that took the row out: the first dropping rule that applies."""
        cases = [F.when(self._any(mask, [r]), F.lit(r.handling)) for r in self.rules if r.drops]
        return F.coalesce(*cases, F.lit(None).cast("string"))

    def issues(self, mask: Column) -> Column:
        """All issue types of a row, as an array."""
        named = [F.when(self._any(mask, [r]), F.lit(r.issue_type)) for r in self.rules]
        return F.array_compact(F.array(*named))

    def counts(self, mask: Column) -> list[Column]:
        """One conditional count per issue type."""
        return [F.count_if(self._any(mask, [r])).alias(r.issue_type) for r in self.rules]


def issue_counts(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Rows per issue type as (issue_type, records_affected), counted in one pass."""
    mask = "__mask"
    wide = df.select(rules.mask(df).alias(mask)).agg(*rules.counts(F.col(mask)))
    return wide.unpivot([], [r.issue_type for r in rules.rules], "issue_type", "records_affected")


# What :func:`removed` adds to a row.
REMOVED = ("dq_flag", "dq_handling", "dq_issues")


def removed(df: DataFrame, rules: RuleSet, mask: str) -> DataFrame:
    """Rows that a rule takes out, with flag, handling and all their issues."""
    bits = F.col(mask)
    return (
        df.filter(rules.dropped(bits))
        .withColumns(
            {
                name: value
                for name, value in zip(REMOVED, (rules.flag(bits), rules.handling(bits), rules.issues(bits)), strict=True)
            }
        )
        .drop(mask)
    )
