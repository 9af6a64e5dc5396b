"""Gold: dimensions and facts with surrogate keys, exactly as their contracts say."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Dimension, Fact
from ..functions.bands import band, whole_years
from ..operators.lookup import lookup
from ..operators.registry import numbered, resolved
from ..operators.runs import dense_keys
from ..operators.shape import align, project


def _keyed(df: DataFrame, key: str, surrogate: str, keys: str, known: DataFrame | None) -> DataFrame:
    """``known``: the registered keys, or those that collisions moved."""
    if keys == "hash":
        return resolved(df, key, surrogate, known)
    if keys == "registry":
        if known is None:
            raise ValueError(f"no registered keys for {surrogate!r}")
        return numbered(df, key, known, surrogate)
    if keys == "dense":
        return dense_keys(df, [key], surrogate)
    raise ValueError(f"unknown kind of surrogate key {keys!r}")


def dimension_frame(silver: DataFrame, dim: Dimension, run_date: dt.date, keys: str = "hash", known: DataFrame | None = None) -> DataFrame:
    """A dimension: surrogate key, renames, bands and the contract's columns."""
    out = _keyed(silver, dim.key, dim.surrogate, keys, known)
    out = out.withColumns({b: band(whole_years(source, run_date)) for b, source in dim.bands.items()})
    out = out.withColumnsRenamed(dim.rename)
    return project(align(out, dim.contract), dim.contract)


def resolved_keys(
    account: DataFrame, account_cols: tuple[str, str, str], party: DataFrame, party_cols: tuple[str, str]
) -> DataFrame:
    """Account key -> (account surrogate, party surrogate), one row per account.

    ``account_cols`` are key, surrogate and party key of the account dimension,
    ``party_cols`` key and surrogate of the party dimension. Joining the two
    dimensions first spares the fact its second join.
    """
    key, surrogate, owner = account_cols
    return lookup(account.select(key, surrogate, owner), party, (owner, party_cols[0]), {party_cols[1]: party_cols[1]})


def fact_frame(silver: DataFrame, fact: Fact, dims: Mapping[str, DataFrame], specs: Mapping[str, Dimension], keys: str = "hash", known: Mapping[str, DataFrame | None] | None = None) -> DataFrame:
    """The fact: surrogate key, the dimensions' surrogates and the contract's columns.

    Silver has linked the rows already, and a hash key is a function of the
    natural key, so linked rows need no join here at all, but for keys that collisions moved. Dense and
    registered keys are looked up. ``known`` has registered or moved keys by dimension and fact.
    """
    known = known or {}
    out = _keyed(silver, fact.key, fact.surrogate, keys, known.get(fact.name))
    for name, ref in fact.references.items():
        dim = specs[ref["dimension"]]
        if keys == "hash" and ref["linked"] in silver.columns:
            out = resolved(out, ref["field"], name, known.get(dim.name)).withColumn(name, F.when(F.col(ref["linked"]), F.col(name)))
        else:
            out = lookup(out, dims[dim.name], (ref["field"], dim.key), {name: dim.surrogate})
    return project(align(out, fact.contract), fact.contract)
