"""Run configuration, data model and rules, read from YAML on the driver."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from .functions.conform import ISO_DATE
from .operators import rules as R
from .operators.shape import as_struct

DEFAULTS = Path(__file__).parent / "defaults"

# Where readers put the text of a line that they can't read.
CORRUPT = "_corrupt_record"

# The environment variable and the places searched for each file.
CONFIG_VARIABLE = "PIPELINE_CONFIG"
SEARCH_DIRS = ("/data/config", "/app/config")


def _read(candidates: Iterable[str | os.PathLike[str] | None], what: str) -> dict[str, Any]:
    tried = [str(c) for c in candidates if c]
    for path in tried:
        if os.path.isfile(path):
            return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    raise FileNotFoundError(f"{what} not found; looked for {tried}")


def load_config(path: str | None = None, search: Iterable[str] = SEARCH_DIRS) -> dict[str, Any]:
    """The run configuration: ``path``, else $PIPELINE_CONFIG, else the search folders."""
    places = [f"{d}/pipeline_config.yaml" for d in search]
    return _read([path, os.environ.get(CONFIG_VARIABLE), *places], "pipeline_config.yaml")


def load_dq_rules(config: Mapping[str, Any], search: Iterable[str] = SEARCH_DIRS) -> dict[str, Any]:
    """The rules at ``dq.rules_path``, else in the search folders."""
    places = [f"{d}/dq_rules.yaml" for d in search]
    return _read([(config.get("dq") or {}).get("rules_path"), *places], "dq_rules.yaml")


@dataclass(frozen=True)
class Link:
    """A reference from a table to the key of another, and what it brings along.

    ``linked`` is the boolean column that tells whether the key was found;
    ``carry`` maps new columns to columns of the other table.
    """

    field: str
    table: str
    column: str
    linked: str
    carry: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    """A source and its silver shape."""

    name: str
    gold: str
    input: str
    format: str
    schema: str
    key: list[str]
    order: list[str] = field(default_factory=list)
    flatten: dict[str, list[str]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    timestamps: dict[str, list[str]] = field(default_factory=dict)
    names: dict[str, list[str]] = field(default_factory=dict)
    link: Link | None = None

    @property
    def columns(self) -> list[str]:
        return as_struct(self.schema).names


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    key: str
    surrogate: str
    contract: str
    rename: dict[str, str] = field(default_factory=dict)
    bands: dict[str, str] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)
    members: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Fact:
    name: str
    table: str
    key: str
    surrogate: str
    contract: str
    references: dict[str, dict[str, str]]
    agree: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    """All tables, dimensions and facts of a mart, in build order."""

    tables: dict[str, Table]
    dimensions: dict[str, Dimension]
    facts: dict[str, Fact]

    @classmethod
    def load(cls, path: str | os.PathLike[str] | None = None) -> Model:
        doc = _read([path or DEFAULTS / "model.yaml"], "model")
        tables = {}
        for name, spec in doc["tables"].items():
            link = Link(**spec.pop("link")) if spec.get("link") else None
            if link and link.table not in tables:
                raise ValueError(f"{name} links to {link.table}, which must come before it")
            tables[name] = Table(name=name, link=link, **spec)
        dims = {n: Dimension(name=n, **s) for n, s in (doc.get("dimensions") or {}).items()}
        facts = {n: Fact(name=n, **s) for n, s in (doc.get("facts") or {}).items()}
        return cls(tables, dims, facts)


@dataclass(frozen=True)
class TableRules:
    """What the rule file says about one table."""

    rules: R.RuleSet
    formats: dict[str, list[str]]
    constants: dict[str, str]
    orphan: str | None
    orphan_drops: bool
    duplicate: str
    flag_survivors: bool


def default_rules() -> dict[str, Any]:
    return _read([DEFAULTS / "dq_rules.yaml"], "dq_rules.yaml")


def flat_columns(table: Table) -> list[str]:
    """Column names of the source once structs are flattened and variants split."""
    out = []
    for f in as_struct(table.schema).fields:
        if f.name in table.flatten:
            out += table.flatten[f.name]
        elif isinstance(f.dataType, T.VariantType):
            out += [f.name, f"{f.name}_kind"]
        else:
            out.append(f.name)
    return out


def _section(doc: Mapping[str, Any], name: str, table: Table) -> Any:
    section = doc.get(name) or {}
    return section.get(table.gold) or section.get(table.name) or {}


def compile_rules(doc: Mapping[str, Any], table: Table) -> TableRules:
    """The rules of ``table``. Options left out of the file take the documented defaults."""
    columns = set(flat_columns(table))
    out: list[R.Rule] = []

    silent = set(_section(doc, "unchecked", table) or [])
    if CORRUPT not in silent:
        spec = doc.get("corrupt_records") or {}
        out.append(
            R.Rule(
                spec.get("issue_type", "corrupt_record") + f"_{table.name}",
                spec.get("dq_flag", "TYPE_MISMATCH"),
                spec.get("handling", "QUARANTINED"),
                R.filled(CORRUPT),
                (CORRUPT,),
            )
        )

    null_key = _section(doc, "null_keys", table) or {"issue_type": f"null_{table.key[0]}"}
    out.append(
        R.Rule(
            null_key["issue_type"],
            "NULL_REQUIRED",
            null_key.get("handling", "EXCLUDED_NULL_PK"),
            R.missing(*table.key),
            tuple(table.key),
        )
    )

    nulls = _section(doc, "null_checks", table)
    if isinstance(nulls, list):
        nulls = {"fields": nulls}
    fields = [f for f in nulls.get("fields") or [] if f in columns and f not in table.key]
    if fields:
        out.append(
            R.Rule(
                nulls.get("issue_type", "null_required"),
                nulls.get("dq_flag", "NULL_REQUIRED"),
                nulls.get("handling", "FLAGGED"),
                R.missing(*fields),
                tuple(fields),
            )
        )

    dates = doc.get("date_format_checks") or {}
    if isinstance(dates, list):
        dates = {"fields": dates}
    dates = {**dates, **(_section(dates, "per_table", table) or {})}
    formats = list(dates.get("formats") or [ISO_DATE])
    dated = [f for f in dates.get("fields") or [] if f in columns and table.types.get(f) == "date"]

    for name, spec in _section(doc, "type_checks", table).items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        kind = spec["type"]
        if name in dated or name not in columns or kind in ("date", "timestamp"):
            continue
        kind = table.types.get(name, kind) if kind == "decimal" else kind
        code = spec.get("dq_flag", "TYPE_MISMATCH")
        if f"{name}_kind" in columns:
            out.append(
                R.Rule(
                    spec.get("issue_type", f"{name}_type_mismatch"),
                    code,
                    spec.get("handling", "CAST_TO_DECIMAL"),
                    R.quoted(name, f"{name}_kind", kind),
                    (name, f"{name}_kind"),
                )
            )
        out.append(
            R.Rule(
                spec.get("failed_issue_type", f"{name}_cast_failed"),
                code,
                spec.get("failed_handling", "EXCLUDED_CAST_FAILED"),
                R.uncastable(name, kind),
                (name,),
            )
        )

    # A value that silver can't type is lost there, so every typed column has a rule unless told otherwise.
    options = _section(doc, "type_checks", table)
    option = lambda name: o if isinstance(o := options.get(name), dict) else {}
    for name, kind in table.types.items():
        if name in dated or name not in columns or name in silent or name in options and kind != "date":
            continue
        date = kind == "date"
        out.append(
            R.Rule(
                option(name).get("issue_type", f"{name}_unreadable" if date else f"{name}_cast_failed"),
                option(name).get("dq_flag", "DATE_FORMAT" if date else "TYPE_MISMATCH"),
                option(name).get("handling", "FLAGGED"),
                R.unreadable_date([name]) if date else R.uncastable(name, kind),
                (name,),
            )
        )
    for name, (date, time) in table.timestamps.items():
        if name not in silent and {date, time} <= columns:
            out.append(
                R.Rule(
                    option(name).get("issue_type", f"{name}_uncomposable"),
                    option(name).get("dq_flag", "DATE_FORMAT"),
                    option(name).get("handling", "QUARANTINED"),
                    R.uncomposable(date, time, formats if date in dated else [ISO_DATE]),
                    (date, time),
                )
            )

    for name, spec in (doc.get("domain_checks") or {}).items():
        if name in columns and spec.get("table", table.name) in (table.name, table.gold):
            out.append(
                R.Rule(
                    spec.get("issue_type", f"{name}_domain"),
                    spec.get("dq_flag", "TYPE_MISMATCH"),
                    spec.get("handling", "FLAGGED"),
                    R.outside(name, spec["allowed"]),
                    (name,),
                )
            )

    for name, spec in (doc.get("range_checks") or {}).items():
        if name in columns and spec.get("table", table.name) in (table.name, table.gold):
            out.append(
                R.Rule(
                    spec.get("issue_type", f"{name}_range"),
                    spec.get("dq_flag", "TYPE_MISMATCH"),
                    spec.get("handling", "FLAGGED"),
                    R.beyond(name, spec.get("low"), spec.get("high"), spec.get("type", "double"), formats if name in dated else [ISO_DATE]),
                    (name,),
                )
            )

    if dated:
        code = dates.get("dq_flag", "DATE_FORMAT")
        out.append(
            R.Rule(
                dates.get("issue_type", "date_format_inconsistency"),
                code,
                dates.get("handling", "NORMALISED_DATE"),
                R.other_format(dated, formats),
                tuple(dated),
            )
        )
        out.append(
            R.Rule(
                dates.get("failed_issue_type", "date_unreadable"),
                code,
                dates.get("failed_handling", "QUARANTINED"),
                R.unreadable_date(dated, formats),
                tuple(dated),
            )
        )

    constants: dict[str, str] = {}
    currency = doc.get("currency_normalisation") or {}
    money = currency.get("field", "currency")
    if currency and money in columns:
        constants[money] = currency["target_value"]
        if currency.get("flag_variants", True):
            out.append(
                R.Rule(
                    currency.get("issue_type", "currency_variants"),
                    currency.get("dq_flag", "CURRENCY_VARIANT"),
                    currency.get("handling", "NORMALISED_CURRENCY"),
                    R.differs(money, currency["target_value"]),
                    (money,),
                )
            )

    orphan, orphan_drops = None, False
    for spec in _section(doc, "referential_integrity", table) or []:
        if table.link and spec["field"] == table.link.field:
            orphan = spec.get("issue_type", "orphaned_transactions")
            out.append(R.Rule(orphan, spec.get("dq_flag"), spec.get("handling", "QUARANTINED")))
            orphan_drops = out[-1].drops

    dedup = _section(doc, "deduplication", table) or {}
    duplicate = dedup.get("issue_type", f"duplicate_{table.name}")
    flag_survivors = bool(dedup.get("flag_survivors", False))
    out.append(
        R.Rule(
            duplicate,
            "DUPLICATE_DEDUPED" if flag_survivors else None,
            dedup.get("handling", "DEDUPLICATED_KEEP_FIRST"),
        )
    )

    return TableRules(
        rules=R.RuleSet(out, doc.get("priority") or R.FLAGS),
        formats={f: formats for f in dated},
        constants=constants,
        orphan=orphan,
        orphan_drops=orphan_drops,
        duplicate=duplicate,
        flag_survivors=flag_survivors,
    )
