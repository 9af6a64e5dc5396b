"""Schema alignment, struct flattening and contract projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_struct(schema: T.StructType | str) -> T.StructType:
    """A schema given as DDL text or as a ``StructType``."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


@dataclass(frozen=True)
class Drift:
    """How delivered columns differ from the expected ones."""

    missing: tuple[str, ...]
    extra: tuple[str, ...]

    def __bool__(self) -> bool:
        return bool(self.missing or self.extra)


def drift(df: DataFrame, schema: T.StructType | str) -> Drift:
    """Names expected but absent, and names present but not expected."""
    want = [f.name for f in as_struct(schema)]
    have = df.columns
    return Drift(tuple(c for c in want if c not in have), tuple(c for c in have if c not in want))


def align(df: DataFrame, schema: T.StructType | str, keep_extra: bool = True) -> DataFrame:
    """Put the expected columns first and in order, absent ones as typed nulls.

    Present columns keep their own type; unexpected ones follow, or go when
    ``keep_extra`` is off. :func:`drift` tells which they were.
    """
    fields = as_struct(schema).fields
    have = set(df.columns)
    out = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    if keep_extra:
        names = {f.name for f in fields}
        out += [F.col(c) for c in df.columns if c not in names]
    return df.select(*out)


def flatten(df: DataFrame, structs: Mapping[str, Sequence[str]], prefix: bool = False) -> DataFrame:
    """Lift the listed fields of each struct column to the top and drop the struct.

    Structs the frame lacks are passed over; a listed field the struct lacks
    becomes a null text column. A name that is already taken, or every name when
    ``prefix`` is on, is written ``struct_field``.
    """
    taken = {c for c in df.columns if c not in structs}
    out = [F.col(c) for c in df.columns if c not in structs]
    for name, wanted in structs.items():
        if name not in df.columns:
            continue
        present = {f.name for f in df.schema[name].dataType.fields}
        for field in wanted:
            label = f"{name}_{field}" if prefix or field in taken else field
            taken.add(label)
            value = F.col(f"{name}.{field}") if field in present else F.lit(None).cast("string")
            out.append(value.alias(label))
    return df.select(*out)


def project(df: DataFrame, contract: T.StructType | str) -> DataFrame:
    """Exactly the contract's columns, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in as_struct(contract)])


def schema_report(df: DataFrame, contract: T.StructType | str) -> DataFrame:
    """One row per expected or found column: position, types and whether they agree.

    Work on metadata only; the row count is the number of columns.
    """
    want = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(as_struct(contract), 1)}
    have = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)}
    rows = []
    for name in list(want) + [c for c in have if c not in want]:
        wi, wt = want.get(name, (None, None))
        hi, ht = have.get(name, (None, None))
        rows.append((name, wi, hi, wt, ht, (wi, wt) == (hi, ht)))
    session: SparkSession = df.sparkSession
    return session.createDataFrame(
        rows,
        "column_name string, expected_position int, found_position int, "
        "expected_type string, found_type string, conforms boolean",
    )
