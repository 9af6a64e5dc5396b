"""Source scans. Each file is parsed once, with a schema that is known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CORRUPT
from ..functions.conform import variant_kind, variant_text
from ..operators.shape import align, as_struct
from .layout import read_by_key
from .writers import restore

#: Fields of a JSON line that the schema does not declare: name -> value as text.
UNDECLARED = "_undeclared"

#: Endings of compressed text files, and the bytes of text that one of theirs is taken for.
COMPRESSED, PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst"), 8


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, every column as text.

    Names come from the header (one line is read for them), so added or
    reordered columns cannot shift values; a further file whose header differs
    fails the read. ``schema`` adds the columns that are absent. Lines with too
    few or too many fields keep their text in ``_corrupt_record``.
    """
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in names]
    df = (
        spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    return df if schema is None else align(df, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON, one object a line, without an inference pass; each line is read once.

    Fields declared VARIANT come back as text that keeps the delivered digits,
    with a ``<name>_kind`` column telling a number from a quoted one. Fields that
    are not declared come with names and values in the map ``_undeclared``. A
    line that is no JSON, or holds a value of another type than declared, keeps
    its whole text in ``_corrupt_record``.
    """
    want = as_struct(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*want.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT})
    known = F.array(*[F.lit(f.name) for f in want.fields])
    rest = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~F.array_contains(known, k))
    df = lines.select(parsed.alias("line"), F.when(F.size(rest) > 0, rest).alias(UNDECLARED)).select("line.*", UNDECLARED)
    return df.select(*split_variants(want), F.col(CORRUPT), F.col(UNDECLARED))


def packing(text: DataFrame) -> int:
    """About how many bytes of text a byte of the frame's files stands for; the optimizer's estimate is of files."""
    return PACKED if any(f.endswith(COMPRESSED) for f in text.inputFiles()) else 1


def undeclared_fields(df: DataFrame) -> DataFrame:
    """``field, rows``: all undeclared fields of a JSON source. Names are data and may be any number."""
    names = df.where(F.col(UNDECLARED).isNotNull()).select(F.explode(F.map_keys(UNDECLARED)).alias("field"))
    return names.groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def split_variants(schema: T.StructType) -> list:
    """Columns of ``schema`` with each VARIANT written as text and kind."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.VariantType):
            out += [variant_text(f.name).alias(f.name), variant_kind(f.name).alias(f"{f.name}_kind")]
        else:
            out.append(F.col(f.name))
    return out


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A layer table; the last one, if a job died while replacing it."""
    restore(spark, path)
    by_key = read_by_key(spark, path)
    return by_key.frame if by_key else spark.read.format(fmt).load(path)
