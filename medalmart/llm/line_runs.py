"""Deletion of repeated runs of lines, by distributed prefix doubling over line ids.

A text is the sequence of the ids (128-bit hashes) of its lines, trimmed, blank lines left out. Two
suffixes of these sequences are tied at depth d if their first d lines are equal. Prefix doubling
names the ties: a suffix's name at depth 2 d is made of its own name at depth d and that of the
suffix d lines on. Only suffixes that are still tied with another go on, so tables shrink from
depth to depth, until nothing is tied.

Then the way back, by steps of half the length, finds each suffix's longest common prefix with an
earlier one. A group tied at depth d is asked whether it is tied a step further on, too. Of those that
are, all but the earliest leave for the deeper group; the earliest stays, too, as it may be what the others of
the shallower group repeat. What is left at the last step is tied with the earliest of its group, and
no deeper. A prefix that all of its group have after the same line is part of a longer run and is
left out. So the maximal repeated runs remain, each with its earliest original; their lines are deleted.

Names stand for ranks: groups need equality only, so no global order is built. A group may
hold a third of all suffixes. It is counted, and its earliest suffix found, before the shuffle.

Defined results: earlier means a smaller key, then the smaller hash of the text, then the earlier
line; a null key comes last; rows with equal key and text are one document and keep the same lines;
null and empty texts have no lines; blank lines stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Lines that a repeated run has at least: a single line counts, so one-line documents and passages on one line go too.
MIN_LINES = 1
RUNS = "array<struct<line: bigint, lines: bigint, from_key: {0}, from_line: bigint>>"


def content(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def named(n1: Column, n2: Column, m1: Column, m2: Column) -> list[Column]:
    return [F.xxhash64(n1, m1, m2).alias("n1"), F.xxhash64(n2, m2, m1).alias("n2")]


def ties(names: DataFrame) -> DataFrame:
    """The suffixes (doc, pos, prior, n1, n2) with the number of those of their name, the earliest of them, and if they follow different lines or none."""
    varied = (F.count("prior") < F.count("*")) | (F.min("prior") != F.max("prior"))
    counts = names.groupBy("n1", "n2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first"), varied.alias("varied"))
    return names.join(counts, ["n1", "n2"])


def later() -> Column:
    return F.struct("doc", "pos") > F.col("first")


def tied_levels(docs: DataFrame, key: str, text: str) -> list[DataFrame]:
    """The suffixes tied at depth 1, 2, 4 and so on, as long as there are any; lines count from 0."""
    own = F.col(text).cast("string")
    doc = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), content(own).alias("content"))
    lines = F.filter(F.transform(F.split(own, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit(None).cast("string")), lines).alias("before"))
    each = docs.select(doc.alias("doc"), F.posexplode(pairs).alias("pos", "pair")).select("doc", "pos", F.col("pair")["line"].alias("line"), F.col("pair")["before"].alias("before"))
    name = lambda x: (F.xxhash64(x), F.xxhash64(F.lit(1), x))
    (n1, n2), (p1, p2) = name("line"), name("before")
    prior = F.when(F.col("before").isNotNull(), F.struct(p1.alias("p1"), p2.alias("p2"))).alias("prior")
    names = each.where(F.col("line").isNotNull()).select("doc", "pos", prior, n1.alias("n1"), n2.alias("n2")).distinct()
    levels: list[DataFrame] = []
    while True:
        depth = 1 << len(levels)
        tied = stored(ties(names).where("n > 1").drop("n"), f"ties-{depth}")
        if tied.isEmpty():
            discard(tied)
            return levels
        levels.append(tied)
        ahead = tied.select("doc", (F.col("pos") - depth).alias("pos"), F.col("n1").alias("m1"), F.col("n2").alias("m2"))
        names = tied.select("doc", "pos", "prior", "n1", "n2").join(ahead, ["doc", "pos"])
        names = names.select("doc", "pos", "prior", *named(*map(F.col, ("n1", "n2", "m1", "m2"))))


def repeated_prefixes(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """``doc, pos, lines, first``: of suffixes that start a repeated run, the longest prefix that an earlier suffix has, and the earliest such.

    A run's start is always among them. Others may be, if their prefix ends where that of the suffix before them does.
    """
    levels = tied_levels(docs, key, text)
    known, deeper = None, None
    for j in reversed(range(len(levels))):
        step, tied = 1 << j, levels[j]
        # Those tied at this depth, but with no earlier one at double depth.
        fresh = tied.where("varied").select("doc", "pos", "prior", F.lit(step).alias("lines"), "n1", "n2", "first")
        if deeper is not None:
            fresh = fresh.join(deeper.where(later()).select("doc", "pos"), ["doc", "pos"], "left_anti")
        if known is None:
            parts, old = [fresh], []
        else:
            there = tied.select("doc", F.col("pos").alias("at"), F.col("n1").alias("m1"), F.col("n2").alias("m2"))
            going = stored(known.withColumn("at", F.col("pos") + F.col("lines")).join(there, ["doc", "at"], "left").drop("at"), f"going-{step}")
            met = going.where("m1 IS NOT NULL").select("doc", "pos", "prior", "lines", F.struct("n1", "n2", "first").alias("own"), *named(*map(F.col, ("n1", "n2", "m1", "m2"))))
            met = stored(ties(met), f"met-{step}")
            further = met.where("n > 1 AND varied").select("doc", "pos", "prior", (F.col("lines") + step).alias("lines"), "n1", "n2", "first")
            stay = met.where(~later()).select("doc", "pos", "prior", "lines", "own.*")
            parts, old = [fresh, further, stay, going.where("m1 IS NULL").drop("m1", "m2")], [known, going, met]
        now = parts[0]
        for part in parts[1:]:
            now = now.unionByName(part)
        now = stored(now, f"prefixes-{step}")
        discard(*old, deeper)
        known, deeper = now, tied
    discard(deeper)
    return known if known is None else known.where(later()).select("doc", "pos", F.col("lines").cast("long").alias("lines"), "first")


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            gone: set[int] = set()
            runs: list[dict] = []
            end = 0
            for s in sorted(starts or (), key=lambda s: s["pos"]):
                upto = s["pos"] + s["lines"]
                if upto > end:
                    gone.update(range(max(s["pos"], end), upto))
                    runs.append({"line": s["pos"], "lines": s["lines"], "from_key": s["first"]["doc"]["key"], "from_line": s["first"]["pos"]})
                    end = upto
            kept, n, at = [], 0, 0
            for line in (text or "").split("\n"):
                filled = line.strip(" ") != ""
                if not (filled and at in gone):
                    kept.append(line)
                n += filled
                at += filled
            out.append(("\n".join(kept), n, len(gone), runs))
        kept, n, gone, runs = zip(*out, strict=True) if out else ((), (), (), ())
        kind = batch.schema.field("starts").type.value_type.field("first").type.field("doc").type.field("key").type
        runs_type = pa.list_(pa.struct([("line", pa.int64()), ("lines", pa.int64()), ("from_key", kind), ("from_line", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, runs_type)], ["key", "kept_text", "n_lines", "n_removed", "runs"])


def line_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Key, ``kept_text``, ``n_lines`` (not blank), ``n_removed``, ``runs`` (line, lines, from_key, from_line) of every row."""
    starts = repeated_prefixes(docs, key, text)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("content", content(F.col("text")))
    kind = docs.schema[key].dataType.simpleString()
    if starts is None:
        joined = rows.select("key", "text", F.lit(None).cast(f"array<struct<pos: int, lines: bigint, first: struct<doc: struct<none: boolean, key: {kind}, content: binary>, pos: int>>>").alias("starts"))
    else:
        found = starts.where(F.col("lines") >= min_lines).groupBy("doc").agg(F.collect_list(F.struct("pos", "lines", "first")).alias("starts"))
        found = found.select(F.col("doc.key").alias("k"), F.col("doc.content").alias("c"), "starts")
        joined = rows.join(found, rows["key"].eqNullSafe(found["k"]) & (rows["content"] == found["c"]), "left").select("key", "text", "starts")
    out = joined.mapInArrow(_delete, f"key {kind}, kept_text string, n_lines bigint, n_removed bigint, runs {RUNS.format(kind)}")
    return out.withColumnRenamed("key", key)


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = line_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))
