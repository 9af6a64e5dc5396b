"""Mixing sources to target weights along a curriculum.

Every source has a weight that changes over the training run. Its integral over the run is the
source's target in words; the inverse of the integral tells when the demand for the n-th word of
the source arises, and that time is the training position of the document holding this word.
Sorting the copies by position gives the training order. Everything is DataFrame functions.

Defined results: a null text has size 0; sources are ordered by code point with null as the last
one; repeated rows are rows of their own; of rows that tie in key and size it doesn't matter which
is taken; an empty table gives an empty result; texts of any length are counted whole; an input column named like a result column is left
out of :func:`mix` in favour of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, without

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Weight at the start and at the end of the run, relative to the mean. Each pair has the mean 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE, CAP = 1.5, 2.0
#: Parts of each source, by hash of the key, within which words are counted up.
DIGITS = 3
#: Bits of a place within a partition in Spark's increasing ids.
PLACE_BITS = 33
RESULT = ("size", "source_size", "target", "taken", "copies", "before", "schedule_start", "schedule_end")


def words(text: Column) -> Column:
    """Number of words, without making them: each word and the blanks before it become one letter."""
    blank = r"[\x20\x09-\x0D]"
    bare = F.regexp_replace(text, rf"{blank}+\z", "")
    return F.coalesce(F.length(F.regexp_replace(bare, rf"{blank}*+[^\x20\x09-\x0D]++", "x")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], schedules: Sequence[tuple[float, float]], share: float, cap: float) -> DataFrame:
    """A row for each source with its target: weight times a common level, up to ``cap`` times its size.

    Sharing the excess again and again by weight ends at that level. ``sizes`` has one row for each
    source, so its windows hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (F.row_number().over(by_name) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("at") + 1).cast("int"))
    ranked = sizes.withColumn("at", at)
    ranked = ranked.select("source", "source_size", pick(weights).alias("weight"), pick([a for a, _ in schedules]).alias("schedule_start"), pick([b for _, b in schedules]).alias("schedule_end"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    # Sources in the order in which they fill up; the level is right if the next one isn't full at it.
    everything = Window.partitionBy()
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("all_words"),
        (F.sum("most").over(full) - F.col("most")).alias("full_words"),
        (F.sum("weight").over(everything) - F.sum("weight").over(full) + F.col("weight")).alias("open_weight"),
    ).withColumn("level", (F.col("all_words") - F.col("full_words")) / F.col("open_weight"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return filled.withColumn("level", level).withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))).select("source", "source_size", "target", "schedule_start", "schedule_end")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, share: float = SHARE, cap: float = CAP, keep: Sequence[str] | None = None) -> DataFrame:
    """The documents (of their columns those in ``keep``, or all) with ``copies``, ``taken`` words and the words of their source ``before`` them.

    Within a source, documents follow each other by hash of their key. Whole passes take all of
    them, the last pass those whose middle word lies within the rest of the target.
    """
    kept = without(docs.select(*keep) if keep else docs, RESULT)
    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(row.alias("row"), F.col(source).alias("source"), F.nvl2(F.col(source), F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("own"), hashed.alias("hashed"), words(F.col(text)).alias("size"))
    sized = sized.withColumn("part", F.substring("hashed", 1, DIGITS))
    # Only counts here: the scan drops the documents' other columns, and sums are made before the shuffle.
    # Stored, as targets and places both need them: a row for each source and part, from one scan.
    parts = stored(sized.groupBy("own", "source", "part").agg(F.sum("size").alias("part_size")), "source-parts")
    sums = parts.groupBy("own", "source").agg(F.sum("part_size").alias("source_size"))
    goal = targets(sums.select("source", "source_size"), weights, schedules, share, cap)
    goal = goal.select(F.nvl2("source", F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("own"), "source_size", "target", "schedule_start", "schedule_end")
    upto = Window.partitionBy("own").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select("own", "part", (F.sum("part_size").over(upto) - F.col("part_size")).alias("part_before")).join(goal, "own")
    inside = Window.partitionBy("own", "part").orderBy("hashed", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sized.drop("source").join(placed, ["own", "part"])
    before = F.sum("size").over(inside) - F.col("size") + F.col("part_before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    copies = F.col("whole") + F.when(F.col("before") + F.col("size") / 2 <= rest, 1).otherwise(0)
    out = joined.withColumn("before", before).withColumn("whole", whole).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    out = out.select("row.*", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "before", "schedule_start", "schedule_end")
    return out if kept else out.drop("none")


def position(pass_: Column) -> Column:
    """When, from 0 to 1, the demand for the document's middle word arises in pass ``pass_`` (from 0).

    The demand up to t is target * (a t + (b - a) t**2 / 2); this is its inverse.
    """
    a, b = F.col("schedule_start"), F.col("schedule_end")
    y = (pass_ * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target")
    return F.coalesce(F.try_divide(y * 2, a + F.sqrt(F.greatest(a * a + (b - a) * 2 * y, F.lit(0.0)))), F.lit(0.0))


def training_order(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each copy, range-partitioned and sorted by position; ties follow the given columns."""
    each = mixed.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.withColumn("position", position(F.col("pass"))).select(*columns, "position", "pass")
    tie = [c for c in columns if dict(each.dtypes)[c] in ("bigint", "int")]
    return each.repartitionByRange("position", *tie).sortWithinPartitions("position", *tie, "pass")


def training_ranks(order: DataFrame) -> DataFrame:
    """The sorted copies with ``rank``: 1 for the copy that is trained on first.

    Stored, so that each copy's place in its partition stays. Ranks then need the rows before a
    partition only: a row for each partition of the sort.
    """
    placed = stored(order.withColumn("at", F.monotonically_increasing_id()), "training-order")
    placed = placed.withColumn("file", F.shiftright("at", PLACE_BITS)).withColumn("place", F.col("at").bitwiseAND((1 << PLACE_BITS) - 1))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = placed.groupBy("file").agg(F.count("*").alias("n")).select("file", (F.sum("n").over(upto) - F.col("n")).alias("ahead"))
    ranked = placed.join(F.broadcast(files), "file").withColumn("rank", F.col("ahead") + F.col("place") + 1)
    return ranked.drop("at", "file", "place", "ahead")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return training_order(mix(docs), docs.columns).select(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = stored(mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id", "source"]), "mixed")
    told = ["doc_id", "size", "source_size", "target", "taken"]
    order = training_ranks(training_order(mixed, [*told, "source", "before"]))
    # Only documents with words have copies, so no two of a source have as many words before them.
    once = [F.any_value(c).alias(c) for c in told]
    first, last = F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")
    taken = order.groupBy("source", "before").agg(*once, F.round(F.min("position"), 9).alias("first_position"), first, last).drop("source", "before")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_position", "double"), ("first_rank", "long"), ("last_rank", "long"))]
    return taken.unionByName(mixed.where("copies = 0").select(*told, *none))


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS VARCHAR), '')) AS hashed,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight,
    [1.5, 1.0, 0.5][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS a,
    [0.5, 1.0, 1.5][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS b,
    source_size * 2.0::DOUBLE AS most
  FROM sums),
levels AS (
  SELECT x.source, ((SELECT sum(source_size) FROM ranked) * 1.5::DOUBLE
      - coalesce((SELECT sum(y.most) FROM ranked y WHERE y.most / y.weight < x.most / x.weight), 0))
      / (SELECT sum(y.weight) FROM ranked y WHERE y.most / y.weight >= x.most / x.weight) AS level,
    x.most / x.weight AS ratio
  FROM ranked x),
goal AS (
  SELECT source, source_size, a, b,
    coalesce(least(most, weight * (SELECT max(level) FROM levels WHERE level <= ratio)), most)::DOUBLE AS target
  FROM ranked),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.a, g.b,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hashed, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0
    ELSE whole + CASE WHEN before + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END END AS copies
  FROM placed),
numbered AS (SELECT *, row_number() OVER () AS own FROM counted),
copied AS (
  SELECT own, doc_id, pass, a, b, (pass * source_size + before + size / 2.0::DOUBLE) / target AS y
  FROM (SELECT *, unnest(range(copies)) AS pass FROM numbered)),
timed AS (
  SELECT own, doc_id, pass, coalesce(y * 2 / nullif(a + sqrt(greatest(a * a + (b - a) * 2 * y, 0)), 0), 0) AS position
  FROM copied),
ordered AS (SELECT *, row_number() OVER (ORDER BY position, doc_id NULLS FIRST, pass) AS rank FROM timed),
trained AS (SELECT own, round(min(position), 9) AS first_position, min(rank) AS first_rank, max(rank) AS last_rank FROM ordered GROUP BY own)
SELECT n.doc_id, n.size, n.source_size, n.target, (n.size * n.copies)::BIGINT AS taken,
  t.first_position, t.first_rank, t.last_rank
FROM numbered n LEFT JOIN trained t ON n.own = t.own
"""
