"""Benchmark passages in documents, found by SimHash of item-sized windows. DataFrame functions only.

Words are runs of letters and digits, lower case; shingles are five words in a row. A window is as
many shingles as a benchmark item has; its fingerprint is the 64-bit SimHash of its shingles, each
weighted by its count. A document holds an item if the shingles of a window, as a multiset, have a
weighted Jaccard similarity of at least 0.8 with those of the item.

Which windows: a window similar to an item has a shingle of the item, and moving its start to the
first such shingle loses none and takes in no fewer. So windows begin at shingles that some item
has, and have the sizes of such items; at the end of a text they may be shorter. Equal windows of
all documents are fingerprinted once.

Which pairs: fingerprints are cut into ``BLOCKS`` blocks. If two differ in ``RADIUS`` bits at most,
some block differs in ``FLIPS`` at most. Items are filed under each block's value and under all
values within ``FLIPS`` bits, windows look up their own: every pair within the radius meets. At
similarity 0.8 the bits of two fingerprints differ in 10 of 64 on average. Pairs within the radius
are then decided by their exact multisets.

Defined results: null and empty texts hold nothing; an item of fewer than five words takes no part;
items with equal shingles are one class, named by its smallest id; repeated documents give repeated
rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, without

SHINGLE, SIMILARITY = 5, 0.8
BITS = 64
#: Bits that two fingerprints may differ in: 17 = 6 * (2 + 1) - 1.
BLOCKS, FLIPS = 6, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: What lies between words.
GAP = r"[^\p{L}\p{N}]+"
#: Shingles of the benchmark that are sent to all executors, at most (about 60 bytes each). More are joined by shuffle.
BROADCAST_ROWS = 1_000_000
LANES = 0x0000000100000001


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once: inside a lambda the optimizer can't repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def shingle_list(words: Column) -> Column:
    """Hashes of all runs of five words; empty for fewer words."""

    def each(own: Column) -> Column:
        n = F.size(own) - (SHINGLE - 1)
        runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(SHINGLE)]))
        return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return let(words, each)


def fingerprint(shingles: Column) -> Column:
    """SimHash: bit b is set if more than half of the shingles, repeats counted, have it set.

    Bits b and b + 32 are counted in the two halves of one number.
    """
    half = F.size(shingles) / 2.0
    one = F.lit(1).cast("long")
    shift = lambda name, value, by: F.call_function(name, value, by)
    places = F.sequence(F.lit(0), F.lit(BITS // 2 - 1))
    votes = F.transform(places, lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, h: acc + shift("shiftrightunsigned", h, b).bitwiseAND(F.lit(LANES))))

    def bits(acc: Column, v: Column) -> Column:
        low = F.when(v["votes"].bitwiseAND(F.lit(0xFFFFFFFF)) > half, shift("shiftleft", one, v["b"])).otherwise(0 * one)
        high = F.when(F.shiftrightunsigned(v["votes"], 32) > half, shift("shiftleft", one, v["b"] + BITS // 2)).otherwise(0 * one)
        return acc.bitwiseOR(low).bitwiseOR(high)

    return F.aggregate(F.zip_with(votes, places, lambda v, b: F.struct(v.alias("votes"), b.alias("b"))), 0 * one, bits)


def overlap(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two multisets: one walk over both, sorted together."""
    tag = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("long").alias("x"), F.lit(0).alias("na"), F.lit(0).alias("nb"), F.lit(0).alias("both"))

    def step(acc: Column, e: Column) -> Column:
        same = acc["x"] == e["x"]
        na = F.when(same, acc["na"]).otherwise(0) + (1 - e["side"])
        nb = F.when(same, acc["nb"]).otherwise(0) + e["side"]
        # Elements of the first side come first, so an element of the second closes a match at most.
        both = acc["both"] + F.when((e["side"] == 1) & (nb <= na), 1).otherwise(0)
        return F.struct(e["x"].alias("x"), na.alias("na"), nb.alias("nb"), both.alias("both"))

    both = F.aggregate(F.array_sort(F.concat(tag(a, 0), tag(b, 1))), start, step, lambda acc: acc["both"])
    return both / (F.size(a) + F.size(b) - both)


def blocks() -> list[tuple[int, int]]:
    """First bit and width of each block."""
    cuts = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def filed(fingerprints: DataFrame, near: bool) -> DataFrame:
    """A row for each block's value, and if ``near`` for all values within ``FLIPS`` bits of it."""
    places = []
    place = lambda i, value: lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value"))
    for i, (first, width) in enumerate(blocks()):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        masks = [m for m in range(1 << width) if m.bit_count() <= FLIPS] if near else [0]
        flips = F.array(*[F.lit(m).cast("long") for m in masks])
        places.append(F.transform(flips, place(i, value)))
    return fingerprints.withColumn("at", F.explode(F.concat(*places))).select("*", "at.block", "at.value").drop("at")


def content(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``content`` (md5 of the text), ``item``, ``similarity`` of every text that holds an item."""
    # Items, classed by equal shingles. Their tables grow with the benchmark alone.
    shingled = benchmark.select(F.col(item).alias("item"), F.array_sort(shingle_list(word_list(F.col(item_text)))).alias("grams")).where(F.size("grams") > 0)
    items = stored(shingled.groupBy("grams").agg(F.min("item").alias("item")).withColumn("n", F.size("grams")), "items")
    held = stored(items.select("n", F.explode("grams").alias("gram")).groupBy("gram").agg(F.collect_set("n").alias("sizes")), "item-grams")
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    texts = docs.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL").select(content(F.col("text")).alias("content"), "text")
    grams = texts.select("content", F.posexplode(shingle_list(word_list(F.col("text")))).alias("pos", "gram"))
    hits = grams.join(held, "gram").select("content", "pos", F.explode("sizes").alias("n"))
    hits = stored(hits.groupBy("content").agg(F.collect_set(F.struct("pos", "n")).alias("hits")), "hits")
    # Windows of the few texts that have hits, each text once. Texts move once, at every size of the input.
    touched = texts.join(hits.select("content").hint("merge"), "content", "left_semi").groupBy("content").agg(F.any_value("text").alias("text")).join(hits.hint("merge"), "content")
    window = lambda grams: lambda h: F.struct(h["n"].alias("n"), F.array_sort(F.slice(grams, h["pos"] + 1, h["n"])).alias("grams"))
    cut = let(shingle_list(word_list(F.col("text"))), lambda grams: F.transform("hits", window(grams)))
    windows = touched.select("content", F.explode(cut).alias("w")).select("content", "w.n", "w.grams").where(F.size("grams") >= F.col("n") * F.lit(SIMILARITY))
    windows = windows.withColumn("w1", F.xxhash64("grams", "n")).withColumn("w2", F.xxhash64(F.lit(1), "n", "grams"))
    windows = stored(windows, "windows")
    once = windows.groupBy("w1", "w2").agg(F.any_value("n").alias("n"), F.any_value("grams").alias("grams"))
    prints = stored(once.withColumn("fp", fingerprint(F.col("grams"))), "fingerprints")
    # Stored, since each file key derives from the fingerprint and the optimizer would make it anew for each.
    item_prints = stored(items.select("item", "n", fingerprint(F.col("grams")).alias("fp")), "item-fingerprints")
    near = filed(prints.select("w1", "w2", "n", "fp"), False).join(filed(item_prints, True).withColumnRenamed("fp", "ifp"), ["n", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("w1", "w2", "item").distinct()
    decided = near.join(prints.select("w1", "w2", "grams"), ["w1", "w2"]).join(items.select("item", F.col("grams").alias("igrams")), "item")
    found = decided.withColumn("similarity", overlap(F.col("grams"), F.col("igrams"))).where(F.col("similarity") >= SIMILARITY).select("w1", "w2", "item", "similarity")
    return windows.select("content", "w1", "w2").join(found, ["w1", "w2"]).groupBy("content", "item").agg(F.max("similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each document and item class it holds: key, item, similarity (the best window's)."""
    found = matches(docs, benchmark, text, item)
    keyed = docs.select(F.col(key), content(F.col(text).cast("string")).alias("content"))
    return keyed.join(found, "content").select(key, F.col("item").alias(item), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item; columns as they were."""
    found = stored(matches(docs, benchmark, text).select("content").distinct(), "contaminated")
    row = F.struct(*without(docs, ())).alias("row")
    rows = docs.select(row, F.coalesce(content(F.col(text).cast("string")), F.lit(b"")).alias("content"))
    return rows.join(found, "content", "left_anti").select("row.*")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
