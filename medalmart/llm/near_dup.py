"""Near-duplicate documents by BagMinHash signatures, bands and exact multiset overlap.

A text is the multiset of its five-word shingles (words: runs of letters and digits, lower case).
Its signature comes from Poisson processes: each shingle has one process over the whole numbers up
to its count, made of independent processes over (0, 1], (1, 2], (2, 4], (4, 8] ... Points of an
interval carry a place in it, and those beyond the count don't belong to the text. The earliest
points, dealt over ``BANDS * ROWS`` components, are the signature; two texts agree in a component
with the probability of their weighted Jaccard similarity. Points are made only up to the time by
which all components have very likely got one, and further only for texts where one has not.

Texts that share a band are candidates; their multisets decide exactly. Linked texts form classes.
Not all pairs of a band's bucket are looked at: members already in one class need no link between
them. In every round some members of a bucket are compared with all that are in other classes; a
bucket is done when its members are one class, or when all members outside its largest class have
been compared with the rest, but for pairs that can't be similar enough by their sizes and their rare
shingles. So no link between two classes is left out, and a bucket with n members in one group costs
about n comparisons.

Defined results: null and empty texts are never duplicates; texts without a word are duplicates of
equal texts only; a text of fewer than five words is one shingle; repeated rows are copies; an empty
table gives no rows. With ties the smallest key stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, met, slices, stored, table, without
from .graph import components
from .texts import mixed, shingle_hashes, word_hashes

SIMILARITY, SHINGLE = 0.8, 5
_MASK = (1 << 64) - 1
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**5)**25 > 0.9999.
BANDS, ROWS = 25, 5
#: Characters worked on at once.
AT_ONCE = 1 << 20
#: Members of a bucket outside its largest class that are all compared at once.
FEW = 4
#: Growth of the number of a bucket's members that are compared in one turn.
MANY = 32
#: Slots in which shingles are counted to put them in order.
SLOTS = 1 << 18


def _weighted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash, count; in that order."""
    words, first = word_hashes(texts)
    shingles, starts = shingle_hashes(words, first, SHINGLE)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])))) if len(doc) else np.empty(0, np.int64)
    return doc[new], shingles[new], np.diff(np.append(new, len(doc)))


def _unit(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper 52 bits."""
    return ((bits >> np.uint64(12)).astype(np.float64) + 1.0) * 2.0**-52


def bag_min_hash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, one row for each text: the time of the earliest point of each component."""
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    rate = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    seed = mixed(shingle[at] + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    doc, most = doc[at], count[at].astype(np.float64)
    weight = np.bincount(doc, rate, n_docs)
    limit = (np.log(m) + 4.0) * m / np.maximum(weight, 1.0)
    signature = np.full((n_docs, m), np.inf)
    todo = np.arange(len(doc))
    while len(todo):
        on, time, step = todo, np.zeros(len(todo)), 0
        while len(on):
            step += 1
            bits = mixed(seed[on] + np.uint64(step * 0x9FB21C651E98DF25 & _MASK))
            time = time - np.log(_unit(bits)) / rate[on]
            keep = time <= limit[doc[on]]
            on, time, bits = on[keep], time[keep], bits[keep]
            other = mixed(bits ^ np.uint64(0xD1B54A32D192ED03))
            own = low[on] + _unit(other) * rate[on] <= most[on]
            cell = doc[on[own]] * m + (mixed(other[own]) % np.uint64(m)).astype(np.int64)
            np.minimum.at(signature.reshape(-1), cell, time[own])
        limit *= 4.0
        todo = np.flatnonzero(np.isinf(signature).any(1)[doc])
    return signature


def bands(texts: list[str]) -> np.ndarray:
    """A hash for each band of each text; zeros for a text without a word."""
    doc, shingle, count = _weighted(texts)
    bits = bag_min_hash(doc, shingle, count, len(texts), BANDS * ROWS).view(np.uint64).reshape(len(texts), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), 1))
    for k in range(ROWS):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, k])
    h[np.bincount(doc, minlength=len(texts)) == 0] = 0
    return h.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in slices([len(t) for t in texts], AT_ONCE):
            own = bands(texts[a:b])
            has = own.any(1)
            counts = np.concatenate(([0], np.cumsum(has * BANDS)))
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(own[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["key", "content", "bands"])


def overlaps(texts: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of pairs of texts."""
    doc, shingle, count = _weighted(texts)
    total = np.bincount(doc, count, len(texts))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a, b = slice(first[x], first[x + 1]), slice(first[y], first[y + 1])
        _, p, q = np.intersect1d(shingle[a], shingle[b], assume_unique=True, return_indices=True)
        both = np.minimum(count[a][p], count[b][q]).sum()
        out[i] = both / max(1.0, total[x] + total[y] - both)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = (np.array([len(t) for t in batch.column(2).to_pylist()]) + np.array([len(t) for t in batch.column(3).to_pylist()])).tolist()
        for start, stop in slices(sizes, 4 * AT_ONCE):
            part = batch.slice(start, stop - start)
            ids = pa.concat_arrays([part.column(0), part.column(1)]).dictionary_encode()
            codes = ids.indices.to_numpy()
            _, at = np.unique(codes, return_index=True)
            both = pa.concat_arrays([part.column(2), part.column(3)])
            n = stop - start
            found = overlaps(both.take(pa.array(at)).to_pylist(), codes[:n], codes[n:]) >= SIMILARITY
            mask = pa.array(found)
            yield pa.RecordBatch.from_arrays([part.column(4).filter(mask), part.column(5).filter(mask)], ["u", "v"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Classes of those pairs of contents that are similar enough. A hot content is many rows on one
    side of a join and one on the other, which adaptive execution splits."""
    left = pairs.join(texts.select(F.col("content").alias("v"), F.col("text").alias("right")), "v")
    both = left.join(texts.select(F.col("content").alias("u"), F.col("text").alias("left")), "u")
    return both.select("u", "v", "left", "right", "cu", "cv").mapInArrow(_verified, "u binary, v binary")


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(SLOTS, np.int64)
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in slices([len(t) for t in texts], AT_ONCE):
            _, shingle, _ = _weighted(texts[a:b])
            sums += np.bincount((shingle % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["slot", "n"])


def _prefixes(often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in texts], AT_ONCE):
                doc, shingle, count = _weighted(texts[a:b])
                order = np.lexsort((shingle, often[(shingle % np.uint64(SLOTS)).astype(np.int64)], doc))
                doc, shingle, count = doc[order], shingle[order], count[order]
                size = np.bincount(doc, count, b - a).astype(np.int64)
                place = np.cumsum(count) - count - (np.cumsum(size) - size)[doc]
                keep = place <= size[doc] - np.ceil(SIMILARITY * size[doc] - 1e-9)
                doc, shingle, place = doc[keep], shingle[keep], place[keep]
                own = batch.slice(a, b - a)
                names = [own.column(k).take(pa.array(doc)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), *names, pa.array(size[doc]), pa.array(size[doc] - place)], ["bucket", "content", "class", "size", "shared"])

    return run


def _by_rare_shingles(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """New buckets for the contents of ``open_`` (content, class): by their rarest shingles, one bucket each.

    Put the shingles of all texts in one order, rare ones first. The first that two texts have in
    common has all their common ones at or after it; so texts that are similar enough share one among
    the first fifth of each, and ``shared``, what a text has left from there on, bounds what they can
    share. Near-copies of one text differ from each other at twice the places at which they differ
    from the text: most of them meet nobody here. Any order would be right. This one is by counts in
    ``SLOTS`` slots, whatever the number of texts.
    """
    rows = texts.join(open_, "content").select("content", "class", "text")
    counts = rows.mapInArrow(_slot_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    out = rows.mapInArrow(_prefixes(often), "bucket bigint, content binary, class binary, size bigint, shared bigint")
    return out.withColumn("weight", F.col("shared"))


def _most(shared: Column, size: Column, other: Column) -> Column:
    """Upper bound of the similarity of two texts, one of which has ``shared`` shingles that it can share."""
    return shared / (size + F.greatest(other, shared) - shared)


def _able(members: DataFrame) -> DataFrame:
    """Members of buckets of several classes that could be similar enough to some other, going by sizes alone."""
    least = members.groupBy("bucket").agg(F.min("size").alias("least"), F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").drop("a", "b")
    return members.join(least, "bucket").where(_most(F.col("shared"), F.col("size"), F.col("least")) >= SIMILARITY - 1e-9).drop("least")


def _pivots(able: DataFrame, done: DataFrame | None, turn: int) -> DataFrame:
    """Members to compare with the rest of their bucket, the most central first.

    At first one of each bucket: in a large group around one text it joins most of the rest. Then
    those outside the bucket's largest class, ``MANY`` times as many each turn, until none is left.
    Where only a few are outside, all of them at once.
    """
    sizes = able.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("top"))
    shape = shape.where("all > top.n").select("bucket", F.col("top.class").alias("main"), (F.col("all") - F.col("top.n")).alias("outside"))
    able = able.join(shape, "bucket")
    if done is not None:
        able = able.join(met(done), ["bucket", "content"], "left_anti")
    outside = F.col("class") != F.col("main")
    wanted = outside if turn else outside | (F.col("outside") > FEW)
    limit = F.when(F.col("outside") <= FEW, FEW).otherwise(MANY**turn)
    order = Window.partitionBy("bucket").orderBy(F.desc("weight"), "content")
    ranked = able.where(wanted).withColumn("nth", F.row_number().over(order))
    ranked = ranked.where((F.col("nth") <= max(FEW, MANY**turn)) & (F.col("nth") <= limit))
    return ranked.select("bucket", F.col("content").alias("pivot"), F.col("class").alias("pivot_class"), F.col("size").alias("pivot_size"), F.col("shared").alias("pivot_shared"))


def content(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.unhex(F.md5(text.cast("binary"))))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Key and content of every row that has text; and the class of every content in a class of several."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("content", content(F.col("text"))).where("content IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    signed = stored(rows.select("key", "content", "text").mapInArrow(_banded, f"key {kind}, content binary, bands array<bigint>"), "signatures")
    each = signed.select("content", "bands").groupBy("content").agg(F.any_value("bands").alias("bands")).select("content", F.explode("bands").alias("bucket"))
    # Most buckets of a group have the same members, as another of it has; one of each set is enough.
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "content")).alias(f"mark{k}") for k in (1, 2)]
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), *marks).where("n > 1")
    shared = shared.groupBy("n", "mark1", "mark2").agg(F.min("bucket").alias("bucket"), F.count("*").alias("alike")).select("bucket", (F.col("n") * F.col("alike")).alias("n"))
    weight = F.sum("n").over(Window.partitionBy("content")).alias("weight")
    none = F.lit(0).cast("long")
    members = stored(each.join(shared, "bucket").select("bucket", "content", F.col("content").alias("class"), weight, none.alias("size"), none.alias("shared")), "members")
    needed = members.select("content").distinct()
    # The same join at every size, so that texts move alike.
    texts = stored(rows.select("content", "text").join(needed.hint("merge"), "content", "left_semi").groupBy("content").agg(F.any_value("text").alias("text")), "texts")
    known = texts.select(F.col("content").alias("node"), F.col("content").alias("class"))
    done, turn, spent = None, 0, []
    while True:
        if turn == 1:
            # Buckets that their most central members have not made one class: their contents meet by rare shingles.
            mixed_ = members.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("bucket")
            open_ = members.join(mixed_, "bucket").select("content", "class").distinct()
            rare = stored(_by_rare_shingles(open_, texts), "rare-shingles")
            banded, members = members, stored(_able(rare), "members")
            discard(rare, banded)
        pivots = stored(_pivots(members, done, turn), "pivots")
        spent.append(pivots)
        if not pivots.rows:
            break
        apart = F.col("class") != F.col("pivot_class")
        if turn:
            most = F.least("shared", "pivot_shared")
            apart &= most / (F.col("size") + F.col("pivot_size") - most) >= SIMILARITY - 1e-9
        pairs = members.join(met(pivots).withColumnRenamed("bucket", "b"), (F.col("bucket") == F.col("b")) & apart)
        one, two = F.struct("content", "class"), F.struct(F.col("pivot").alias("content"), F.col("pivot_class").alias("class"))
        pairs = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
        pairs = pairs.select(F.col("x.content").alias("u"), F.col("y.content").alias("v"), F.col("x.class").alias("cu"), F.col("y.class").alias("cv"))
        merged = stored(components(_links(pairs, texts)).withColumnRenamed("node", "class"), "merged")
        renamed = lambda frame: frame.join(met(merged), "class", "left").withColumn("class", F.coalesce("component", "class")).drop("component")  # noqa: B023, E731
        old = (known if turn else None, members, merged)
        known, members = stored(renamed(known), "classes"), stored(renamed(members), "members")
        discard(*old)
        now = pivots.select("bucket", F.col("pivot").alias("content"))
        before = done if done is not None and turn != 1 else None
        done = now if before is None else before.unionByName(now)
        done.rows = pivots.rows + (before.rows if before is not None else 0)
        turn += 1
    if not turn:
        known = stored(known, "classes")
    discard(texts, members, *spent)
    return signed.select("key", "content"), known


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key with ``class_id`` (the smallest key of its class) and ``class_size``."""
    keyed, known = classes(docs, key, text)
    rows = keyed.join(known.withColumnRenamed("node", "content"), "content", "left").select("key", F.coalesce("class", "content").alias("class"))
    least = rows.groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    out = rows.join(least, "class").select("key", "class_id", "class_size")
    alone = docs.where(content(F.col(text)).isNull()).select(F.col(key).alias("key"), F.col(key).alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, of each class only the one with the smallest key. Copies leave before the shuffle."""
    keyed, known = classes(docs, key, text)
    first = Window.partitionBy("class").orderBy(F.col("key").asc_nulls_last(), "content")
    named = keyed.join(known.withColumnRenamed("node", "content"), "content", "left").withColumn("class", F.coalesce("class", "content"))
    kept = named.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("content", F.xxhash64("key").alias("k"))
    # Which rows stay is settled on keys; the rows themselves move once, and only one of equal rows stays.
    row = F.struct(*without(docs, ())).alias("row")
    rows = docs.select(row, content(F.col(text)).alias("content"), F.xxhash64(F.col(key)).alias("k"))
    once = Window.partitionBy("content", "k").orderBy("k")
    one = rows.where("content IS NOT NULL").join(kept, ["content", "k"]).withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return one.select("row.*").unionByName(rows.where("content IS NULL").select("row.*"))


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
