"""Importance resampling towards a target: documents drawn in proportion to how much they look like it.

Features (runs of words) are hashed into buckets. The corpus and the target are each one array of
counts by bucket; the floored log ratios of the two are an array of gains, and a document's weight
is the mean gain of its features. A Gumbel number from the document's key makes the highest scores
a draw without replacement. The k-th score is found by quickselect: random keys of what is left
are pivots, one aggregation counts the rows before and at each of them, and the next round looks
between two of them only. Winners alone are sorted and ranked, losers don't move.

Defined results: a null text has no feature, weight 0 and is never drawn (with ``least_words`` of 1
or more); an empty or missing target leaves all gains as smoothed; a null key counts as empty text
in the draw and comes after all others in ties; rows equal in score and key are drawn in any order,
each with a rank of its own; repeated rows count each; an empty table gives no rows; texts of any
length are read whole, in pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.operators.runs import dense_keys

from .common import stored, table
from .octets import octets, word_lists

BUCKETS, RUN = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Pivots of a round, and rows that are sampled to choose them from.
PIVOTS, SAMPLED = 15, 60
#: Lower case of A-Z; digits, letters and all bytes of other characters stay, the rest is blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, run: int) -> Iterator[tuple[int, Counter]]:
    """For each piece of a text its number of words, and its runs of 1 to ``run`` words with their counts."""
    tail: list[bytes] = []
    for words in word_lists(text, _WORDS):
        counts = Counter(words)
        joined = tail + words if tail else words
        for k in range(2, run + 1):
            # Runs of k words that end in this piece.
            start = max(0, len(tail) - k + 1)
            counts.update(b" ".join(joined[i : i + k]) for i in range(start, len(joined) - k + 1))
        tail = joined[max(0, len(joined) - run + 1) :] if run > 1 else []
        yield len(words), counts


def bucket_counts(counts: Counter, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and count of every feature."""
    n = len(counts)
    return np.fromiter(map(crc32, counts), np.int64, n) % buckets, np.fromiter(counts.values(), np.int64, n)


def bucketed(texts: DataFrame, text: str, run: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. As many numbers as buckets reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for octets_ in batch.column(0).to_pylist():
                for _, counts in features(octets_, run):
                    np.add.at(sums, *bucket_counts(counts, buckets))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    each = texts.select(octets(F.col(text)).alias("octets")).mapInArrow(count, "bucket bigint, n bigint")
    found = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 times log ratio of the smoothed shares of each bucket in target and corpus."""
    s_all, t_all, m = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [((t + 1.0) * (s_all + m)) / ((s + 1.0) * (t_all + m)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gumbel(key: object, seed: int) -> int:
    """Floored 1000 times Gumbel number of a key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """``key, n_words, n_features, weight, score`` of every row."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, octets_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n_words = n = total = 0
                for k, counts in features(octets_, run):
                    at, times = bucket_counts(counts, buckets)
                    n_words, n, total = n_words + k, n + int(times.sum()), total + int(gain[at] @ times)
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + gumbel(name, seed)))
            columns = [pa.array(list(x), pa.int64()) for x in (zip(*out, strict=True) if out else ((),) * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), octets(F.col(text)).alias("octets"))
    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint")


class _Place:
    """The composite key of a row: descending score, ascending key with nulls last, row number."""

    COLUMNS = ("down", "no_key", "key", "row")

    def __init__(self, frame: DataFrame):
        self.types = {c: frame.schema[c].dataType for c in self.COLUMNS}

    def column(self) -> Column:
        return F.struct(*self.COLUMNS)

    def literal(self, at: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(self.types[c]).alias(c) for c, v in zip(self.COLUMNS, at, strict=True)])


def kth(rows: DataFrame, k: int, total: int) -> tuple:
    """The composite key of the k-th of ``total`` rows, by quickselect. ``rows`` must be stored.

    A round reads what lies between its two bounds twice: for random pivots, and to count rows before
    and at each. What is left shrinks to about a tenth each round, and by a pivot at least.
    """
    place = _Place(rows)
    low = high = None  # bounds, both outside
    before, left = 0, total  # rows up to the lower bound, rows between the bounds
    for turn in itertools.count():
        inside = rows
        if low is not None:
            inside = inside.where((F.col("down") >= low[0]) & (place.column() > place.literal(low)))
        if high is not None:
            inside = inside.where((F.col("down") <= high[0]) & (place.column() < place.literal(high)))
        keys = inside.select(*_Place.COLUMNS)
        # A hash of row and turn is the random number; about SAMPLED of any number of rows pass.
        drawn = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 40)) <= int(min(1.0, SAMPLED / left) * (1 << 40))
        pivots = sorted((tuple(r) for r in keys.where(drawn).limit(8 * SAMPLED).collect()), key=_sorting)
        if len(pivots) > PIVOTS:
            pivots = [pivots[(2 * i + 1) * len(pivots) // (2 * PIVOTS)] for i in range(PIVOTS)]
        if not pivots:
            continue
        parts = [c for p in pivots for c in (F.count_if(place.column() < place.literal(p)), F.count_if(place.column() == place.literal(p)))]
        counts = keys.agg(*[c.alias(f"c{i}") for i, c in enumerate(parts)]).first()
        start, end = (low, before), (high, before + left)
        for i, pivot in enumerate(pivots):
            less, equal = before + counts[2 * i], counts[2 * i + 1]
            if less < k <= less + equal:
                return pivot
            if k <= less:
                end = (pivot, less)
                break
            start = (pivot, less + equal)
        (low, before), (high, upto) = start, end
        left = upto - before


def _sorting(at: tuple) -> tuple:
    down, no_key, key, row = at
    return down, no_key, (key is not None, key) if key is not None else (False,), row


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """All rows of ``scored`` with ``rank``: 1, 2, 3 ... for the drawn share of those with enough words, by descending score."""
    placed = scored.select("*", (-F.col("score")).alias("down"), F.col("key").isNull().alias("no_key"), F.monotonically_increasing_id().alias("row"))
    # Stored: rows keep their numbers while the search looks at them again and again.
    rows = stored(placed, "scores")
    able = rows.where(F.col("n_words") >= least_words)
    total = able.count()
    k = percent * total // 100
    none = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return rows.select(*scored.columns, none)
    place = _Place(rows)
    wins = (F.col("n_words") >= least_words) & (place.column() <= place.literal(kth(able, k, total)))
    winners = dense_keys(rows.where(wins), _Place.COLUMNS, "rank")
    return winners.select(*scored.columns, "rank").unionByName(rows.where(~wins).select(*scored.columns, none))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's ``key, n_words, n_features, weight, score, rank``; rank is null for those not drawn."""
    gain = gains(bucketed(docs, text, run, buckets), bucketed(target, "text", run, buckets))
    return drawn(scores(docs, gain, key, text, run, seed), least_words, percent).withColumnRenamed("key", key)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLING_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]),
    lambda acc, x: CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS t),
features AS (
  SELECT doc_id AS id, 'd' AS kind, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT item_id, 'b', unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
octets AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS o
  FROM (SELECT DISTINCT word FROM features)),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, o), lambda acc, x: xor(acc >> 8, t[1 + xor(acc % 256, x)])), 4294967295) % 10000 AS bucket
  FROM octets, tab),
counted AS (SELECT id, kind, bucket, count(*) AS n FROM features JOIN buckets USING (word) GROUP BY id, kind, bucket),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::BIGINT AS t
  FROM counted GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums),
weights AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
  FROM counted JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g
  FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + g DESC, doc_id) AS place, count(*) OVER () AS able
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + g AS score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
