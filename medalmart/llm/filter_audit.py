"""How filters overlap: what each removes in every order of application.

Words are encoded twice. A task makes CSR shards of the document-term matrix with a dictionary of
their own; the distinct words of all shards form the global dictionary, whose numbers then replace
the shards' own. So only distinct words of shards are shuffled, never tokens, and they travel in
packs: those of one shard and one part of the dictionary together. Row sums of the matrix are word
counts, its nonzero entries distinct words. A document that a shard can't hold is several rows of
several shards; global numbers tell which of its words are the same.

With a bit for each filter, a document's failures are one of 32 masks. Everything else follows
from counts by part and mask, whatever the number of documents.

Defined results: a null text is empty; a null part is the empty string, and one with it; a document
with a null key is identical to no smaller key and has no labels; repeated rows count each; of
several labels of a key the largest counts; an empty table gives no rows; words of any length are
whole; columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medalmart.operators.lookup import estimated_bytes

from .common import WIDE, stored, table
from .octets import PIECE, octets, row_numbers, word_lists

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT, CAPITAL_PERCENT = 80, 10
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
#: A shard ends when its texts or its dictionary are this large.
SHARD_BYTES, SHARD_WORDS = 8 << 20, 1 << 18
#: Texts that a worker takes out of a batch at once.
FEW_TEXTS = 256
#: Words longer than this stand in the dictionary as a tab and their digest; no word begins with a tab.
LONG_WORD = 64
#: The dictionary has a part for so many bytes of input (as the optimizer estimates them), up to a
#: million parts. A part then holds a few MB of words at any size, and packs are never more than words.
PART_BYTES, MOST_PARTS = 2 << 20, 1 << 20
#: A term is its part, and in the low bits the word's place in the part's order.
PART_BITS = 32

_CSR = "shard bigint, row array<bigint>, split array<boolean>, first array<int>, {columns}, n array<int>"
_FACT = (("row", pa.int64()), ("key", None), ("part", pa.string()), ("content", pa.binary()), ("marked", pa.bool_()), ("capitals", pa.int64()), ("points", pa.int64()))


class _Shard:
    """Rows of the matrix under way, with codes of the shard's own dictionary."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.rows: list[tuple[int, bool]] = []
        self.facts: list[tuple] = []
        self.code: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.size = 0

    def add(self, row: int, counts: Counter, split: bool) -> None:
        codes, n = self.codes, len(counts)
        self.code.append(np.fromiter((codes.setdefault(w, len(codes)) for w in counts), np.int32, n))
        self.n.append(np.fromiter(counts.values(), np.int32, n))
        self.rows.append((row, split))

    def batch(self, number: int, fact: pa.DataType | None, parts: int) -> pa.RecordBatch:
        words = [w if len(w) <= LONG_WORD else b"\t" + hashlib.sha256(w).hexdigest().encode() for w in self.codes]
        part = np.fromiter(map(crc32, words), np.int64, len(words)) % parts
        order = np.argsort(part, kind="stable")
        code = np.empty(len(words), np.int32)
        code[order] = np.arange(len(words))
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        ordered = [words[k] for k in order.tolist()]
        packs = [{"part": p, "words": b" ".join(ordered[a:b])} for p, a, b in zip(part[order][cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        first = np.cumsum([0, *map(len, self.code)])
        row, split = zip(*self.rows, strict=True)
        names = [n for n, _ in _FACT]
        columns = {
            "row": (row, pa.int64()), "split": (split, pa.bool_()), "first": (first, pa.int32()), "code": (code[np.concatenate(self.code)], pa.int32()),
            "packs": (packs, pa.struct([("part", pa.int64()), ("words", pa.binary())])), "facts": ([dict(zip(names, f, strict=True)) for f in self.facts], fact),
            "n": (np.concatenate(self.n), pa.int32()),
        }
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in columns.values()]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["shard", *columns])


def _facts(text: bytes) -> tuple:
    """Digest, whether it holds a mark, capital letters, code points."""
    return hashlib.sha256(text).digest()[:16], len(text.translate(None, MARKS)) < len(text), len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _CONTINUED))


def _few_at_once(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, of which few are Python objects at a time."""
    for at in range(0, len(batch), FEW_TEXTS):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, FEW_TEXTS).columns), strict=True)


def _sharded(shard_bytes: int, shard_words: int, piece: int, parts: int):
    def full(shard: _Shard) -> bool:
        return shard.size >= shard_bytes or len(shard.codes) >= shard_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, numbers, rows, fact = _Shard(), row_numbers(), row_numbers(), None
        for batch in batches:
            fact = pa.struct([(n, t or batch.schema.field("key").type) for n, t in _FACT])
            for key, part, text in _few_at_once(batch):
                row, counts, size, split = next(rows), Counter(), 0, False
                for words in word_lists(text, size=piece):
                    counts.update(words)
                    size += sum(map(len, words)) if len(text) > shard_bytes else 0
                    if size >= shard_bytes or len(counts) >= shard_words:
                        # What one shard can't hold goes on in the next.
                        if shard.rows:
                            yield shard.batch(next(numbers), fact, parts)
                        shard = _Shard()
                        shard.add(row, counts, True)
                        yield shard.batch(next(numbers), fact, parts)
                        shard, counts, size, split = _Shard(), Counter(), 0, True
                shard.add(row, counts, split)
                shard.facts.append((row, key, part, *_facts(text)))
                shard.size += len(text)
                if full(shard):
                    yield shard.batch(next(numbers), fact, parts)
                    shard = _Shard()
        if shard.rows:
            yield shard.batch(next(numbers), fact, parts)

    return run


def term_matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS, piece: int = PIECE, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix in CSR shards, the global dictionary (``word, term``), and other facts of the documents.

    A shard has ``row`` (numbers of documents), ``split`` (whether other shards hold more of the document),
    ``first`` (where each row begins, and the end), ``term`` and ``n`` (columns and values, terms ascending
    within a row). ``facts``: row, key, part, digest of the text, and what the filters ask beside words.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), octets(F.col(text)).alias("octets"))
    kinds = {"key": texts.schema["key"].dataType.simpleString(), "part": "string", "content": "binary", "marked": "boolean"}
    fact = ", ".join(f"{n}: {kinds.get(n, 'bigint')}" for n, _ in _FACT)
    parts = min(MOST_PARTS, 1 + estimated_bytes(texts) // part_bytes)
    # Stored: documents and shards are numbered once, by one scan.
    local = stored(texts.mapInArrow(_sharded(shard_bytes, shard_words, piece, parts), _CSR.format(columns=f"code array<int>, packs array<struct<part: bigint, words: binary>>, facts array<struct<{fact}>>")), "term-shards", WIDE)
    packs = local.select("shard", F.inline("packs"))
    numbered = stored(packs.groupBy("part").applyInArrow(_numbered, "part bigint, shard bigint, term array<bigint>, words binary"), "term-numbers")
    word = F.posexplode(F.split(F.decode("words", "UTF-8"), " ")).alias("place", "word")
    dictionary = numbered.where("shard IS NULL").select("part", word).select("word", (F.shiftleft("part", PART_BITS) + F.col("place")).alias("term"))
    # A shard's packs come in the order of their parts, which is the order of its codes.
    known = numbered.where("shard IS NOT NULL").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("part", "term"))).alias("known"))
    known = known.select("shard", F.flatten("known.term").alias("known"))
    coded = local.drop("packs", "facts").join(known.hint("merge"), "shard", "left")
    matrix = coded.mapInArrow(_global, _CSR.format(columns="term array<bigint>"))
    matrix.coded = coded
    return matrix, dictionary, local.select(F.inline("facts"))


def _numbered(packs: pa.Table) -> pa.Table:
    """Numbers for the words of one part, in their order; the part's words as a row without a shard."""
    part = packs.column("part")[0].as_py()
    lists = [words.split(b" ") for words in packs.column("words").to_pylist()]
    distinct = sorted(set().union(*lists))
    number = dict(zip(distinct, range(part << PART_BITS, (part << PART_BITS) + len(distinct)), strict=True))
    terms = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in lists]
    n = len(lists) + 1
    return pa.table({
        "part": pa.array([part] * n, pa.int64()), "shard": pa.array([*packs.column("shard").to_pylist(), None], pa.int64()),
        "term": pa.array([*terms, None], pa.list_(pa.int64())), "words": pa.array([None] * len(lists) + [b" ".join(distinct)], pa.binary()),
    })


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards' codes become terms."""
    for batch in batches:
        for i in range(len(batch)):
            at = {name: batch.column(name)[i] for name in batch.schema.names}
            first, code, n = (at[c].values.to_numpy() for c in ("first", "code", "n"))
            term = at["known"].values.to_numpy()[code] if len(code) else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.lexsort((term, row))
            lists = [pa.array([x], t) for x, t in ((first, pa.list_(pa.int32())), (term[order], pa.list_(pa.int64())), (n[order], pa.list_(pa.int32())))]
            own = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([own.column("shard"), own.column("row"), own.column("split"), *lists], ["shard", "row", "split", "first", "term", "n"])


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and nonzero entries of each row; the terms themselves of documents in several shards."""
    for batch in batches:
        for i in range(len(batch)):
            row, first, term, n = (batch.column(c)[i].values for c in ("row", "first", "term", "n"))
            first = first.to_numpy()
            sums = np.concatenate(([0], np.cumsum(n.to_numpy(), dtype=np.int64)))[first]
            split = batch.column("split")[i].values.to_numpy(zero_copy_only=False)
            terms = [term[a:b] if s else None for a, b, s in zip(first[:-1], first[1:], split, strict=True)] if split.any() else [None] * len(row)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(np.diff(sums)), pa.array(np.diff(first).astype(np.int64)), pa.array([t.to_pylist() if t is not None else None for t in terms], pa.list_(pa.int64()))],
                ["row", "words", "distinct", "terms"],
            )


def _global_row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _row_sums(_global(batches))


def word_counts(matrix: DataFrame) -> DataFrame:
    """``row, words, distinct`` of every document, from row sums and nonzero entries of the matrix.

    A matrix as it comes from :func:`term_matrix` is made and summed up shard by shard in one worker: a second one
    would hold batches of the same shards once more.
    """
    coded = getattr(matrix, "coded", None)
    shards, sum_up = (matrix, _row_sums) if coded is None else (coded, _global_row_sums)
    sums = stored(shards.mapInArrow(sum_up, "row bigint, words bigint, distinct bigint, terms array<bigint>"), "row-sums", WIDE)
    whole = sums.where("terms IS NULL").select("row", "words", "distinct")
    parts = sums.where("terms IS NOT NULL")
    # Entries of one document in several shards: one for each term, counted before they meet.
    distinct = parts.select("row", F.explode("terms").alias("term")).distinct().groupBy("row").agg(F.count("*").alias("distinct"))
    cut = parts.groupBy("row").agg(F.sum("words").alias("words")).join(distinct, "row", "left").select("row", "words", F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"))
    return whole.unionByName(cut)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``key, part, failed`` of every document: bit k of ``failed`` is set if it fails the k-th filter."""
    matrix, _, facts = term_matrix(docs, key, text, part)
    counted = facts.join(word_counts(matrix).hint("merge"), "row")
    # Only texts under several keys are looked up, each with its smallest key.
    # Stored, so that the join reads them anew and a text with very many rows can be split.
    least = facts.groupBy("content").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("content", "least")
    least = stored(least, "least-keys")
    joined = counted.join(least.hint("merge"), "content", "left")
    fails = (
        F.col("words") < LEAST_WORDS,
        F.col("distinct") * 100 < F.col("words") * DISTINCT_PERCENT,
        F.col("capitals") * 100 > F.col("points") * CAPITAL_PERCENT,
        F.col("marked"),
        F.col("key") > F.col("least"),
    )
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return joined.select("key", "part", bits.alias("failed"))


def interactions(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from ``part, failed, n, good, toxic`` counts.

    There are at most 2**filters rows of each part, each of which meets every order.
    """
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    each = failed.select("*", F.explode(orders).alias("filter_order"))
    place = lambda letter: F.lit(1).cast("int") * F.element_at(F.create_map(*[x for k, c in enumerate(filters) for x in (F.lit(c), F.lit(1 << k))]), letter)
    steps = F.transform(F.sequence(F.lit(1), F.lit(len(filters))), lambda s: F.struct(s.alias("step"), F.substring("filter_order", s, F.lit(1)).alias("letter"), F.aggregate(F.transform(F.sequence(F.lit(1), s), lambda t: place(F.substring("filter_order", t, F.lit(1)))), F.lit(0), lambda a, b: a + b).alias("upto")))
    each = each.select("*", F.explode(steps).alias("s")).select("part", "failed", "n", "good", "toxic", "filter_order", "s.*").withColumn("own", place(F.col("letter")))
    hit, before = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("upto") - F.col("own")) != 0
    total = lambda condition, of="n": F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0).cast("long"))
    out = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(F.col("failed").bitwiseAND(F.col("upto")) == 0).alias("kept"),
        total(hit & ~before).alias("removed"),
        total(hit & before).alias("redundant"),
        total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(hit & ~before, "good").alias("good_lost"),
        total(hit & ~before, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The interactions of the five filters on ``docs``, part by part, with what they cost in labelled documents."""
    told = labels.groupBy(F.col(key).alias("key")).agg(F.max(good).alias("good"), F.max(toxic).alias("toxic")).where("key IS NOT NULL AND (good = 1 OR toxic = 1)")
    rows = failures(docs, key, text, part).join(told.hint("merge"), "key", "left")
    one = lambda c: F.count_if(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    return interactions(rows.groupBy("part", "failed").agg(F.count("*").alias("n"), one("good"), one("toxic")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


AUDIT_SQL = r"""
WITH facts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
least AS (SELECT body, min(doc_id) AS first FROM facts GROUP BY body),
told AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT f.part, coalesce(t.quality = 1, false) AS good, coalesce(t.toxic = 1, false) AS toxic,
    (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(f.body, '[^A-Z]', '', 'g')) > 10 * length(f.body) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(f.body, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN f.doc_id > l.first THEN 16 ELSE 0 END) AS failed
  FROM facts f JOIN least l ON f.body = l.body LEFT JOIN told t ON f.doc_id = t.doc_id),
counts AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, failed),
bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM bits a, bits b, bits c, bits d, bits e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (
  SELECT o.filter_order, s.step::INTEGER AS step, x.letter, x.bit,
    (SELECT coalesce(sum(y.bit), 0) FROM bits y WHERE instr(o.filter_order, y.letter) < s.step)::INTEGER AS earlier
  FROM orders o, range(1, 6) s(step), bits x WHERE substr(o.filter_order, s.step::INTEGER, 1) = x.letter),
told_steps AS (
  SELECT c.part, s.filter_order, s.step, s.letter,
    coalesce(sum(n) FILTER ((failed & (earlier + bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((failed & bit) <> 0 AND (failed & earlier) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((failed & bit) <> 0 AND (failed & earlier) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((failed & bit) <> 0 AND (failed & earlier) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((failed & bit) <> 0 AND (failed & earlier) = 0), 0)::BIGINT AS toxic_lost
  FROM counts c, steps s GROUP BY c.part, s.filter_order, s.step, s.letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM told_steps
"""
