"""Language of documents, and of spans within them.

A model of hashed character runs is learned for each language from labelled documents. Each word
gets a score for every language that its script admits; Viterbi over a document's words, with a
penalty for every switch, labels spans of mixed text. A document's language is the one that most of
its letters are labelled with.

The model is fitted on at most ``PER_LANGUAGE`` documents of each language, those with the smallest
key hashes. Labelling takes all words of all texts.

Defined results: text that is null or has no letter gets ``und`` with score 0; ties go to the
language that sorts first; if there is nothing to learn from, every text is ``und``; repeated rows
are rows of their own; an empty table gives no rows; texts of any length are labelled whole, and
scored in pieces; an input column named like a result column is left out in favour of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, slices, table, without
from .labelled import smallest
from .texts import bounds, code_points, mixed, tables

#: Documents of each language that the model is fitted on, at most.
PER_LANGUAGE = 3000
BUCKETS = 1 << 16
#: Cost of a switch between languages, in nats; and of a word in any other language than a candidate.
SWITCH, EXCLUDED = 8.0, -1e4
#: No word counts for more than this against a language.
WORD_LIMIT = 12.0
#: Share of a script's letters that a language must have in training to be a candidate for it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Characters scored at once.
AT_ONCE = 1 << 20
# First code points of script ranges, in order, and the script of each range.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0E00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0xAC00, 0xD7B0)
SCRIPT_NAMES = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "other", "Indic", "Thai", "Burmese", "Georgian", "Hangul", "other", "Latin", "Greek", "other", "Kana", "Han", "Hangul", "other")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_LETTERS: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS["is"] = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.bool_, 0x110000)
    return _LETTERS["is"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, joined: buckets of the runs of 2 and 3 characters at each place
    (a word has a border on either side), start and end of each word, its text, its script."""
    lower, _ = tables()
    points = code_points("\x00" + "\x00".join(texts) + "\x00")
    low = np.where(letters()[points], lower[points], 0).astype(np.uint64)
    starts, ends = bounds(low > 0)
    two = low * np.uint64(0x110000)
    two[:-1] += low[1:]
    three = two.copy()
    three[:-2] = three[:-2] * np.uint64(0x110000) + low[2:]
    bucket = np.stack([(mixed(x + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int32) for k, x in ((1, two), (2, three))])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(text_ends, starts, "left")
    script = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])[np.searchsorted(SCRIPT_STARTS, points[starts], "right") - 1]
    return bucket, starts, ends, doc, script


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets, and after them of scripts' letters, by language; summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            own = [t or "" for t, x in zip(texts, langs, strict=True) if x == lang]
            for a, b in slices([len(t) for t in own], AT_ONCE):
                bucket, starts, ends, _, script = grams(own[a:b])
                held = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                # A border before the word counts as its first character.
                inside = np.zeros(bucket.shape[1] + 1, np.int32)
                np.add.at(inside, starts - 1, 1)
                np.add.at(inside, ends, -1)
                at = np.cumsum(inside[:-1]) > 0
                held[:BUCKETS] += np.bincount(bucket[:, at].ravel(), minlength=BUCKETS)
                held[BUCKETS:] += np.bincount(script, ends - starts, len(SCRIPTS)).astype(np.int64)
    for lang, held in sums.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> dict:
    """The model, of a size bounded by the number of languages. ``labelled``: all rows to learn from."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key)).alias("at"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # Which documents: settled on keys alone, each task keeping its smallest; then the texts of those.
    upto = smallest(rows.select("lang", "at"), "lang", ("at",), per_language).groupBy("lang").agg(F.max("at").alias("upto"))
    chosen = rows.join(F.broadcast(upto) if upto.count() <= 10_000 else upto, "lang").where("at <= upto").select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    code = {n: i for i, n in enumerate(names)}
    n = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    n[[code[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    grams_, scripts = n[:, :BUCKETS], n[:, BUCKETS:]
    score = np.log((grams_ + 0.5) / (grams_.sum(1, keepdims=True) + 0.5 * BUCKETS)) if len(names) else grams_
    share = scripts / np.maximum(1, scripts.sum(0))
    allowed = share >= SCRIPT_SHARE
    allowed |= ~allowed.any(0)  # a script never seen admits all languages
    return {"names": names, "score": np.ascontiguousarray(score.T, np.float32), "allowed": np.ascontiguousarray(allowed.T)}


def word_scores(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each word for each language, relative to its best; its text, its letters, its start."""
    bucket, starts, ends, doc, script = grams(texts)
    if not len(starts):
        return np.empty((0, len(model["names"])), np.float32), doc, starts, starts
    each = model["score"][bucket[0]] + model["score"][bucket[1]]
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts - 1, ends  # a word's scores begin at its border
    pad = np.zeros((1, each.shape[1]), np.float32)
    sums = np.add.reduceat(np.concatenate([each, pad]), cuts, axis=0)[::2]
    best = sums.max(1, keepdims=True)
    sums = np.maximum(sums - best, -WORD_LIMIT)
    sums[~model["allowed"][script]] = EXCLUDED
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return sums, doc, ends - starts, starts - 1 - offsets[doc]


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; the documents' words are stepped through side by side."""
    n_words = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-n_words, kind="stable")
    first = (np.cumsum(n_words) - n_words)[order]
    active = np.searchsorted(-n_words[order], -np.arange(n_words.max(initial=0)), "left")
    back = np.empty(score.shape, np.uint8 if score.shape[1] < 256 else np.int32)
    own = np.arange(score.shape[1])
    labels = np.zeros(len(score), np.int64)
    state = np.zeros((n_docs, score.shape[1]), np.float32)
    for t, n in enumerate(active):
        at = first[:n] + t
        s = state[:n]
        top = s.argmax(1)
        moved = s[np.arange(n), top] - np.float32(switch)
        stays = s >= moved[:, None]
        back[at] = np.where(stays, own, top[:, None])
        np.copyto(s, np.where(stays, s, moved[:, None]) + score[at])
    final = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = final[:n]
        final[:n] = back[at, final[:n]]
    return labels


def label_words(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label, text, letters and start of every word of the texts."""
    parts, base = [], 0
    for a, b in slices([len(t) for t in texts], AT_ONCE):
        score, doc, n, start = word_scores(texts[a:b], model)
        parts.append((score, doc + a, n, start))
    score, doc, n, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    return viterbi(score, doc, len(texts)), doc, n, start


def _predictor(model: dict, with_spans: bool, field: int):
    names = model["names"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).flatten()[field]
            for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), 8 * AT_ONCE):
                yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in predict(batches):
            langs, scores, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            if names:
                label, doc, n, start = label_words(texts, model)
                held = np.bincount(doc * len(names) + label, n, len(texts) * len(names)).reshape(len(texts), -1)
                total = held.sum(1)
                best = held.argmax(1)
                scores = np.where(total > 0, held.max(1) / np.maximum(1, total), 0.0)
                langs = [names[i] if t else UNKNOWN for i, t in zip(best, total, strict=True)]
                if with_spans:
                    new = np.flatnonzero(np.diff(doc, prepend=-1).astype(bool) | np.diff(label, prepend=-1).astype(bool))
                    last = np.append(new[1:], len(doc)) - 1
                    for i, j in zip(new, last, strict=True) if len(doc) else ():
                        spans[doc[i]].append({"start": int(start[i]), "end": int(start[j] + n[j]), "lang": names[label[i]]})
            out = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(out + ([pa.array(spans, kind)] if with_spans else []), ["row", "lang_pred", "score"] + ["spans"] * with_spans)

    return run


def predict(docs: DataFrame, model: dict, text: str = "text", spans: bool = False) -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and, if wanted, ``spans`` (start, end, lang by character)."""
    names = ["lang_pred", "score"] + ["spans"] * spans
    kept = without(docs, names)
    # The text travels once: as a field of the row, or beside it if a result takes its name.
    own = F.col(text).cast("string").alias("__text")
    rows = docs.select(F.struct(*kept, own).alias("row"))
    place = len(kept)
    if text in docs.columns and docs.schema[text].dataType == T.StringType() and text not in names:
        rows, place = docs.select(F.struct(*kept).alias("row")), [c for c in docs.columns if c.lower() not in names].index(text)
    fields = [rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
        fields.append(T.StructField("spans", T.ArrayType(span)))
    out = rows.mapInArrow(_predictor(model, spans, place), T.StructType(fields))
    return out.select("row.*", *names).drop("__text")


def held_out(key: Column) -> Column:
    return crc_mod(key, 3) == 1


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    return fit(docs.where(~held_out(F.col(key))), key, text, lang)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or without one main language, go."""
    # Results get names that documents don't have.
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score")}
    told = predict(docs.withColumnsRenamed(names), languages(docs))
    told = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MAIN_SHARE)).drop("lang_pred", "score")
    return told.withColumnsRenamed({v: k for k, v in names.items()})


#: A document stays if one language has at least this share of its letters.
MAIN_SHARE = 0.5


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = predict(docs.select("doc_id", F.col("text")), languages(docs), spans=True)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
