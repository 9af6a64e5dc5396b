"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text falls into one of a few bins. The model has a table of additions for each
feature and for some pairs of features; a score is the logistic of their sum. Tables are learned by
cyclic boosting: feature by feature, round after round, a shallow tree is fitted to what the sum
still gets wrong, and a small part of it is added to the feature's table. Pairs follow, those whose
table would explain most of the rest. It is fitted on at most ``PER_CLASS`` documents of each label.

Features describe form, not topic: lengths, shares of letter cases, digits, marks and symbols,
repetition of words and lines. They take whole texts and are made by numpy, all texts of a batch at
once. Scoring looks up bins and adds.

Defined results: null and empty texts have features of zero; repeated rows score alike; without
labels of both kinds every score is 0.5; an empty table gives no rows;
texts of any length are read whole; an input column named like a result column is left out in favour
of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, slices, table, without
from .labelled import sample
from .texts import bounds, code_points, mixed, word_hashes

#: Documents of each label to learn from, at most.
PER_CLASS = 4000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 300, 60, 0.1
#: Documents that a leaf needs; weight that shrinks a leaf's value.
LEAF, SHRINK = 10, 1.0
THRESHOLD = 0.3
AT_ONCE = 1 << 20
FEATURES = ("words", "word_length", "upper", "digits", "marks", "symbols", "shouts", "bars", "lines", "line_length", "distinct_words", "top_word", "doubled_words", "repeated_lines", "ended_lines", "longest_word")
_KINDS: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """0 other, 1 lower case or uncased letter, 2 upper case, 3 digit, 4 mark of prose, 5 symbol, 6 white space."""
    if not _KINDS:
        def kind(c: str) -> int:
            if c.isalpha():
                return 2 if c.isupper() else 1
            return 3 if c.isdigit() else 6 if c.isspace() else 4 if c in ".,;:!?'\"()-–—¿¡«»„“”’" else 5 if c.isprintable() else 0

        _KINDS["of"] = np.fromiter(map(kind, map(chr, range(0x110000))), np.uint8, 0x110000)
    return _KINDS["of"]


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over texts that end at ``ends``."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], ends))]).astype(np.float64)


def _top_and_distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of the commonest value of each document, and of its distinct values."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))))
    count = np.diff(np.append(new, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], count)
    return top, np.bincount(d[new], minlength=n).astype(np.float64)


def features(texts: list[str]) -> np.ndarray:
    """A row for each text. Texts are laid end to end, each closed by a line end."""
    n = len(texts)
    points = code_points("\n".join(texts) + "\n")
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = kinds()[points]
    chars = np.maximum(1.0, np.diff(ends, prepend=0) - 1.0)
    count = lambda flags: _per_text(flags, ends)
    word_start, word_end = bounds(kind != 6)
    word_doc = np.searchsorted(ends, word_start, "right")
    n_words = np.bincount(word_doc, minlength=n).astype(np.float64)
    longest = np.zeros(n)
    np.maximum.at(longest, word_doc, word_end - word_start)
    hashes, first = word_hashes(texts)
    doc = np.repeat(np.arange(n), np.diff(first))
    top, distinct = _top_and_distinct(doc, hashes, n)
    own = np.maximum(1.0, np.diff(first))
    doubled = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(doc) else np.zeros(n)
    letters = np.maximum(1.0, count((kind == 1) | (kind == 2)))
    line_start, line_end = bounds(points != 10)
    line_doc = np.searchsorted(ends, line_start, "right")
    n_lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    place = np.arange(len(points), dtype=np.uint64)
    terms = np.cumsum(np.concatenate(([0], mixed(points.astype(np.uint64) + np.uint64(1)))), dtype=np.uint64)
    # Lines with the same characters count as equal; order hardly matters for their share.
    line_hash = mixed(terms[line_end] - terms[line_start])
    del place
    _, distinct_lines = _top_and_distinct(line_doc, line_hash, n)
    ended = np.bincount(line_doc[np.isin(points[line_end - 1], [46, 33, 63, 58])], minlength=n) if len(line_end) else np.zeros(n)
    lines = np.maximum(1.0, n_lines)
    return np.stack([
        np.log1p(n_words), (chars / np.maximum(1.0, n_words)).clip(0, 1e6), count(kind == 2) / letters, count(kind == 3) / chars,
        count(kind == 4) / chars, count(kind == 5) / chars, count(points == 33) / chars, count(points == 124) / chars,
        np.log1p(n_lines), np.log1p(chars / lines), distinct / own, top / own, doubled / own,
        1.0 - np.where(n_lines > 0, distinct_lines / lines, 1.0), ended / lines, np.log1p(longest),
    ], axis=1)


# -- the model ------------------------------------------------------------------------------


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value of each bin by a tree on bins in order: at every level the split with the largest gain."""
    out = np.full(len(g), g.sum() / (h.sum() + SHRINK))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gains[(left_n < LEAF) | (n.sum() - left_n < LEAF)] = -1.0
    cut = int(np.argmax(gains))
    if gains[cut] <= 1e-12:
        return out
    cut += 1
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Value of each cell of a grid: one split of either axis, then one of the other in each half."""
    best, value = -1.0, np.full(g.shape, g.sum() / (h.sum() + SHRINK))
    for axis in (0, 1):
        a, b, c = (z if axis == 0 else z.T for z in (g, h, n))
        for cut in range(1, len(a)):
            parts = [(slice(None, cut), None), (slice(cut, None), None)]
            halves = [_tree(a[s].sum(0), b[s].sum(0), c[s].sum(0), 1) for s, _ in parts]
            if min(c[s].sum() for s, _ in parts) < LEAF:
                continue
            gain = sum((2 * v * a[s].sum(0) - v * v * (b[s].sum(0) + SHRINK / len(v))).sum() for v, (s, _) in zip(halves, parts, strict=True))
            if gain > best:
                grid = np.concatenate([np.tile(halves[0], (cut, 1)), np.tile(halves[1], (len(a) - cut, 1))])
                best, value = gain, grid if axis == 0 else grid.T
    return value


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Bin edges, intercept, tables of features and of pairs."""
    if not len(y) or y.min() == y.max():
        return {"edges": [np.empty(0)] * len(FEATURES), "intercept": 0.0, "tables": [np.zeros(1)] * len(FEATURES), "pairs": []}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = binned(x, edges)
    sizes = [len(e) + 1 for e in edges]
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    total, tables = np.full(len(y), intercept), [np.zeros(s) for s in sizes]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, s in enumerate(sizes):
            g, h = slopes()
            own = bins[:, f]
            step = RATE * _tree(np.bincount(own, g, s), np.bincount(own, h, s), np.bincount(own, minlength=s))
            tables[f] += step
            total += step[own]
    coarse = np.stack([bins[:, f] * PAIR_BINS // s for f, s in enumerate(sizes)], axis=1)
    cells = lambda a, b: coarse[:, a] * PAIR_BINS + coarse[:, b]
    square = lambda own, w=None: np.bincount(own, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    worth = sorted(((_gain(square(cells(a, b), g), square(cells(a, b), h)).sum(), a, b) for a in range(len(sizes)) for b in range(a)), reverse=True)[:PAIRS]
    pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in worth]
    for _ in range(PAIR_ROUNDS):
        for a, b, grid in pairs:
            g, h = slopes()
            own = cells(a, b)
            step = RATE * _pair_tree(square(own, g), square(own, h), square(own))
            grid += step
            total += step.reshape(-1)[own]
    return {"edges": edges, "intercept": intercept, "tables": tables, "pairs": pairs}


def additions(x: np.ndarray, model: dict) -> np.ndarray:
    bins = binned(x, model["edges"])
    total = np.full(len(x), model["intercept"])
    for f, t in enumerate(model["tables"]):
        total += t[bins[:, f]]
    coarse = np.stack([bins[:, f] * PAIR_BINS // len(t) for f, t in enumerate(model["tables"])], axis=1)
    for a, b, grid in model["pairs"]:
        total += grid[coarse[:, a], coarse[:, b]]
    return total


def _of(texts: list[str]) -> np.ndarray:
    return np.concatenate([np.empty((0, len(FEATURES))), *(features(texts[a:b]) for a, b in slices([len(t) for t in texts], AT_ONCE))])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _of([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])


def fit(texts: DataFrame) -> dict:
    rows = texts.select("label", "text").mapInArrow(_featured, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist()).reshape(len(rows), len(FEATURES))
    order = np.lexsort(x.T)  # the sum's rounding doesn't depend on which task was first
    return boost(x[order], rows.column("label").to_numpy()[order].astype(np.float64))


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(additions(_of([t or "" for t in batch.column(1).to_pylist()]), model), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["row", "score", "predicted"])

    return run


def quality(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows with ``score`` and ``predicted``."""
    kept = without(docs, ("score", "predicted"))
    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(model), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return out.select(*(["row.*"] if kept else []), "score", "predicted")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(sample(docs, table(spark, sf_dir, "labels"), "quality", held_out, PER_CLASS))
    return quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
