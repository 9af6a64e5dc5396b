"""Secrets in texts: three fixed patterns, and strings that look random to character Markov models.

Two chains over characters are learned from labelled samples: random strings (the values that the
patterns find in the corpus, and generated strings over the usual alphabets) and ordinary
identifiers (the words of the corpus, alone and joined as identifiers join them, in both cases). A string's
log-likelihood ratio under the two tells whether it is a secret. Samples are counted where they are:
a task sends one table of transitions, so all labelled strings of the corpus are used.

Strings of 16 or more characters of the alphabet that no base span touches are scored; what reaches
the threshold is a span of kind ``random``.

Defined results: a null or empty text has no span; spans are code points, end exclusive; a base span
is a whole match, the name of an assignment included; equal rows have equal results; an empty table
gives no rows and the models rest on generated strings; texts of any length are read whole; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Kinds in the order in which spans that start together are listed, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
#: What the models know: the characters of identifiers and encoded keys, and a start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
START = len(ALPHABET)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Log-likelihood ratio in nats for each character from which a string counts as random: 24 for the shortest.
THRESHOLD = 1.5
#: Strings made for each alphabet, 32 characters each, and the pseudo-count of a transition.
MADE, MADE_LENGTH, PSEUDO = 2_000, 32, 0.5
_MADE_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:36], ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
#: Characters that are read at once when words are counted.
PIECE = 1 << 20


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value: int
    """Where the secret itself begins."""


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, by start, then kind."""
    out = [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE] if "=" in text or ":" in text else []
    out += [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _codes(text: str) -> np.ndarray:
    """Number of each character in the alphabet; ``START`` for any other."""
    lookup = np.full(256, START, np.uint8)
    lookup[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(START)
    return lookup[np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), np.uint8)]


def transitions(strings: Sequence[str]) -> np.ndarray:
    """Counts of each character after each other (or after the start) within the strings."""
    # One blank between strings: it is no character of the alphabet, so it is the start of the next.
    codes = _codes(" " + " ".join(strings) + " ").astype(np.int64)
    return np.bincount(codes[:-1] * (START + 1) + codes[1:], minlength=(START + 1) ** 2).reshape(START + 1, START + 1)[:, :START]


def identifiers(words: np.ndarray) -> np.ndarray:
    """Transitions of ordinary identifiers: the words of coded text, alone and with the next word joined
    by an underscore, a hyphen, a slash or a capital letter; all of it in capitals as well."""
    size = START + 1
    out = np.bincount(words[:-1].astype(np.int64) * size + words[1:], minlength=size**2).reshape(size, size)
    # Where one character that is not of the alphabet lies between two words.
    at = np.flatnonzero((words[:-2] < START) & (words[1:-1] == START) & (words[2:] < START))
    between = np.bincount(words[at].astype(np.int64) * size + words[at + 2], minlength=size**2).reshape(size, size)
    for mark in map(ALPHABET.index, "_-/"):
        out[:, mark] += between.sum(1)
        out[mark] += between.sum(0)
    camel = between.copy()
    camel[:, :26] += camel[:, 26:52]
    camel[:, 26:52] = 0
    capitals = out.copy()
    for way in (capitals, capitals.T):
        way[:26] += way[26:52]
        way[26:52] = 0
    return (out + camel + capitals)[:, :START]


def generated(seed: int = 0) -> np.ndarray:
    """Transitions of the generated random strings."""
    rng = np.random.default_rng(seed)
    return sum(transitions(["".join(row) for row in np.array(list(a))[rng.integers(0, len(a), (MADE, MADE_LENGTH))]]) for a in _MADE_ALPHABETS)


def samples(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Transitions of the labelled strings of all texts: ordinary ones (0) and random ones (1).

    Reaches the driver as one table of transitions, added up by cell before.
    """
    size = (START + 1) * START

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, START + 1, START), np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                values, last, rest = [], 0, []
                for s in base_spans(body):
                    values.append(body[s.value : s.end])
                    if s.start > last:
                        rest.append(body[last : s.start])
                    last = max(last, s.end)
                if values:
                    sums[1] += transitions(values)
                rest.append(body[last:])
                for part in rest:
                    for a in range(0, len(part), PIECE):
                        sums[0] += identifiers(_codes(" " + part[a : a + PIECE] + " "))
        flat = sums.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["cell", "n"])

    bodies = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "cell bigint, n bigint")
    found = bodies.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(2, START + 1, START)


def model(ordinary: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of every transition, random against ordinary."""
    logs = [np.log((c + PSEUDO) / (c.sum(1, keepdims=True) + PSEUDO * START)) for c in (ordinary, random)]
    # Characters that aren't of the alphabet speak for neither.
    return np.pad(logs[1] - logs[0], ((0, 0), (0, 1)))


def learned(docs: DataFrame, text: str = "text", seed: int = 0) -> np.ndarray:
    """The model of the corpus. Values found in it weigh as much as one generated alphabet, however many they are."""
    ordinary, found = samples(docs, text)
    made = generated(seed)
    share = made.sum() / len(_MADE_ALPHABETS) / found.sum() if found.sum() else 0.0
    return model(ordinary, made + found * share)


def ratio(ratios: np.ndarray, string: str) -> float:
    """How much likelier a string is as a random one, in nats."""
    codes = _codes(" " + string)
    return float(ratios[codes[:-1], codes[1:]].sum())


def spans(text: str, ratios: np.ndarray, threshold: float = THRESHOLD) -> list[Span]:
    """Base spans and, apart from them, those of strings that look random; by start, then kind."""
    base = base_spans(text)
    out, at, reach = list(base), 0, 0
    for m in CANDIDATE.finditer(text):
        # Base spans that begin before the candidate ends; the farthest end of them tells whether they touch.
        while at < len(base) and base[at].start < m.end():
            reach = max(reach, base[at].end)
            at += 1
        if reach <= m.start() and ratio(ratios, m[0]) >= threshold * len(m[0]):
            out.append(Span(m.start(), 3, m.end(), m.start()))
    return sorted(out)


def joined(found: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in found)


_RESULT = "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans array<struct<kind: string, start: bigint, end: bigint, value: string, ratio: double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("ratio", pa.float64())]))


def scan(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every document's spans with their strings and ratios, counts by kind, and the digest of the base ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for body in batch.column(1).to_pylist():
                own = spans(body, ratios, threshold)
                counts.append([sum(s.kind == k for s in own) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(joined([s for s in own if s.kind < 3]).encode()).hexdigest())
                found.append([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "value": (v := body[s.value : s.end]), "ratio": ratio(ratios, v)} for s in own])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(found, _SPAN)], ["key", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {_RESULT}").withColumnRenamed("key", key)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = scan(docs, learned(docs))
    one = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return told.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(one, ",").alias("spans"), "n_random")
