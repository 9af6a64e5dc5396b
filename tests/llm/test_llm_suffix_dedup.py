import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medalmart.llm import suffix_dedup as module
from medalmart.llm.suffix_dedup import AT_ONCE, among, merged, minimizers, op9_suffix_dedup, ranks, suffix_dedup


def brute(rows, length):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for k, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
        out.append((k, len(t), kept, hashlib.sha256(kept).hexdigest(), list(zip(edges[::2], edges[1::2], strict=True))))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), r.kept_sha256, [tuple(x) for x in r.removed]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 1500])
def test_same_bytes_as_brute_force(docs, rows, shard_bytes):
    assert found(suffix_dedup(docs, shard_bytes=shard_bytes)) == brute([(r[0], r[1]) for r in rows], 400)


def test_the_query_tells_what_was_removed(spark, rows, tmp_path):
    more = [*rows, (900, "é" * 300 + "tail", None, None), (901, "x" + "é" * 300, None, None)]
    spark.createDataFrame([r[:2] for r in more], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op9_suffix_dedup(spark, str(tmp_path)).collect()}
    for k, n, kept, digest, runs in brute([r[:2] for r in more], 400):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b - a for a, b in runs), len(runs), digest)
        assert r.kept_text == kept.decode("utf-8", "replace") or b"\xa9" in kept[:1] + kept[-1:]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13])
def test_sorted_lists_are_merged(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 60, (200, 2)).astype(">u8").view("S16").ravel()
    lists = [x[np.argsort(keys[x], kind="stable")] for x in np.split(np.arange(200), np.sort(rng.integers(0, 200, n - 1)))]
    got = merged(keys, lists)
    assert sorted(got) == list(range(200)) and (keys[got] == np.sort(keys)).all()


def test_rows_of_hot_keys_stay(spark):
    """A key with most rows, keys with one row, hot keys that aren't asked for: as a plain semi join."""
    rows = [(7, i) for i in range(3000)] + [(8, i) for i in range(3000)] + [(i, i) for i in range(100, 3000)]
    frame = spark.createDataFrame(rows, "low long, start long")
    keys = spark.createDataFrame([(7, 3000), *((i, 1) for i in range(100, 3000, 2))], "low long, n long")
    got = sorted(map(tuple, among(frame, keys, ["low"], len(rows)).collect()))
    assert got == sorted(r for r in rows if r[0] == 7 or (r[0] >= 100 and r[0] % 2 == 0))


@pytest.mark.parametrize("shard_bytes", [4 << 20, 120])
def test_short_strings_over_few_letters(spark, shard_bytes):
    """Many ties: periodic texts, overlaps within a text, runs that touch."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, "ab" * 40), (101, "aba" * 30), (102, "a" * 70), (103, "é" * 30), (104, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup(frame, length=12, gram=4, shard_bytes=shard_bytes)) == brute(rows, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=6, max_size=80), st.integers(1, 6))
def test_minimizers(values, width):
    h = np.array(values, np.uint64)
    got = minimizers(h, width)
    assert got.tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(9, 25))
def test_ranks_order_prefixes(octets, length):
    a = np.frombuffer(octets, np.uint8)
    r = ranks(a, len(a) - np.arange(len(a)), length)
    whole = range(len(a) - length + 1)
    for i in whole:
        for j in whole:
            x, y = octets[i : i + length], octets[j : j + length]
            assert (r[i] == r[j]) == (x == y) and ((r[i] < r[j]) == (x < y))


def test_odd_rows(odd, empty):
    removed = lambda frame: sorted(sum(x["to"] - x["from"] for x in r.removed) for r in frame.collect())
    assert removed(suffix_dedup(odd)) == [0, 0, 0, 0]
    assert removed(suffix_dedup(odd, length=20, gram=8)) == [0, 50, 50, 50]
    assert suffix_dedup(empty).count() == 0


def peak(act):
    """What ``act`` returns, and the most bytes of Python and numpy that it held at a time."""
    module._TABLES.clear()
    tracemalloc.start()
    try:
        return act(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_worker_takes_a_batch_in_pieces():
    """Memory follows the piece, not the batch: 12 MB of texts, short ones and one of 3 MB."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, n, np.uint8).tobytes() for n in [6000] * 1500 + [3 << 20]]
    batch = pa.RecordBatch.from_arrays([pa.array([i.to_bytes(16, "big") for i in range(len(texts))]), pa.array(texts)], ["content", "octets"])
    starts, most = peak(lambda: sum(x.column(4).to_numpy().sum() for x in module._slicer(400, 48)(iter([batch]))))
    assert starts == sum(len(t) - 399 for t in texts) and most < 80 << 20


def test_a_shard_keeps_no_table_of_its_size():
    """A spread shard of several pieces: its strings' hashes are those of one pass, its tables those of a piece."""
    rng = np.random.default_rng(4)
    octets = [rng.integers(97, 123, 1000, np.uint8).tobytes() for _ in range(3 * AT_ONCE // 1000)]
    octets += octets[:5]
    n = len(octets)
    told = {"shard": [1] * n, "content": [i.to_bytes(16, "big") for i in range(n)], "spread": [True] * n, "copies": [1] * n, "start": [0] * n, "n": [601] * n, "octets": octets}
    got, most = peak(lambda: module._sharded(400, 7)(pa.table(told)))
    assert len(module._TABLES["power0"]) <= AT_ONCE + 401 and most < 128 << 20
    rows = got.to_pylist()
    assert sorted((int.from_bytes(r["content"], "big"), r["from"], r["to"]) for r in rows if r["k1"] is None) == sorted((i, 0, 1000) for i in (*range(5), *range(n - 5, n)))
    keys = {(a, b): (None if o < 0 else r["contents"][o], s) for r in rows if r["k1"] for a, b, o, s in zip(r["k1"], r["k2"], r["owner"], r["start"], strict=True)}
    assert len(keys) == 601 * (n - 5) and all(k[0] % (1 << 64) % 7 == r["group"] for r in rows if r["k1"] for k in zip(r["k1"], strict=True))
    for i in (2, n // 2, n - 6):
        piece = np.frombuffer(octets[i], np.uint8)
        for s in (0, 600):
            key = tuple(int(module.range_hash(module.prefix_sums(piece, k), k, np.array([s]), np.array([s + 400])).view(np.int64)[0]) for k in (0, 1))
            assert keys[key] == (None if i < 5 else told["content"][i], s)
