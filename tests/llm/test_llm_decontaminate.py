import random
import re
from collections import Counter

import pytest

from medalmart.llm.decontaminate import BITS, FLIPS, RADIUS, blocks, clean, contaminated, filed, fingerprint, overlap
from pyspark.sql import functions as F
from texts import prose


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    out = {}
    items = [(i, shingles(t)) for i, t in items]
    for k, t in docs:
        g = shingles(t)
        for i, own in items:
            for p in range(len(g)):
                a, b = Counter(g[p : p + len(own)]), Counter(own)
                j = sum((a & b).values()) / sum((a | b).values()) if own else 0
                if j >= 0.8:
                    out[k, i] = max(j, out.get((k, i), 0))
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(8)] + [(8, "too short an item"), (9, None), (10, "again " * 30)]
    docs = [(i, f"{prose(rng, 30)} {items[i % 8][1]} {prose(rng, 20)}") for i in range(6)]
    near = items[7][1].split()
    near[0] = near[-1] = "other"
    docs += [(10, prose(rng, 30) + " " + " ".join(near)), (11, items[3][1].upper()), (12, items[2][1][: len(items[2][1]) // 2])]
    docs += [(13, None), (14, ""), (15, "again " * 400), (16, prose(rng, 300)), (17, "too short an item"), (5, docs[5][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_same_pairs_as_brute_force(case):
    docs, items, d, b = case
    got = {(r[0], r[1]): r[2] for r in contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {10, 11, 15} <= {k for k, _ in got} and not {12, 16, 17} & {k for k, _ in got}


def test_clean_documents_stay(case, odd, empty):
    docs, items, d, b = case
    held = {k for k, _ in brute(docs, items)}
    assert sorted(r["doc_id"] for r in clean(d, b).collect()) == sorted(k for k, _ in docs if k not in held)
    assert clean(odd, b).count() == 4 and clean(odd, b).columns == odd.columns
    assert clean(empty, b).count() == 0 and clean(d, b.limit(0)).count() == len(docs)


def test_every_fingerprint_within_the_radius_meets(spark):
    rng = random.Random(2)
    assert sum(w for _, w in blocks()) == BITS and (FLIPS + 1) * len(blocks()) > RADIUS
    fps, pairs = [], []
    for i in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), RADIUS):
            b ^= 1 << bit
        fps.append((i, a - (1 << 63), b - (1 << 63)))
    frame = spark.createDataFrame(fps, "i int, a long, b long")
    near = filed(frame.select("i", F.col("a").alias("fp")), True).select("i", "block", "value")
    own = filed(frame.select("i", F.col("b").alias("fp")), False).select("i", "block", "value")
    assert near.join(own, ["i", "block", "value"]).select("i").distinct().count() == 60


def test_simhash_and_overlap(spark):
    rng = random.Random(4)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)], [rng.randint(0, 4) for _ in range(n)], [rng.randint(0, 4) for _ in range(n + 2)]) for n in (1, 2, 9, 40)]
    frame = spark.createDataFrame(rows, "h array<long>, a array<long>, b array<long>")
    for (h, a, b), r in zip(rows, frame.select(fingerprint(F.col("h")).alias("fp"), overlap(F.col("a"), F.col("b")).alias("j")).collect(), strict=True):
        want = sum(1 << bit for bit in range(64) if sum((x >> bit) & 1 for x in h) * 2 > len(h))
        assert r["fp"] % (1 << 64) == want
        x, y = Counter(a), Counter(b)
        assert r["j"] == pytest.approx(sum((x & y).values()) / sum((x | y).values()))
