import re
from collections import Counter

import numpy as np

from medalmart.llm.graph import components
from medalmart.llm.near_dup import _weighted, bag_min_hash, keep_one, near_duplicates
from texts import prose


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            same = rows[i][1] == rows[j][1] and rows[i][1]
            if same or (both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both)):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def test_classes_are_those_of_brute_force(docs, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_large_group_around_one_text(spark):
    """Copies with one to six changed words: many are similar to the original alone, or to nothing."""
    import random

    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(120)] = f"new{rng.random()}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(frame).collect()} == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(w for w in words for _ in range(int(rng.integers(1, 9))))
    b = " ".join(w for w in words for _ in range(int(rng.integers(1, 9))))
    one, two = shingles(a), shingles(b)
    true = sum((one & two).values()) / sum((one | two).values())
    doc, shingle, count = _weighted([a, b])
    assert count.sum() == sum(one.values()) + sum(two.values())
    s = bag_min_hash(doc, shingle, count, 2, 4000)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - true) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(docs, rows, odd, empty):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(brute([(r[0], r[1]) for r in rows]).values())
    assert sorted(str(r["doc_id"]) for r in keep_one(odd).collect()) == ["1", "2"]
    assert keep_one(odd).columns == odd.columns
    assert keep_one(empty).count() == near_duplicates(empty).count() == 0
