import hashlib
import random

import numpy as np
import pytest
from texts import SCHEMA

from medalmart.llm import secret_scan as ss

VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_base(text):
    """The three patterns, character by character."""
    out, low = [], ascii_lower(text)

    def assign(i):
        for name in NAMES:
            if not low.startswith(name, i):
                continue
            j = i + len(name)
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            k = j
            while k < len(text) and text[k] in VALUE:
                k += 1
            if k > j:
                return k, k - j
        return None

    i = 0
    while i < len(text):
        hit = assign(i)
        if hit and hit[1] >= 12:
            out.append((i, 0, hit[0]))
        i = hit[0] if hit else i + 1
    for kind, chars, first, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 18), (2, "0123456789abcdef", "", 16)):
        i = 0
        while i < len(text):
            k = i + len(first)
            if text.startswith(first, i):
                while k < len(text) and text[k] in chars:
                    k += 1
            if text.startswith(first, i) and k > i + len(first):
                if k - i >= least:
                    out.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(out)


def odd_texts():
    rng = random.Random(3)
    bits = ["token", "ToKen", "pass", "password", "api_key", "APIKEY", "secret", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", '"', "'", " ", " ", ":", "=", "=", "\n", "é", "Key", "x.y-z/+_", "zzzzzzzzzzzz", "7"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]


def test_base_spans_agree_with_brute_force():
    for text in odd_texts():
        assert [(s.start, s.kind, s.end) for s in ss.base_spans(text)] == brute_base(text), text


def speech(rng, n):
    """Words of syllables, as words of a language are."""
    syllable = lambda: rng.choice("bdfgklmnprstvwz") + rng.choice("aeiou") + rng.choice(("", "", "n", "s", "r"))
    return " ".join("".join(syllable() for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [speech(rng, 1500) for _ in range(200)]
    for i in range(0, 200, 3):
        texts[i] += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end'
    return texts


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, t, None, None) for i, t in enumerate(corpus())]
    return ss.learned(spark.createDataFrame(rows, SCHEMA).repartition(3))


def brute_counts(texts):
    """Transitions pair by pair, for words alone."""
    counts = np.zeros((2, ss.START + 1, ss.START), np.int64)
    for t in texts:
        spans = ss.base_spans(t)
        for s in spans:
            before = ss.START
            for c in t[s.value : s.end]:
                counts[1, before, ss.ALPHABET.index(c)] += 1
                before = ss.ALPHABET.index(c)
    return counts[1]


def test_samples_are_all_labelled_strings(spark):
    texts = corpus()
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    ordinary, found = ss.samples(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert (found == brute_counts(texts)).all()
    again = ss.samples(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1))
    assert (again[0] == ordinary).all() and (again[1] == found).all()


def test_identifiers_are_words_and_their_joins():
    got = ss.identifiers(ss._codes(" ab cd "))
    want = sum(ss.transitions([x]) for x in ("ab", "cd"))
    at = ss.ALPHABET.index
    want = want.copy()
    for mark in "_-/":
        want[at("b"), at(mark)] += 1
        want[at(mark), at("c")] += 1
    upper = sum(ss.transitions([x]) for x in ("AB", "CD"))
    for mark in "_-/":
        upper[at("B"), at(mark)] += 1
        upper[at(mark), at("C")] += 1
    want += upper
    want[at("b"), at("C")] += 1
    assert (got == want).all()


def test_ratio_is_the_sum_over_characters(learned):
    for word in ("abc", "Zx9", "", "é?"):
        total, before = 0.0, ss.START
        for c in word:
            if c in ss.ALPHABET:
                total += learned[before, ss.ALPHABET.index(c)]
            before = ss.ALPHABET.find(c) if c in ss.ALPHABET else ss.START
        if all(c in ss.ALPHABET for c in word):
            assert abs(ss.ratio(learned, word) - total) < 1e-9


def test_held_out_strings_are_told_apart(learned):
    rng = random.Random(99)
    rand = ["".join(rng.choice(a) for _ in range(rng.randint(20, 40))) for a in ss._MADE_ALPHABETS for _ in range(150)]
    names = []
    for _ in range(1000):
        words = speech(rng, rng.randint(3, 5)).split()
        names.append(rng.choice(("_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "/".join(words))))
    names = [n for n in names if len(n) >= 16]
    hits = sum(ss.ratio(learned, r) >= ss.THRESHOLD * len(r) for r in rand) / len(rand)
    false = sum(ss.ratio(learned, n) >= ss.THRESHOLD * len(n) for n in names) / len(names)
    assert hits > 0.98 and false < 0.01, (hits, false)


def test_scan_gives_spans_of_whole_texts(spark, learned):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLE9q"
    texts = [f"some {key} here", f"secret: {key} and {key}", None, "", "漢字 " + "a b c d " * 20000 + key, "plain words only"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in ss.scan(spark.createDataFrame(rows, SCHEMA), learned).collect()}
    assert [(s.kind, s.start, s.end, s.value) for s in out[0].spans] == [("random", 5, 5 + len(key), key)]
    assert [(s.kind, s.start) for s in out[1].spans] == [("assign", 0), ("random", 13 + len(key))]
    assert out[2].spans == out[3].spans == [] and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4].spans[0].start == len(texts[4]) - len(key) and out[5].spans == []
    assert out[1].base_sha256 == hashlib.sha256(f"assign:0:{8 + len(key)}".encode()).hexdigest()


def test_the_query_keeps_base_spans(spark, tmp_path):
    texts = [*odd_texts()[:300], *corpus()]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in ss.op11_secret_scan(spark, str(tmp_path)).collect():
        base = brute_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        text = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        kept = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert ",".join(kept) == text


def test_odd_and_empty_input(spark, learned, odd, empty):
    assert ss.scan(empty, ss.learned(empty)).count() == 0
    out = ss.scan(odd, learned).collect()
    assert len(out) == 4 and all(r.spans == [] for r in out)
