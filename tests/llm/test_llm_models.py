import random
import zlib

import numpy as np
import pytest

from medalmart.llm import language, quality, toxicity
from medalmart.llm.labelled import sample, smallest
from pyspark.sql import functions as F
from texts import prose


# -- language -------------------------------------------------------------------------------

ENGLISH = "the and of that with this from which have been their would there people about other water"
GERMAN = "der und die das mit nicht ein auch sich über für größe straße können wurde nach durch"
GREEK = "και το να του της είναι που με για από δεν στην"


@pytest.fixture(scope="module")
def langs(spark):
    rng = random.Random(5)
    text = lambda words, n=60: " ".join(rng.choice(words.split()) for _ in range(n))
    rows = [(i, text((ENGLISH, GERMAN, GREEK)[i % 3]), ("en", "de", "el")[i % 3]) for i in range(150)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, text(ENGLISH), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows, text


def test_languages_are_told(langs):
    frame, rows, _ = langs
    model = language.languages(frame)
    assert model["names"] == ["de", "el", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(frame, model).collect()}
    assert all(got[i][0] == lang and got[i][1] == 1.0 for i, _, lang in rows[:150])
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en"


def test_spans_of_mixed_text(langs):
    frame, _, text = langs
    model = language.languages(frame)
    parts = [text(ENGLISH, 25), text(GERMAN, 40), text(GREEK, 30)]
    mixed = frame.sparkSession.createDataFrame([(" / ".join(parts),)], "text string")
    spans = language.predict(mixed, model, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "el"]
    for s, p in zip(spans, parts, strict=True):
        assert abs(len(p) - (s["end"] - s["start"])) <= 12


def test_query_counts_spans(langs, tmp_path):
    frame, rows, text = langs
    mixed = frame.sparkSession.createDataFrame([(2000, text(ENGLISH, 25) + " / " + text(GERMAN, 40), None)], frame.schema)
    frame.unionByName(mixed).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_spans"] for r in language.op10_language(frame.sparkSession, str(tmp_path)).collect()}
    assert got[2000] == 2 and got[900] == got[902] == 0 and all(got[r[0]] == 1 for r in rows[:150])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    score, doc = rng.normal(size=(14, 3)).astype(np.float32) * 3, np.array([0] * 6 + [2] * 5 + [3] * 3)
    got = language.viterbi(score, doc, 5, switch=2.0)
    import itertools

    for d in (0, 2, 3):
        own = score[doc == d]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert tuple(got[doc == d]) == max(itertools.product(range(3), repeat=len(own)), key=value)


def test_language_odd_rows(odd, empty, spark, langs):
    model = language.languages(langs[0])
    assert language.predict(odd, model).count() == 4
    assert sorted(language.predict(odd, model).columns) == sorted([c for c in odd.columns if c != "score"] + ["lang_pred", "score"])
    assert [r["lang_pred"] for r in language.predict(odd, language.languages(empty)).collect()] == ["und"] * 4
    assert language.predict(empty, model).count() == 0
    stage = language.stage_language(spark, langs[0], "")
    assert stage.columns == langs[0].columns and {900, 901, 902}.isdisjoint({r["doc_id"] for r in stage.collect()}) and stage.count() == 151


# -- samples --------------------------------------------------------------------------------


def test_smallest_of_each_group(spark):
    rng = random.Random(8)
    rows = [("abc"[i % 3 if i % 2 else 0], rng.randrange(10**9)) for i in range(2000)] + [(None, 5), (None, 4), (None, 3), ("z", 1)]
    frame = spark.createDataFrame(rows, "g string, at long").repartition(150)
    want = [(g, x) for g in (None, "a", "b", "c", "z") for x in sorted(a for h, a in rows if h == g)[:40]]
    assert sorted(map(tuple, smallest(frame, "g", ("at",), 40).collect()), key=str) == sorted(want, key=str)


def is_held_out(key, n, rest):
    return zlib.crc32(str(key).encode()) % n == rest


@pytest.mark.parametrize("label, n, rest, query", [("toxic", 3, 1, toxicity.op2_toxic_clauses), ("quality", 5, 0, quality.op4_quality_gam)])
def test_query_scores_all_and_learns_from_its_fold(spark, tmp_path, label, n, rest, query):
    """Labels of held-out rows, lang and source don't change a score; a repeated or missing label repeats no document."""
    rng = random.Random(12)
    docs, labels, turned = [], [], []
    for i in range(300):
        bad = i % 3 == 0
        text = f"{prose(rng, 30)}. {prose(rng, 4)}{' idiot' if bad else ''}."
        docs.append((i, text.upper() if bad else text, "x", "y"))
        mark = int(bad) if label == "toxic" else int(not bad)
        if i % 10:
            labels.append((i, mark, mark))
            turned.append((i, *[1 - mark if is_held_out(i, n, rest) else mark] * 2))
    docs += [(900, None, None, None), (901, "", None, None)]
    results = []
    for name, marks, kind in (("a", labels + labels[:5], "p"), ("b", turned, "q")):
        at = tmp_path / name
        spark.createDataFrame([(*d[:2], kind, kind) for d in docs], "doc_id long, text string, lang string, source string").write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        results.append({r["doc_id"]: r for r in query(spark, str(at)).collect()})
    one, two = results
    assert set(one) == {d[0] for d in docs} and one == two
    assert all(r["held_out"] == is_held_out(i, n, rest) and 0 <= r["score"] <= 1 for i, r in one.items())
    limit = 0.7 if label == "toxic" else 0.3
    assert all(r["predicted"] == int(r["score"] >= limit) for r in one.values())
    right = [one[i]["predicted"] == mark for i, mark, _ in labels if is_held_out(i, n, rest)]
    assert sum(right) >= 0.9 * len(right)


# -- toxicity -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        word = ("zzrgl" + rng.choice(["a", "ung", "ste"])) if i % 8 == 0 else rng.choice(["idiot", "scum"])
        text = f"{prose(rng, 20)}. {prose(rng, 4)} {word if bad else ''} {prose(rng, 3)}. {prose(rng, 9)}"
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_and_learned_stems(toxic):
    docs, labels = toxic
    held_out = F.col("doc_id") % 3 == 1
    model = toxicity.fit(sample(docs, labels, "toxic", held_out, 100))
    assert [s for s in model["stems"] if s.startswith("zzrgl")] and len(model["stems"]) == 1
    got = toxicity.toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in got)


def test_patterns_of_clauses():
    read = toxicity.Reader(["zzrgl"])
    kinds = lambda text: [toxicity.patterns()[i] for i in np.flatnonzero(read(text))]
    assert kinds("you are an idiot") == [(("insult", False, False), True)]
    assert kinds("what a zzrglung it is") == [(("insult", False, False), False)]
    assert kinds("it is not stupid") == [(("insult", True, False), False)]
    assert kinds("not that it matters here in short, stupid") == [(("insult", False, False), False)]
    assert kinds("he said idiot") == [(("insult", False, True), True)]
    assert kinds("we will kill you") == [(("threat", False, False), True)]
    assert kinds("kindly idiotic killer skill") == []
    assert read("idiot. idiot\nnot idiot; idiot idiot").sum() == 4
    w = dict(zip(toxicity.patterns(), toxicity.priors(), strict=True))
    assert w[("insult", False, False), True] > w[("insult", False, False), False] > w[("insult", False, True), False] > w[("insult", True, True), False]


def test_compose_is_feeding_one_into_the_other():
    one = toxicity.negation()
    two = toxicity.reported(sorted({y for _, y in one[1].values()}))
    both = toxicity.compose(one, two)
    rng = random.Random(1)
    for _ in range(50):
        word, p, q, s = [rng.choice(one[2]) for _ in range(12)], one[0], two[0], both[0]
        for x in word:
            p, y = one[1][p, x]
            q, z = two[1][q, y]
            s, z2 = both[1][s, x]
            assert z == z2 and s == (p, q)


def test_toxicity_odd_rows(odd, empty, toxic):
    none = toxicity.fit(sample(toxic[0].limit(0), toxic[1].limit(0), "toxic", F.lit(False), 10))
    assert none["stems"] == []
    got = toxicity.toxicity(odd, none)
    assert got.count() == 4 and got.columns.count("score") == 1 and {r["predicted"] for r in got.collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0


# -- quality --------------------------------------------------------------------------------


def test_quality_by_form(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        t = prose(rng, rng.randint(20, 80)) + "."
        good = i % 3 != 0
        if not good:
            t = (t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join([t.split()[0]] * 40))[i // 3 % 3]
        rows.append((i, t))
        labels.append((i, int(good), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(sample(docs, marks, "quality", F.col("doc_id") % 5 == 0, 1000))
    got = quality.quality(docs, model).join(marks, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)
    again = quality.fit(sample(docs.repartition(5), marks, "quality", F.col("doc_id") % 5 == 0, 1000))
    assert np.array_equal(model["tables"][2], again["tables"][2])


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 8] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert (8, 3) in [(a, b) for a, b, _ in model["pairs"]]
    assert (((quality.additions(x, model) > 0) == (y > 0)).mean()) > 0.9


def test_features_are_those_of_each_text():
    texts = ["Aa bb bb 12!\nAa bb bb 12!", "", "| x | $%", "ONE", "\n\n"]
    both = quality.features(texts)
    for t, row in zip(texts, both, strict=True):
        assert np.allclose(quality.features([t])[0], row)
    names = dict(zip(quality.FEATURES, both[0], strict=True))
    assert names["words"] == pytest.approx(np.log1p(8)) and names["upper"] == pytest.approx(2 / 12)
    assert names["repeated_lines"] == 0.5 and names["doubled_words"] == pytest.approx(2 / 8) and names["shouts"] == pytest.approx(2 / 25)


def test_quality_odd_rows(odd, empty, spark):
    flat = quality.boost(np.empty((0, len(quality.FEATURES))), np.empty(0))
    assert {r["score"] for r in quality.quality(odd, flat).collect()} == {0.5}
    assert quality.quality(empty, flat).count() == 0
