import re
from itertools import permutations
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from texts import SCHEMA

from medalmart.llm import filter_audit as fa

LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (30, 1, 0), (30, 0, 1), (None, 1, 1)]


def fails(rows):
    """(part, key, set of failed filters) of each row, one text after the other."""
    least = {}
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    for key, text, lang, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(words) < 100 else set()
        out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        out |= {"D"} if re.search("[#$%&*|]", t) else set()
        out |= {"E"} if key is not None and key > least[t] else set()
        yield lang or "", key, out


def brute(rows, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    found, out = list(fails(rows)), {}
    for part in {p for p, *_ in found}:
        docs = [(k, f) for p, k, f in found if p == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = [d for d in docs if letter in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(f == {letter} for _, f in docs),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ]
    for part in {p for p, *_ in found}:
        for letter in "ABCDE":
            at = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(total)
    return out


def result(frame):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in frame.collect()}


def more(rows):
    shout = " ".join(f"LOUD{i} word" for i in range(60))
    return [*rows, (100, shout, None, "a"), (101, shout, "", "a"), (101, shout, "en", "a"), (None, shout, "de", "a"), (102, "same " * 150 + "#", "en", None)]


def test_agrees_with_brute_force(spark, rows):
    all_rows = more(rows)
    docs = spark.createDataFrame(all_rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert result(fa.audit(docs, labels)) == brute(all_rows, LABELS)


def test_sql_agrees_with_brute_force(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    all_rows = [r for r in more(rows) if r[0] is not None]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", all_rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    found = con.execute(fa.AUDIT_SQL).fetchall()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in found} == brute(all_rows, LABELS)


def test_texts_beyond_a_shard_and_long_words(spark, rows):
    long = [(200, " ".join(f"w{i % 700}" for i in range(900)), "en", None), (201, "x" * 3000 + " " + "x" * 3001 + " x", "en", None)]
    all_rows = [*more(rows), *long]
    docs = spark.createDataFrame(all_rows, SCHEMA).repartition(2)
    matrix, dictionary, facts = fa.term_matrix(docs, shard_bytes=2000, shard_words=50, piece=100, part_bytes=3000)
    parts = {r.row: (r.words, r.distinct) for r in fa.word_counts(matrix).collect()}
    keys = {r.row: r.key for r in facts.collect()}
    want = sorted((k if k is not None else -1, len(w := re.findall(r"[^\x20\x09-\x0D]+", t or "")), len(set(w))) for k, t, *_ in all_rows)
    assert sorted((keys[r] if keys[r] is not None else -1, *parts[r]) for r in parts) == want
    assert matrix.selectExpr("explode(split) AS s").where("s").count() > 4
    assert dictionary.count() == dictionary.select("term").distinct().count() == len({w for _, t, *_ in all_rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")})


def test_the_matrix_is_the_counts_of_words(spark, rows):
    matrix, dictionary, facts = fa.term_matrix(spark.createDataFrame(rows, SCHEMA).repartition(2))
    words = {r.term: r.word.encode() for r in dictionary.collect()}
    keys = {r.row: r.key for r in facts.collect()}
    found = {}
    for s in matrix.collect():
        for i, row in enumerate(s.row):
            at = slice(s.first[i], s.first[i + 1])
            assert list(s.term[at]) == sorted(s.term[at])
            found[keys[row]] = {words[t]: n for t, n in zip(s.term[at], s.n[at])}
    for key, text, *_ in rows:
        own = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        assert {k: v for k, v in found[key].items() if len(k) <= fa.LONG_WORD and k[:1] != b"\t"} == {w: own.count(w) for w in set(own) if len(w) <= fa.LONG_WORD}


def test_a_task_never_holds_all_its_shards(spark, rows, monkeypatch):
    """Shards of one task are written in row groups, which is what a reader takes at once. Before, a file of up to 100 shards was one."""
    paths, stored = {}, fa.stored

    def spy(frame, name, *options):
        out = stored(frame, name, *options)
        paths[name] = out.stored_at
        return out

    monkeypatch.setattr(fa, "stored", spy)
    monkeypatch.setitem(fa.WIDE, "parquet.block.size", 8 << 10)
    many = [(k, f"{text} w{k}", lang, source) for k in range(20) for _, text, lang, source in rows if text]
    fa.term_matrix(spark.createDataFrame(many, SCHEMA).coalesce(1), shard_bytes=2000)
    groups = [g for f in Path(paths["term-shards"]).glob("*.parquet") for m in [pq.read_metadata(f)] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) > 20
    assert len(groups) > 2 and max(g.num_rows for g in groups) < 20


def test_any_frame_of_shards_is_summed_up(spark, rows):
    """The matrix itself is made and summed up in one worker, other frames of shards as they are."""
    matrix, _, _ = fa.term_matrix(spark.createDataFrame(rows, SCHEMA).repartition(2), shard_bytes=2000, shard_words=50, piece=100)
    found = []
    for frame in (matrix, matrix.select("*")):
        found.append(sorted(map(tuple, fa.word_counts(frame).collect())))
    assert found[0] == found[1] and matrix.coded.columns == ["shard", "row", "split", "first", "code", "n", "known"]


def test_odd_and_empty_input(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(empty, labels).count() == 0
    found = result(fa.audit(odd, labels))
    rows = [(r.doc_id, r.text, r.lang, None) for r in odd.collect()]
    assert found == brute(rows, [])


@pytest.mark.parametrize("n", [1, 3])
def test_any_number_of_filters(spark, n):
    failed = spark.createDataFrame([("p", k, 1, 0, 0) for k in range(2**n)], "part string, failed int, n long, good long, toxic long")
    out = fa.interactions(failed, "ABC"[:n])
    assert out.count() == len(list(permutations(range(n)))) * n
    assert {r.kept for r in out.where(f"step = {n}").collect()} == {1}
