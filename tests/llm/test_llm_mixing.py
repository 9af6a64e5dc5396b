import re

import duckdb
import pytest

from medalmart.llm.mixing import MIXING_SQL, mix, op1_source_mixing, position, stage_mixing, training_order, training_ranks
from pyspark.sql import functions as F


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        for s in full or list(open_):
            out[s] = 2.0 * sizes[s] if full else level * weight[s]
            open_.remove(s)
            rest -= out[s]
    return out


def test_targets_and_taken(docs, rows):
    got = mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    sizes = {}
    for i, _, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[r["source"]])
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)


def test_agrees_with_sql(docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[3:5] for r in con.execute(MIXING_SQL).fetchall()}
    assert {r["doc_id"]: (r["target"], r["taken"]) for r in mix(docs).collect()} == want


def test_positions_invert_the_demand(docs):
    got = mix(docs).where("copies > 0").withColumn("t", position(F.lit(0))).collect()
    for r in got:
        a, b, t = r["schedule_start"], r["schedule_end"], r["t"]
        assert 0 <= t <= 1
        assert r["target"] * (a * t + (b - a) * t * t / 2) == pytest.approx(r["before"] + r["size"] / 2)


def test_training_order_and_stage(spark, docs):
    mixed = mix(docs)
    order = training_order(mixed, docs.columns).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert len(order) == mixed.agg(F.sum("copies")).first()[0]
    stage = stage_mixing(spark, docs, "")
    assert stage.columns == docs.columns and stage.count() == len(order)


def test_ranks_follow_the_sort_over_all_partitions(docs):
    order = training_order(mix(docs), docs.columns)
    got = sorted(map(tuple, training_ranks(order).select("rank", "position", "doc_id", "pass").collect()))
    assert [r[0] for r in got] == list(range(1, len(got) + 1))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_query_agrees_with_sql(spark, docs, rows, tmp_path):
    """Ranks of all copies, of repeated keys and null sources too; documents without words have none."""
    more = spark.createDataFrame([(i, t, "en", s) for i, t, s in ((7000, None, "web"), (7001, "", None), (7002, "one", "zz"), (7002, "one two", "zz"))], "doc_id long, text string, lang string, source string")
    docs.select("doc_id", "text", "lang", "source").unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(MIXING_SQL)
    names = [d[0] for d in want.description]
    got = op1_source_mixing(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.where("last_rank > first_rank").count() > 0 and got.where("doc_id IN (7000, 7001) AND first_rank IS NULL").count() == 2


def test_odd_rows(odd, empty):
    got = mix(odd).collect()
    assert len(got) == 4 and [r["size"] for r in got if r["doc_id"] == 2] == [0]
    assert "a.b" in mix(odd).columns and mix(odd).columns.count("size") == 1
    assert mix(empty).count() == 0
