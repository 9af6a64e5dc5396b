import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from medalmart.operators.dedup import duplicate_groups, keep_first, split_null_keys, surplus_rows

SCHEMA = "k string, t int, v string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_earliest_row_wins_whatever_the_input_order(spark):
    rows = [("a", 3, "x"), ("a", 1, "z"), ("a", 1, "y"), ("a", None, "w"), ("b", None, "q")]
    for _ in range(3):
        random.shuffle(rows)
        got = keep_first(spark.createDataFrame(rows, SCHEMA), ["k"], ["t"]).collect()
        assert {tuple(r) for r in got} == {("a", 1, "y"), ("b", None, "q")}


def test_null_keys_do_not_collapse(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), ("a", 1, "x")], SCHEMA)
    kept, without = split_null_keys(df, ["k"])
    assert (kept.count(), without.count()) == (1, 2)


def test_mark_tells_of_further_copies(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], SCHEMA)
    assert {(r.k, r.t, r.many) for r in keep_first(df, ["k"], ["t"], mark="many").collect()} == {("a", 1, True), ("b", 1, False)}


def test_copies_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    for mark in (None, "many"):
        text = plan(keep_first(df, ["k"], ["t"], mark))
        assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1
        assert text.rindex("WindowGroupLimit") > text.index("Exchange")
        assert text.count("Sort [") == 2  # one on each side of the shuffle, none for the mark


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2), st.sampled_from(["x", "y"])), max_size=12))
def test_kept_and_surplus_make_up_the_source(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    whole, without = split_null_keys(df, ["k"])
    kept = keep_first(whole, ["k"], ["t"])
    removed = surplus_rows(whole, ["k"], ["t"]).collect()
    n_kept, n_null = kept.count(), without.count()
    assert n_kept == len({r[0] for r in rows if r[0] is not None})
    assert n_kept + n_null + sum(r.removed for r in removed) == len(rows)
    groups = duplicate_groups(whole, ["k"]).collect()
    assert sum(g.surplus for g in groups) == sum(r.removed for r in removed)
