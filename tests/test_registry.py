import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import medalmart
from medalmart.functions.keys import LEVELS, RANGE, WIDE_LEVELS, hash_key
from medalmart.operators.registry import collisions, next_numbers, numbered, read_registry, register, resolved, unregistered
from medalmart.sources import writers
from support import RUN_AT

DAY = dt.timedelta(days=1)


def numbers(known):
    return {r.natural_key: r.surrogate_key for r in known.collect()}


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def test_old_keys_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = numbers(register(keys(spark, ["b", "d", None, "b", "a"]), "k", path, RUN_AT))
    assert first == {"a": 1, "b": 2, "d": 3}
    second = numbers(register(keys(spark, ["c", "d", "z", "aa"]), "k", path, RUN_AT + DAY))
    assert second == {**first, "aa": 4, "c": 5, "z": 6}
    # A delivery without new keys leaves no batch, and keys that are gone keep their numbers.
    assert numbers(register(keys(spark, ["z"]), "k", path, RUN_AT + 2 * DAY)) == second
    assert len(writers.stored_batches(spark, path)) == 2
    seen = {r.natural_key: r.first_seen for r in read_registry(spark, path).collect()}
    assert seen["a"] < seen["c"] == seen["z"]


def test_numbers_agree_with_a_plain_account_over_many_deliveries(spark, tmp_path):
    rng, path, want = random.Random(4), str(tmp_path / "r"), {}
    for day in range(5):
        names = [f"n{rng.randrange(60)}" for _ in range(40)]
        for n in sorted(set(names) - set(want)):
            want[n] = len(want) + 1
        assert numbers(register(keys(spark, names).repartition(3), "k", path, RUN_AT + day * DAY)) == want


def test_a_delivery_that_fails_leaves_no_number(spark, tmp_path):
    path = str(tmp_path / "r")
    register(keys(spark, ["a"]), "k", path, RUN_AT)
    fresh = unregistered(keys(spark, ["b"]), "k", read_registry(spark, path))
    broken = next_numbers(fresh, read_registry(spark, path), RUN_AT).withColumn("surrogate_key", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        writers.write_batch(broken, path)
    assert numbers(read_registry(spark, path)) == {"a": 1}
    assert numbers(register(keys(spark, ["b"]), "k", path, RUN_AT)) == {"a": 1, "b": 2}


def test_empty_registries_and_deliveries(spark, tmp_path):
    path = str(tmp_path / "r")
    assert numbers(read_registry(spark, path)) == {}
    assert numbers(register(keys(spark, []), "k", path, RUN_AT)) == {} and writers.stored_batches(spark, path) == []
    df = numbered(keys(spark, ["x", None]), "k", register(keys(spark, ["y"]), "k", path, RUN_AT), "n")
    assert {r.n for r in df.collect()} == {None}


@pytest.mark.parametrize("kind, values", [("bigint", [5, 3]), ("date", [dt.date(2024, 5, 1), dt.date(2023, 5, 1)])])
def test_keys_of_other_types(spark, tmp_path, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    assert numbers(register(df, "k", str(tmp_path / "r"), RUN_AT)) == {v: i for i, v in enumerate(sorted(values), 1)}


def test_collisions_leave_keys_unique_and_repeatable(spark):
    names = [f"key {i}" for i in range(300)]
    df = keys(spark, [*names, *names[:50], None])
    moved = collisions(df, "k", digits=2)
    got = {r.k: r.s for r in resolved(df, "k", "s", moved, digits=2).distinct().collect()}
    assert len(set(got.values())) == len(names) + 1 and got[None] is None
    plain = {r.k: r.s for r in df.select("k", hash_key("k", digits=2).alias("s")).distinct().collect()}
    by_hash = {}
    for k in names:
        by_hash.setdefault(plain[k], []).append(k)
    for h, group in by_hash.items():
        assert got[min(group)] == h
        assert all(got[k] >= RANGE for k in group if k != min(group))
    again = collisions(df.repartition(5), "k", digits=2)
    assert {r.k: r.s for r in resolved(df, "k", "s", again, digits=2).distinct().collect()} == got


def test_moved_keys_depend_on_their_group_alone(spark):
    names = [f"key {i}" for i in range(120)]
    small = numbers(collisions(keys(spark, names), "k", digits=3))
    more = numbers(collisions(keys(spark, [*names, *[f"z other {i}" for i in range(40)]]), "k", digits=3))
    assert small.items() <= more.items()


def test_no_collision_costs_no_join(spark):
    assert collisions(keys(spark, ["a", "b", "a", None]), "k") is None
    assert collisions(keys(spark, []), "k") is None


def test_keys_beyond_all_ranges_are_told(spark):
    with pytest.raises(ValueError, match=f"after {LEVELS} ranges"):
        collisions(keys(spark, [f"k{i}" for i in range(400)]), "k", digits=1)


def test_widened_keys_settle_more_keys_than_the_ranges_hold(spark):
    """400 keys, 16 hashes in each of 8 ranges."""
    names = [f"k{i}" for i in range(400)]
    df = keys(spark, [*names, names[0], None])
    moved = collisions(df, "k", digits=1, widen=True)
    got = {r.k: r.s for r in resolved(df, "k", "s", moved, digits=1).distinct().collect()}
    assert len(got) == len(set(got.values())) == 401 and got[None] is None
    assert all(0 <= got[k] < 1 << 63 for k in names)
    short = {k for k in names if got[k] % RANGE < 16}
    assert 8 * 14 < len(short) <= 8 * 16
    again = collisions(df.repartition(5), "k", digits=1, widen=True)
    assert numbers(again) == numbers(moved)


def test_wide_levels_share_no_key(spark):
    starts = [spark.range(1).select(hash_key(F.lit("x"), digits=4, level=n).alias("h")).first().h >> 56 for n in (1, 7, 8, 15, 16, LEVELS + WIDE_LEVELS)]
    assert starts == [1 << 4, 7 << 4, 1, (7 << 4) + 1, 2, (7 << 4) + 15]
    for wrong in ({"digits": 15, "level": LEVELS + 1}, {"digits": 4, "level": LEVELS + WIDE_LEVELS + 1}):
        with pytest.raises(ValueError, match="no level"):
            hash_key(F.lit("x"), **wrong)


def test_a_mart_over_shortened_hashes_keeps_its_links(spark, extracts, rules_doc, monkeypatch):
    """With four bits every table has collisions; facts must still meet their own parents."""
    from medalmart.operators import registry
    from medalmart.plans import gold, medallion

    short = lambda f: lambda *a, **k: f(*a, **{**k, "digits": 1})
    monkeypatch.setattr(medallion, "collisions", short(registry.collisions))
    monkeypatch.setattr(gold, "resolved", short(registry.resolved))
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.run()
    accounts = {r.account_id: r for r in m.table("gold", "dim_accounts").collect()}
    customers = {r.customer_id: r for r in m.table("gold", "dim_customers").collect()}
    facts = m.table("gold", "fact_transactions").collect()
    silver = {r.transaction_id: r for r in m.table("silver", "transactions").collect()}
    assert m.known["fact_transactions"] is not None
    assert len({r.transaction_sk for r in facts}) == len(facts) == 17
    for f in facts:
        s = silver[f.transaction_id]
        assert f.account_sk == (accounts[s.account_id].account_sk if s.account_linked else None)
        assert f.customer_sk == (customers[s.customer_id].customer_sk if s.customer_linked else None)
    checks = {r.check: r.violations for r in m.checks().collect()}
    assert not [c for c, n in checks.items() if n and ("_sk" in c or "->" in c)]


def test_registered_keys_link_and_outlive_runs(spark, extracts, rules_doc):
    def facts(**config):
        m = medalmart.Medallion(spark, {**extracts, "surrogate_keys": "registry", **config}, rules_doc, run_at=RUN_AT)
        m.run()
        accounts = {r.account_id: r.account_sk for r in m.table("gold", "dim_accounts").collect()}
        rows = {r.transaction_id: (r.transaction_sk, r.account_sk) for r in m.table("gold", "fact_transactions").collect()}
        return accounts, rows, m

    accounts, rows, m = facts()
    assert accounts == {"a1": 1, "a2": 2} and sorted(sk for sk, _ in rows.values()) == list(range(1, 18))
    assert rows["t23"][1] == 2 and rows["t18"][1] is None
    with open(extracts["input"]["accounts_path"], "a", encoding="utf-8") as f:
        f.write("a0,c1,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,1.00,2025-01-02\n")
    lines = open(extracts["input"]["transactions_path"], encoding="utf-8").read().splitlines()
    from support import tx

    open(extracts["input"]["transactions_path"], "w", encoding="utf-8").write("\n".join([tx("s01", account_id="a0"), *lines[5:]]) + "\n")
    later, new_rows, m = facts()
    assert later == {"a0": 3, "a1": 1, "a2": 2}
    assert new_rows["s01"] == (18, 3)
    assert all(new_rows[k] == rows[k] for k in set(rows) & set(new_rows)) and "t01" not in new_rows
