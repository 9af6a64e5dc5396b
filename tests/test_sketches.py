import numpy as np
import pytest

from medalmart.operators.profile import numeric_profile
from medalmart.operators.sketches import approximate_quantiles, merged, quantile_sketches, rank_error, sketched_quantiles

POINTS = {"p0": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "p100": 1.0}


def off(values, value, p):
    """By how much p misses the ranks of the value."""
    low, high = np.mean(values < value), np.mean(values <= value)
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("kind", ["even", "sorted", "skewed", "hot"])
def test_ranks_are_within_the_bound(spark, kind):
    rng = np.random.default_rng(3)
    values = {"even": rng.random(60_000), "sorted": np.arange(60_000.0), "skewed": rng.lognormal(0, 4, 60_000), "hot": np.where(rng.random(60_000) < 0.4, 7.0, rng.normal(size=60_000))}[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(6)
    got = approximate_quantiles(df, ["x"], POINTS, size=800).first()
    for name, p in POINTS.items():
        assert off(values, got[name], p) <= rank_error(800) and got[name] in values
    assert (got.p0, got.p100) == (values.min(), values.max())


def test_stored_sketches_merge_as_if_made_at_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    days = [rng.normal(d, 1, 5000) for d in range(4)]
    for d, values in enumerate(days):
        df = spark.createDataFrame([("ab"[i % 2], float(v), None) for i, v in enumerate(values)], "g string, x double, n int")
        quantile_sketches(df, ["x", "n"], ["g"]).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    out = {r.g: r for r in sketched_quantiles(merged(stored, ["g"]), POINTS).collect()}
    assert set(out) == {"a", "b"} and out["a"].column_name == "x"
    for k, g in enumerate("ab"):
        mine = np.concatenate([v[k::2] for v in days])
        assert out[g].value_count == len(mine)
        for name, p in POINTS.items():
            assert off(mine, out[g][name], p) <= rank_error()


def test_small_inputs_are_exact_and_odd_values_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (None, None), (float("nan"), None)], "x double, y double")
    rows = {r.column_name: r for r in approximate_quantiles(df, ["x", "y"], POINTS).collect()}
    assert set(rows) == {"x"} and [rows["x"][n] for n in ("p0", "median", "p100")] == [1.0, 2.0, 3.0]
    assert approximate_quantiles(df.limit(0), ["x"], POINTS).count() == 0


def test_profile_takes_either_way(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    exact, near = (numeric_profile(df, ["x"], {"median": 0.5}, exact=e).first() for e in (True, False))
    assert exact == near


def test_no_rows_are_shuffled_and_nothing_is_written(spark):
    df = spark.range(10_000).selectExpr("cast(id AS double) AS x")
    plan = approximate_quantiles(df, ["x"], POINTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan and "rangepartitioning" not in plan
