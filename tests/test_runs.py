import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from medalmart.operators.profile import fan_out, null_ratios, numeric_profile, value_shares
from medalmart.operators.runs import dense_keys, exact_quantiles


def test_dense_keys_equal_row_number(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 10007).alias("k"), F.col("id").alias("x"))
    want = df.withColumn("sk", F.row_number().over(Window.orderBy("k")).cast("bigint"))
    got = dense_keys(df, ["k"], "sk")
    assert got.exceptAll(want).isEmpty() and got.count() == 5000


def test_dense_keys_need_no_single_task_sort(spark):
    df = spark.range(100).select("id")
    text = dense_keys(df, ["id"], "sk")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_are_exact(spark, hot):
    rng = np.random.default_rng(1)
    values = rng.normal(size=501).round(3)
    if hot:
        values[:200] = 0.5
    df = spark.createDataFrame([(float(v), float(-v)) for v in values] + [(None, None)], "a double, b double")
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.column_name: r for r in exact_quantiles(df, ["a", "b"], points).collect()}
    for name, sign in (("a", 1), ("b", -1)):
        for k, p in points.items():
            assert got[name][k] == pytest.approx(np.quantile(sign * values, p))


def test_profiles(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 3)], "s string, n int")
    shares = {(r.column_name, r.value): (r.n, r.pct) for r in value_shares(df, ["s"]).collect()}
    assert shares == {("s", "x"): (2, 66.67), ("s", None): (1, 33.33)}
    nulls = {r.column_name: (r.row_count, r.null_rows, r.null_pct) for r in null_ratios(df).collect()}
    assert nulls == {"s": (3, 1, 33.33), "n": (3, 1, 33.33)}
    row = numeric_profile(df, ["n"]).first()
    assert (row.value_count, row.mean, row.minimum, row.maximum, row.median) == (2, 2.0, 1.0, 3.0, 2.0)
    parents = spark.createDataFrame([(i,) for i in range(4)], "p int")
    children = spark.createDataFrame([(0,), (0,), (1,), (None,)], "c int")
    assert {tuple(r) for r in fan_out(parents, "p", children, "c").collect()} == {(0, 2), (1, 1), (2, 1)}
