"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.operators.profile import fan_out, null_ratios, numeric_profile, value_shares
from medalmart.operators.sketches import merged, quantile_sketches, rank_error, sketched_quantiles

from .base import PARTY, TX, query, role, table


@query(
    "profile_share",
    f"""SELECT column_name, value, count(*) AS n, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM {{customer}}), 2) AS DOUBLE) AS pct
        FROM (SELECT 'gender' AS column_name, gender AS value FROM ({PARTY}) p
              UNION ALL SELECT 'segment', segment FROM ({PARTY}) p
              UNION ALL SELECT 'risk_score', risk_score FROM ({PARTY}) p) t GROUP BY column_name, value""",
)
def profile_share(spark: SparkSession, d: str) -> DataFrame:
    return value_shares(role(spark, d, PARTY), ["gender", "segment", "risk_score"])


_NULLABLE = ["transaction_id", "account_id", "transaction_time", "merchant_category", "amount", "currency", "channel"]


@query(
    "profile_nulls",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_rows,
              CAST(round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 2) AS DOUBLE) AS null_pct FROM ({TX}) t"""
        for c in _NULLABLE
    ),
)
def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return null_ratios(role(spark, d, TX), _NULLABLE)


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS value_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
              min({c}) AS minimum, max({c}) AS maximum, round(quantile_cont({c}, 0.05), 4) AS p05,
              round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.95), 4) AS p95 FROM {{lineitem}}"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    points = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    out = numeric_profile(table(spark, d, "lineitem"), columns, points)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "stddev", *points)})


@query(
    "profile_fanout",
    """SELECT children, count(*) AS parents FROM (
         SELECT c_custkey, count(o_orderkey) AS children FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey
         GROUP BY c_custkey) t GROUP BY children""",
)
def profile_fanout(spark: SparkSession, d: str) -> DataFrame:
    return fan_out(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query(
    "profile_sketch",
    """SELECT l_returnflag, 'l_extendedprice' AS column_name, count(*) AS value_count, true AS p05, true AS median, true AS p95
       FROM {lineitem} GROUP BY l_returnflag""",
)
def profile_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles by group from sketches that were made by day and merged; whether their ranks are right.

    The rank of a quantile is between the shares of smaller values and of those that aren't larger.
    """
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice")
    points = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    daily = quantile_sketches(lines, ["l_extendedprice"], ["l_returnflag", "l_shipdate"])
    found = sketched_quantiles(merged(daily, ["l_returnflag"]), points)
    # One row for each group and column.
    told = lines.join(F.broadcast(found.withColumnRenamed("l_returnflag", "flag")), F.col("l_returnflag") == F.col("flag"))
    ranks = [F.avg((F.col("l_extendedprice") < F.col(n)).cast("double")).alias(f"{n}_low") for n in points]
    ranks += [F.avg((F.col("l_extendedprice") <= F.col(n)).cast("double")).alias(f"{n}_high") for n in points]
    seen = told.groupBy("l_returnflag", "column_name", "value_count").agg(*ranks)
    right = [((F.col(f"{n}_low") <= p + rank_error()) & (F.col(f"{n}_high") >= p - rank_error())).alias(n) for n, p in points.items()]
    return seen.select("l_returnflag", "column_name", "value_count", *right)
