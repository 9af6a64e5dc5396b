"""Stamping, round trips through the text formats, alignment and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.operators.shape import align, flatten, schema_report
from medalmart.operators.profile import null_ratios
from medalmart.plans.bronze import stamp
from medalmart.sources.readers import read_csv, read_jsonl
from medalmart.sources.scratch import scratch_path

from .base import RUN_AT, STAMP_SQL, Bank, naive, query, table


@query(
    "bronze_stamp",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {STAMP_SQL} AS ingestion_timestamp
        FROM {{orders}}""",
)
def bronze_stamp(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return naive(stamp(orders, RUN_AT))


@query(
    "csv_roundtrip",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_clerk
       FROM {orders}""",
)
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    orders.write.option("header", True).csv(path)
    schema = "o_orderkey string, o_orderstatus string, o_orderpriority string, o_orderdate string, o_clerk string"
    return read_csv(spark, path, schema).drop("_corrupt_record")


@query(
    "jsonl_roundtrip",
    """SELECT event_id, event_type, user_id AS k_user, CAST(props->>'k' AS INTEGER) AS k_value,
         CAST(value AS DECIMAL(18,2)) AS amount,
         CASE WHEN user_id % 2 = 0 THEN 'STRING' ELSE 'NUMBER' END AS amount_kind
       FROM {events}""",
)
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    delivered = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('"'), amount, F.lit('"'))).otherwise(amount)
    events = table(spark, d, "events").select(
        "event_id",
        "event_type",
        F.struct("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("context"),
        F.parse_json(delivered).alias("amount"),
    )
    events.select(F.to_json(F.struct("*"))).write.text(path)
    schema = "event_id bigint, event_type string, context struct<user_id:bigint,k:int>, amount variant"
    df = read_jsonl(spark, path, schema)
    return df.select(
        "event_id",
        "event_type",
        F.col("context.user_id").alias("k_user"),
        F.col("context.k").alias("k_value"),
        F.col("amount").try_cast("decimal(18,2)").alias("amount"),
        "amount_kind",
    )


@query(
    "jsonl_drift",
    """SELECT event_id, event_type, CASE WHEN event_id % 10 <> 0 THEN true END AS flag, event_id % 10 = 0 AS misfit,
         CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS loyalty
       FROM {events}""",
)
def jsonl_drift(spark: SparkSession, d: str) -> DataFrame:
    """A field that nobody declared comes back with its value; a value of another type leaves the line's text."""
    path = scratch_path(spark, "drift")
    flag = F.when(F.col("event_id") % 10 == 0, F.lit('"maybe"')).otherwise(F.lit("true"))
    loyalty = F.when(F.col("user_id") % 3 == 0, F.col("user_id"))
    events = table(spark, d, "events").select("event_id", "event_type", F.parse_json(flag).alias("flag"), loyalty.alias("loyalty"))
    events.select(F.to_json(F.struct("*"))).write.text(path)
    df = read_jsonl(spark, path, "event_id bigint, event_type string, flag boolean")
    return df.select(
        "event_id",
        "event_type",
        "flag",
        F.col("_corrupt_record").isNotNull().alias("misfit"),
        F.col("_undeclared")["loyalty"].alias("loyalty"),
    )


@query(
    "json_flatten",
    """SELECT event_id, user_id, event_type, CAST(props->>'k' AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS source
       FROM {events}""",
)
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.from_json("props", "k INT").alias("props")
    )
    return flatten(events, {"props": ["k", "source"], "absent": ["x"]})


@query(
    "schema_align",
    """SELECT p_partkey, p_name, CAST(NULL AS DATE) AS p_until, CAST(NULL AS DECIMAL(18,2)) AS p_cost,
         p_brand, p_type, p_size FROM {part}""",
)
def schema_align(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").drop("p_retailprice")
    return align(part, "p_partkey bigint, p_name string, p_until date, p_cost decimal(18,2)")


_ACCOUNT_TYPES = [
    ("account_sk", "bigint"),
    ("account_id", "string"),
    ("customer_id", "string"),
    ("account_type", "string"),
    ("account_status", "string"),
    ("open_date", "date"),
    ("product_tier", "string"),
    ("digital_channel", "string"),
    ("credit_limit", "decimal(18,2)"),
    ("current_balance", "decimal(18,2)"),
    ("last_activity_date", "date"),
]


def _schema_sql() -> str:
    from .base import ACCOUNT

    source = {"account_sk": "account_id", "customer_id": "customer_ref"}
    rows = []
    for i, (name, kind) in enumerate(_ACCOUNT_TYPES, 1):
        rows.append(
            f"SELECT '{name}' AS column_name, {i} AS expected_position, {i} AS found_position, "
            f"'{kind}' AS expected_type, '{kind}' AS found_type, true AS conforms, "
            f"(SELECT count(*) FROM live) AS row_count, "
            f"(SELECT count(*) FROM live WHERE {source.get(name, name)} IS NULL) AS null_rows"
        )
    live = f"SELECT * FROM ({ACCOUNT}) a WHERE customer_ref IN (SELECT concat('C', CAST(c_custkey AS VARCHAR)) FROM {{customer}})"
    return f"WITH live AS ({live}) " + " UNION ALL ".join(rows)


@query("chk_schema", _schema_sql())
def chk_schema(spark: SparkSession, d: str) -> DataFrame:
    """Names, order and types against the contract, and the nulls each column really holds."""
    bank = Bank(spark, d)
    dim = bank.dimension("dim_accounts")
    contract = bank.model.dimensions["dim_accounts"].contract
    nulls = null_ratios(dim).select("column_name", "row_count", "null_rows")
    return schema_report(dim, contract).join(F.broadcast(nulls), "column_name", "left")
