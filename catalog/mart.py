"""Silver and gold tables, and the complete run over text extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.config import default_rules
from medalmart.functions.keys import hash_key
from medalmart.operators.dedup import keep_first, split_null_keys
from medalmart.operators.drift import deliveries, observed_types, record_types, stored_types, type_changes
from medalmart.operators.lookup import estimated_bytes, hot_keys_of, lookup
from medalmart.plans.gold import resolved_keys
from medalmart.plans.medallion import Medallion
from medalmart.sources.layout import ByKey, buckets_for, linked, read_by_key, unlinked_keys, write_by_key
from medalmart.sources.scratch import scratch_path

from .base import (
    ACCOUNT,
    DIM_ACCOUNT_SQL,
    DIM_CUSTOMER_SQL,
    FACT_SQL,
    PARTY,
    RUN_AT,
    SILVER_ACCOUNT_SQL,
    SILVER_PARTY_SQL,
    SILVER_TX_SQL,
    TX,
    Bank,
    naive,
    query,
    role,
    sk,
    table,
)


@query("silver_party", SILVER_PARTY_SQL)
def silver_party(spark: SparkSession, d: str) -> DataFrame:
    return naive(Bank(spark, d).silver("customers"))


@query("silver_account", SILVER_ACCOUNT_SQL)
def silver_account(spark: SparkSession, d: str) -> DataFrame:
    return naive(Bank(spark, d).silver("accounts"))


@query("silver_tx", SILVER_TX_SQL)
def silver_tx(spark: SparkSession, d: str) -> DataFrame:
    return naive(Bank(spark, d).silver("transactions"))


@query(
    "silver_linkage",
    f"""SELECT account_id, customer_ref,
          customer_ref IN (SELECT concat('C', CAST(c_custkey AS VARCHAR)) FROM {{customer}}) AS customer_linked
        FROM ({ACCOUNT}) a""",
)
def silver_linkage(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    accounts = bank.raw("accounts").select("account_id", "customer_ref")
    return lookup(accounts, bank.raw("customers"), ("customer_ref", "customer_id"), {}, found="customer_linked")


@query("gold_dim_customer", DIM_CUSTOMER_SQL)
def gold_dim_customer(spark: SparkSession, d: str) -> DataFrame:
    return Bank(spark, d).dimension("dim_customers")


@query("gold_dim_account", DIM_ACCOUNT_SQL)
def gold_dim_account(spark: SparkSession, d: str) -> DataFrame:
    return Bank(spark, d).dimension("dim_accounts")


@query("gold_fact", FACT_SQL)
def gold_fact(spark: SparkSession, d: str) -> DataFrame:
    return naive(Bank(spark, d).fact())


_FIRST_TX = f"""
SELECT * FROM (
  SELECT t.*, row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date NULLS LAST, transaction_time NULLS LAST,
    account_id NULLS FIRST, transaction_type NULLS FIRST, merchant_category NULLS FIRST, amount NULLS FIRST,
    amount_kind NULLS FIRST, currency NULLS FIRST, channel NULLS FIRST, province NULLS FIRST, city NULLS FIRST,
    retry_flag NULLS FIRST) AS rn
  FROM ({TX}) t WHERE transaction_id IS NOT NULL) x
WHERE rn = 1
"""


@query(
    "gold_fact_lookup",
    f"""SELECT {sk('t.transaction_id')} AS transaction_sk, t.transaction_id,
          CASE WHEN a.account_id IS NOT NULL THEN {sk('t.account_id')} END AS account_sk,
          CASE WHEN p.customer_id IS NOT NULL THEN {sk('a.customer_ref')} END AS customer_sk
        FROM ({_FIRST_TX}) t
        LEFT JOIN ({ACCOUNT}) a ON t.account_id = a.account_id
        LEFT JOIN ({PARTY}) p ON a.customer_ref = p.customer_id""",
)
def gold_fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Both surrogate keys by join: the dimensions meet first, the fact joins once."""
    with_key, _ = split_null_keys(role(spark, d, TX), ["transaction_id"])
    facts = keep_first(with_key, ["transaction_id"], ["transaction_date", "transaction_time"])
    accounts = role(spark, d, ACCOUNT).withColumn("account_sk", hash_key("account_id"))
    parties = role(spark, d, PARTY).withColumn("customer_sk", hash_key("customer_id"))
    keys = resolved_keys(accounts, ("account_id", "account_sk", "customer_ref"), parties, ("customer_id", "customer_sk"))
    narrow = facts.select(hash_key("transaction_id").alias("transaction_sk"), "transaction_id", "account_id")
    both = {"account_sk": "account_sk", "customer_sk": "customer_sk"}
    size = estimated_bytes(accounts.select("account_id", "account_sk")) + estimated_bytes(parties.select("customer_sk"))
    hot = hot_keys_of(role(spark, d, TX), "account_id")
    return lookup(narrow, keys, ("account_id", "account_id"), both, hot=hot, size=size).drop("account_id")


# One key holds a third of all rows, some rows have none, and some keys have no parent.
_REF_SQL = """SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' AND l_quantity > 40 THEN NULL
  WHEN l_quantity = 7 THEN -l_orderkey - 1 ELSE l_orderkey END AS ref FROM {lineitem}"""
_LINKED_SQL = f"""SELECT l.l_linenumber, l.l_suppkey, l.ref, o.o_custkey AS owner, o.o_orderkey IS NOT NULL AS found
  FROM ({_REF_SQL}) l LEFT JOIN {{orders}} o ON l.ref = o.o_orderkey"""


def _referring(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    ref = (
        F.when(F.col("l_returnflag") == "R", 1)
        .when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), F.lit(None).cast("bigint"))
        .when(F.col("l_quantity") == 7, -F.col("l_orderkey") - 1)
        .otherwise(F.col("l_orderkey"))
    )
    return table(spark, d, "lineitem").select(*columns, ref.alias("ref"))


@query("lookup_hot_keys", _LINKED_SQL)
def lookup_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """The way of the lookup beyond the broadcast limit: one key holds a third of all rows."""
    facts = _referring(spark, d, "l_linenumber", "l_suppkey")
    orders = table(spark, d, "orders")
    return lookup(facts, orders, ("ref", "o_orderkey"), {"owner": "o_custkey"}, found="found", limit=0)


def _stored_by_key(spark: SparkSession, d: str) -> tuple[ByKey, ByKey]:
    """Facts and orders as layer tables by the key that joins them."""
    facts, orders = _referring(spark, d, "l_linenumber", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    paths, n = [scratch_path(spark, f"by-key-{name}") for name in ("facts", "orders")], buckets_for(facts, orders)
    write_by_key(facts, paths[0], "ref", n, ["l_suppkey", "l_linenumber"])
    write_by_key(orders, paths[1], "o_orderkey", n, ["o_orderkey"], hot=())
    return read_by_key(spark, paths[0]), read_by_key(spark, paths[1])


@query("layout_lookup", _LINKED_SQL)
def layout_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The same lookup over tables that are stored by key: no fact moves."""
    facts, orders = _stored_by_key(spark, d)
    return linked(facts, orders, "o_orderkey", {"owner": "o_custkey"}, found="found")


@query("layout_orphans", f"SELECT ref, count(*) AS n FROM ({_LINKED_SQL}) t WHERE NOT found AND ref IS NOT NULL GROUP BY ref")
def layout_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Keys without a parent, counted bucket by bucket."""
    return unlinked_keys(*_stored_by_key(spark, d), "o_orderkey")


#: Text takes a seventh of its disk so. Such a file is read by one task, so none has very many lines.
_EXTRACT = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 50_000}


def write_extracts(spark: SparkSession, d: str, root: str) -> dict[str, str]:
    """The role tables as two CSV sources and one JSON-lines source, compressed."""
    paths = {n: f"{root}/{n}" for n in ("customers", "accounts", "transactions")}
    role(spark, d, PARTY).write.options(**_EXTRACT, header=True).csv(paths["customers"])
    role(spark, d, ACCOUNT).write.options(**_EXTRACT, header=True).csv(paths["accounts"])
    json_lines(role(spark, d, TX)).write.options(**_EXTRACT).text(paths["transactions"])
    return {f"{n}_path": p for n, p in paths.items()}


def json_lines(rows: DataFrame, *more: Column) -> DataFrame:
    """Transactions as they are delivered, a line each; with ``more`` fields."""
    quoted = F.concat(F.lit('"'), F.col("amount"), F.lit('"'))
    delivered = F.when(F.col("amount_kind") == "STRING", quoted).otherwise(F.col("amount"))
    nested = rows.select(
        "transaction_id",
        "account_id",
        "transaction_date",
        "transaction_time",
        "transaction_type",
        "merchant_category",
        F.parse_json(delivered).alias("amount"),
        "currency",
        "channel",
        F.struct("province", "city", "coordinates").alias("location"),
        F.struct("device_id", "session_id", "retry_flag").alias("metadata"),
        *more,
    )
    return nested.select(F.to_json(F.struct("*")).alias("value"))


def configured(spark: SparkSession, d: str) -> dict:
    """A configuration over text extracts, everything in a fresh folder."""
    root = scratch_path(spark, "medallion")
    layers = {f"{layer}_path": f"{root}/{layer}" for layer in ("bronze", "silver", "gold", "report")}
    return {"input": write_extracts(spark, d, f"{root}/in"), "output": layers}


def medallion(spark: SparkSession, d: str, **config: object) -> Medallion:
    """A run of all layers from text extracts in a fresh folder."""
    run = Medallion(spark, {**configured(spark, d), **config}, default_rules(), run_at=RUN_AT)
    run.run()
    return run


@query("medallion_fact", FACT_SQL)
def medallion_fact(spark: SparkSession, d: str) -> DataFrame:
    """The gold fact of a complete run: extracts, bronze, silver and gold on disk."""
    return naive(medallion(spark, d).table("gold", "fact_transactions"))


@query("medallion_by_key", FACT_SQL)
def medallion_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The same with layers that are stored by the account, so that linking them moves no transaction."""
    by_account = {
        "bronze": {"transactions": "account_id"},
        "silver": {"accounts": "account_id"},
        "gold": {"fact_transactions": "account_sk", "dim_accounts": "account_sk"},
    }
    return naive(medallion(spark, d, stored_by=by_account).table("gold", "fact_transactions"))


@query(
    "json_type_drift",
    f"""SELECT '$.amount' AS path, 'NEW_KIND' AS change, 'STRING' AS kind, count(*) AS rows, 0::BIGINT AS rows_before, true AS declared
        FROM ({TX}) t WHERE amount_kind = 'STRING' HAVING count(*) > 0
        UNION ALL
        SELECT '$.loyalty', 'NEW_FIELD', 'NUMBER', count(*), 0::BIGINT, false FROM ({TX}) t WHERE transaction_type = 'FEE' HAVING count(*) > 0""",
)
def json_type_drift(spark: SparkSession, d: str) -> DataFrame:
    """A delivery of numbers only, then one whose amounts are in part quoted and which has a new field."""
    path = scratch_path(spark, "types")
    rows = role(spark, d, TX)
    loyalty = F.when(F.col("transaction_type") == "FEE", 3).alias("loyalty")
    for day, lines in enumerate((json_lines(rows.where("amount_kind = 'NUMBER'")), json_lines(rows, loyalty))):
        record_types(observed_types(lines), path, str(day))
    before, after = (stored_types(spark, path, day) for day in deliveries(spark, path))
    return type_changes(before, after, ["amount"])
