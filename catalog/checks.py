"""Validation queries and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.functions.keys import hash_key
from medalmart.operators.checks import (
    agreement_check,
    constant_check,
    enum_check,
    key_check,
    member_check,
    reference_check,
    rerun_check,
)
from medalmart.operators.dedup import keep_first
from medalmart.operators.lookup import estimated_bytes, hot_keys, key_counts, lookup
from medalmart.operators.rules import FLAGS
from medalmart.plans.validation import group_distribution, unlinked, volume_by_type

from .base import (
    ACCOUNT,
    DIM_ACCOUNT_SQL,
    DIM_CUSTOMER_SQL,
    FACT_SQL,
    PARTY,
    SILVER_PARTY_SQL,
    TX,
    Bank,
    query,
    role,
    sk,
    table,
)

LINE_KEY = ["l_orderkey", "l_linenumber"]

# The province names every mart of this model is expected to show.
PROVINCES = [
    "Eastern Cape",
    "Free State",
    "Gauteng",
    "KwaZulu-Natal",
    "Limpopo",
    "Mpumalanga",
    "North West",
    "Northern Cape",
    "Western Cape",
]


def _volume_sql(source: str, kind: str, measure: str) -> str:
    return f"""SELECT {kind}, count(*) AS record_count, CAST(sum({measure}) AS DECIMAL(38,2)) AS total_amount,
        CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS pct_of_total
      FROM ({source}) f GROUP BY {kind} ORDER BY {kind}"""


@query("val_volume_by_type", _volume_sql(FACT_SQL, "transaction_type", "amount"))
def val_volume_by_type(spark: SparkSession, d: str) -> DataFrame:
    return volume_by_type(Bank(spark, d).fact(), "transaction_type", "amount")


_STAR_SQL = f"""
SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM {{lineitem}}) l
JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
WHERE rn = 1
"""


def star_volume(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicate the facts, give them keys, resolve both dimensions, report by type."""
    order = ["l_shipdate", "l_partkey", "l_suppkey"]
    # Only what the report needs enters the shuffle; the order leaves no ties.
    lines = table(spark, d, "lineitem").select(*LINE_KEY, *order, "l_returnflag", "l_extendedprice")
    facts = keep_first(lines, LINE_KEY, order).select(
        hash_key(*LINE_KEY).alias("line_sk"),
        "l_orderkey",
        "l_returnflag",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    parties = table(spark, d, "customer").withColumn("party_sk", hash_key("c_custkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", hash_key("o_orderkey").alias("order_sk"))
    keys = lookup(orders, parties, ("o_custkey", "c_custkey"), {"party_sk": "party_sk"})
    # One row per order with one more column: no larger than the two tables together.
    size = estimated_bytes(orders) + estimated_bytes(parties)
    hot = hot_keys(key_counts(table(spark, d, "lineitem"), "l_orderkey"), "l_orderkey")
    both = {"order_sk": "order_sk", "party_sk": "party_sk"}
    star = lookup(facts, keys, ("l_orderkey", "o_orderkey"), both, hot=hot, size=size)
    linked = star.filter(F.col("order_sk").isNotNull() & F.col("party_sk").isNotNull())
    return volume_by_type(linked, "l_returnflag", "amount")


query("star_volume", _volume_sql(_STAR_SQL, "l_returnflag", "amount"))(star_volume)


@query(
    "val_unlinked_accounts",
    f"""SELECT count(*) AS unlinked_accounts FROM ({ACCOUNT}) a LEFT JOIN ({PARTY}) c ON a.customer_ref = c.customer_id
        WHERE c.customer_id IS NULL""",
)
def val_unlinked_accounts(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    return unlinked(bank.raw("accounts"), "customer_ref", bank.raw("customers"), "customer_id", "unlinked_accounts")


@query(
    "val_group_distribution",
    f"""SELECT c.province, count(DISTINCT a.account_id) AS account_count FROM ({DIM_ACCOUNT_SQL}) a
        JOIN ({DIM_CUSTOMER_SQL}) c ON a.customer_id = c.customer_id GROUP BY c.province ORDER BY c.province""",
)
def val_group_distribution(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    accounts, customers = bank.dimension("dim_accounts"), bank.dimension("dim_customers")
    return group_distribution(accounts, "account_id", "customer_id", customers, "customer_id", "province", "account_count")


@query(
    "chk_key_unique",
    f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (line_sk IS NULL) AS null_keys,
          count(*) FILTER (n > 1) AS repeated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
        FROM (SELECT {sk("CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)")} AS line_sk, count(*) AS n
              FROM {{lineitem}} GROUP BY 1) t""",
)
def chk_key_unique(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(hash_key(*LINE_KEY).alias("line_sk"))
    return key_check(lines, "line_sk")


def _link_sql(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{name}' AS link, count(DISTINCT {key}) AS unmatched_keys, count(*) AS unmatched_rows FROM ({child}) c
      WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM ({parent}) p)"""


@query(
    "chk_fk",
    " UNION ALL ".join(
        [
            _link_sql("transactions -> accounts", TX, "account_id", ACCOUNT, "account_id"),
            _link_sql("accounts -> customers", ACCOUNT, "customer_ref", PARTY, "customer_id"),
            _link_sql("lineitem -> orders", "SELECT * FROM {lineitem}", "l_orderkey", "SELECT * FROM {orders}", "o_orderkey"),
            _link_sql("fact -> dim_accounts", FACT_SQL, "account_sk", DIM_ACCOUNT_SQL, "account_sk"),
            _link_sql("fact -> dim_customers", FACT_SQL, "customer_sk", DIM_CUSTOMER_SQL, "customer_sk"),
        ]
    ),
)
def chk_fk(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    accounts, parties = bank.raw("accounts"), bank.raw("customers")
    fact = bank.fact()
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return reference_check(
        {
            "transactions -> accounts": (bank.rows("transactions"), "account_id", accounts, "account_id"),
            "accounts -> customers": (accounts, "customer_ref", parties, "customer_id"),
            "lineitem -> orders": (lines, "l_orderkey", orders, "o_orderkey"),
            "fact -> dim_accounts": (fact, "account_sk", bank.dimension("dim_accounts"), "account_sk"),
            "fact -> dim_customers": (fact, "customer_sk", bank.dimension("dim_customers"), "customer_sk"),
        }
    )


@query(
    "chk_flag_enum",
    f"""SELECT 'channel' AS column_name, channel AS value, count(*) AS n FROM ({TX}) t
          WHERE channel NOT IN ('POS', 'APP', 'ATM', 'EFT', 'USSD', 'INTERNAL') GROUP BY channel
        UNION ALL SELECT 'dq_flag', dq_flag, count(*) FROM ({FACT_SQL}) f WHERE dq_flag NOT IN ('NULL_REQUIRED', 'TYPE_MISMATCH',
          'DATE_FORMAT', 'CURRENCY_VARIANT', 'ORPHANED_ACCOUNT', 'DUPLICATE_DEDUPED') GROUP BY dq_flag""",
)
def chk_flag_enum(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    channels = enum_check(bank.rows("transactions"), "channel", ["POS", "APP", "ATM", "EFT", "USSD", "INTERNAL"])
    flags = enum_check(bank.fact(), "dq_flag", FLAGS)
    return channels.select(F.lit("channel").alias("column_name"), F.col("channel").alias("value"), "n").unionByName(
        flags.select(F.lit("dq_flag").alias("column_name"), F.col("dq_flag").alias("value"), "n")
    )


@query(
    "chk_constant",
    f"""SELECT 'source' AS layer, count(*) AS row_count, count(*) FILTER (currency IS DISTINCT FROM 'ZAR') AS deviating_rows FROM ({TX}) t
        UNION ALL SELECT 'gold', count(*), count(*) FILTER (currency IS DISTINCT FROM 'ZAR') FROM ({FACT_SQL}) f""",
)
def chk_constant(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    raw = constant_check(bank.rows("transactions"), "currency", "ZAR").withColumn("layer", F.lit("source"))
    gold = constant_check(bank.fact(), "currency", "ZAR").withColumn("layer", F.lit("gold"))
    return raw.unionByName(gold)


@query(
    "chk_attr_agreement",
    f"""SELECT count(*) AS compared_rows, count(*) FILTER (f.province IS DISTINCT FROM c.province) AS differing_rows
        FROM ({FACT_SQL}) f JOIN ({DIM_CUSTOMER_SQL}) c ON f.customer_sk = c.customer_sk""",
)
def chk_attr_agreement(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    return agreement_check(
        bank.fact(), "customer_sk", "province", bank.dimension("dim_customers"), "customer_sk", "province"
    )


@query(
    "chk_members",
    f"""SELECT coalesce(f.province, e.name) AS member, coalesce(n, 0) AS n, e.name IS NOT NULL AS expected
        FROM (SELECT province, count(*) AS n FROM ({SILVER_PARTY_SQL}) p WHERE province IS NOT NULL GROUP BY province) f
        FULL JOIN (SELECT unnest([{", ".join(repr(p) for p in [*PROVINCES[1:], "Lesotho"])}]) AS name) e ON f.province = e.name""",
)
def chk_members(spark: SparkSession, d: str) -> DataFrame:
    """One name too many and one too few in the list, so that both kinds of finding show."""
    return member_check(Bank(spark, d).silver("customers"), "province", [*PROVINCES[1:], "Lesotho"])


@query(
    "chk_rerun_stable",
    """SELECT count(*) AS first_rows, count(*) AS second_rows, CAST(0 AS BIGINT) AS differing_rows
       FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem}) t""",
)
def chk_rerun_stable(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in another order and partitioning must give the same kept rows and keys."""
    lines = table(spark, d, "lineitem")

    def run(df: DataFrame) -> DataFrame:
        return keep_first(df, LINE_KEY, ["l_shipdate"]).withColumn("line_sk", hash_key(*LINE_KEY))

    return rerun_check(run(lines), run(lines.repartition("l_partkey").sortWithinPartitions(F.desc("l_shipdate"))))
