"""Casts, dates, timestamps, names, keys, bands and deduplication."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.functions.bands import band, whole_years
from medalmart.functions.conform import canonical_name, compose_timestamp, matched_format, parse_date
from medalmart.functions.keys import hash_key
from medalmart.operators.dates import date_evidence, settle
from medalmart.operators.dedup import duplicate_groups, keep_first, split_null_keys, surplus_rows
from medalmart.operators.names import near_names
from medalmart.operators.registry import collisions, numbered, register, resolved
from medalmart.operators.rules import differs
from medalmart.operators.runs import dense_keys
from medalmart.sources.scratch import scratch_path

from .base import PARTY, RUN_AT, TX, dmy, iso, naive, query, role, sk, table

FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


@query(
    "typed_cast",
    f"""SELECT transaction_id, amount AS amount_text, TRY_CAST(amount AS DECIMAL(18,2)) AS amount,
          {iso('transaction_date')} AS transaction_date, TRY_CAST(split_part(transaction_id, '-', 2) AS INTEGER) AS line
        FROM ({TX}) t""",
)
def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, TX).select(
        "transaction_id",
        F.col("amount").alias("amount_text"),
        F.col("amount").try_cast("decimal(18,2)").alias("amount"),
        parse_date("transaction_date").alias("transaction_date"),
        F.split_part("transaction_id", F.lit("-"), F.lit(2)).try_cast("int").alias("line"),
    )


@query(
    "ts_compose",
    f"""SELECT transaction_id, transaction_date, transaction_time,
          coalesce({iso('transaction_date')}, {dmy('transaction_date')}) + CAST(transaction_time AS TIME) AS transaction_timestamp
        FROM ({TX}) t""",
)
def ts_compose(spark: SparkSession, d: str) -> DataFrame:
    at = compose_timestamp(parse_date("transaction_date", FORMATS), F.col("transaction_time"))
    return naive(
        role(spark, d, TX).select("transaction_id", "transaction_date", "transaction_time", at.alias("transaction_timestamp"))
    )


@query(
    "dq_date_formats",
    f"""SELECT transaction_id, transaction_date AS raw,
          coalesce({iso('transaction_date')}, {dmy('transaction_date')}) AS parsed,
          CASE WHEN {iso('transaction_date')} IS NOT NULL THEN 'yyyy-MM-dd'
            WHEN {dmy('transaction_date')} IS NOT NULL THEN 'dd/MM/yyyy' END AS format
        FROM ({TX}) t""",
)
def dq_date_formats(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, TX).select(
        "transaction_id",
        F.col("transaction_date").alias("raw"),
        parse_date("transaction_date", FORMATS).alias("parsed"),
        matched_format("transaction_date", FORMATS).alias("format"),
    )


@query(
    "currency_normalise",
    f"""SELECT transaction_id, currency AS raw_currency, 'ZAR' AS currency, coalesce(currency <> 'ZAR', false) AS is_variant
        FROM ({TX}) t""",
)
def currency_normalise(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, TX).select(
        "transaction_id",
        F.col("currency").alias("raw_currency"),
        F.lit("ZAR").alias("currency"),
        differs("currency", "ZAR")(F.col).alias("is_variant"),
    )


@query(
    "canonical_names",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'AUTOMOBILE' THEN 'Cars'
         WHEN 'MACHINERY' THEN 'Machinery' WHEN 'FURNITURE' THEN 'Furniture'
         ELSE concat('  ', lower(c_mktsegment), ' ') END AS segment
       FROM {customer}""",
)
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))).otherwise(
        F.concat(F.col("c_mktsegment"), F.lit(" "))
    )
    spelled = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))).otherwise(spelled)
    known = canonical_name(spelled, ["Building", "Machinery", "Furniture"], {"automobile": "Cars"})
    return table(spark, d, "customer").select("c_custkey", known.alias("segment"))


@query("sk_hash", f"SELECT o_orderkey, {sk('CAST(o_orderkey AS VARCHAR)')} AS account_sk FROM {{orders}}")
def sk_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hash_key("o_orderkey").alias("account_sk"))


@query(
    "sk_dense",
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS account_sk FROM {orders}",
)
def sk_dense(spark: SparkSession, d: str) -> DataFrame:
    return dense_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "account_sk")


@query(
    "sk_registry",
    """SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_orderkey)
         AS account_sk
       FROM {orders}""",
)
def sk_registry(spark: SparkSession, d: str) -> DataFrame:
    """Dense keys over three deliveries: each brings old orders again, whose numbers stay, and new ones."""
    path = scratch_path(spark, "registry")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for day, seen in enumerate((["F"], ["F", "O"], ["O", "P"])):
        known = register(orders.where(F.col("o_orderstatus").isin(seen)), "o_orderkey", path, RUN_AT + dt.timedelta(days=day))
    return numbered(orders.select("o_orderkey"), "o_orderkey", known, "account_sk")


def _short(level: int) -> str:
    text = "CAST(o_orderkey AS VARCHAR)" if level == 0 else f"'{level}|' || CAST(o_orderkey AS VARCHAR)"
    return f"(('0x' || substr(sha256({text}), 1, 4))::BIGINT + {level} * 1152921504606846976)"


_LEVELS = 5


@query(
    "sk_collisions",
    "WITH k AS (SELECT DISTINCT o_orderkey, CAST(o_orderkey AS VARCHAR) AS name, 0 AS moves FROM {orders}), "
    + ", ".join(
        f"l{n} AS (SELECT o_orderkey, name, h, min(name) OVER (PARTITION BY h) AS least FROM (SELECT o_orderkey, name, {_short(n)} AS h FROM "
        + ("k" if n == 0 else f"l{n - 1} WHERE name > least")
        + ") x)"
        for n in range(_LEVELS)
    )
    + " ".join([""] + [f"{'UNION ALL' if n else ''} SELECT o_orderkey, h AS account_sk FROM l{n} WHERE name = least" for n in range(_LEVELS)]),
)
def sk_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Keys of only 16 bits, so that many orders share one: all but the first of each move, and none meet."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("name"))
    return resolved(orders, "name", "account_sk", collisions(orders, "name", digits=4, widen=True), digits=4).drop("name")


_PARTY_AGE = f"CAST(floor(date_diff('day', CAST(dob AS DATE), DATE '{RUN_AT.date()}') / 365.25) AS INTEGER)"


@query(
    "age_band",
    f"""SELECT customer_id, dob, {_PARTY_AGE} AS age,
          CASE WHEN {_PARTY_AGE} >= 65 THEN '65+' WHEN {_PARTY_AGE} >= 56 THEN '56-65' WHEN {_PARTY_AGE} >= 46 THEN '46-55'
            WHEN {_PARTY_AGE} >= 36 THEN '36-45' WHEN {_PARTY_AGE} >= 26 THEN '26-35' WHEN {_PARTY_AGE} >= 18 THEN '18-25' END AS age_band
        FROM ({PARTY}) p""",
)
def age_band(spark: SparkSession, d: str) -> DataFrame:
    age = whole_years(parse_date("dob"), RUN_AT.date())
    return role(spark, d, PARTY).select("customer_id", "dob", age.alias("age"), band(age).alias("age_band"))


_LINE_ORDER = """PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"""


@query(
    "dedup_first",
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({_LINE_ORDER}) AS rn FROM {{lineitem}}) t WHERE rn = 1",
)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "lineitem"), LINE_KEY, ["l_shipdate", "l_partkey", "l_suppkey"])


@query(
    "dq_duplicates",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
          l_returnflag, l_linestatus, l_shipdate, count(*) AS removed
        FROM (SELECT *, row_number() OVER ({_LINE_ORDER}) AS rn FROM {{lineitem}}) t WHERE rn > 1 GROUP BY ALL""",
)
def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return surplus_rows(table(spark, d, "lineitem"), LINE_KEY, ["l_shipdate", "l_partkey", "l_suppkey"])


@query(
    "dq_duplicate_groups",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies, count(*) - 1 AS surplus
       FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def dq_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(table(spark, d, "lineitem"), LINE_KEY)


@query(
    "dq_null_pk",
    f"SELECT account_id, transaction_date, transaction_time, amount, channel FROM ({TX}) t WHERE transaction_id IS NULL",
)
def dq_null_pk(spark: SparkSession, d: str) -> DataFrame:
    _, without = split_null_keys(role(spark, d, TX), ["transaction_id"])
    return without.select("account_id", "transaction_date", "transaction_time", "amount", "channel")


_PROVINCES = ["Eastern Cape", "Free State", "Gauteng", "KwaZulu-Natal", "Limpopo", "Mpumalanga", "North West", "Northern Cape", "Western Cape"]
_SPELT = f"""SELECT CASE c % 5 WHEN 0 THEN p WHEN 1 THEN concat(substr(p, 1, 2), substr(p, 4)) WHEN 2 THEN concat(substr(p, 1, 2), 'q', substr(p, 3))
    WHEN 3 THEN concat(substr(p, 1, 2), 'q', substr(p, 4)) ELSE concat('zz', p) END AS province
  FROM (SELECT cast(substr(customer_id, 2) AS bigint) AS c, province AS p FROM ({PARTY}) x) y"""


@query(
    "names_near",
    f"""WITH v AS (SELECT DISTINCT province AS value, lower(regexp_replace(trim(province), '\\s+', ' ', 'g')) AS folded FROM ({_SPELT}) s),
      met AS (SELECT value, name, levenshtein(folded, lower(name)) AS edits FROM v, (SELECT unnest({_PROVINCES}) AS name) n WHERE levenshtein(folded, lower(name)) <= 1),
      best AS (SELECT value, min(edits) AS edits FROM met GROUP BY value),
      told AS (SELECT value, b.edits, string_agg(name, ',' ORDER BY name) AS near, count(*) AS n, min(name) AS name FROM best b JOIN met m USING (value) WHERE m.edits = b.edits GROUP BY value, b.edits)
      SELECT v.value, CASE WHEN n = 1 THEN name END AS name, CAST(edits AS INTEGER) AS edits, near FROM v LEFT JOIN told USING (value)""",
)
def names_near(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt provinces and the known name within one edit."""
    found = near_names(role(spark, d, _SPELT), "province", _PROVINCES)
    return found.withColumn("near", F.array_join("near", ","))


_DAY = "cast(cast(o_orderdate AS date) AS string)"
_DMY = f"concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', substr({_DAY}, 1, 4))"
_MDY = f"concat(substr({_DAY}, 6, 2), '/', substr({_DAY}, 9, 2), '/', substr({_DAY}, 1, 4))"
_DATED = f"""SELECT {_DMY} AS settled, CASE WHEN substr({_DAY}, 9, 2) < '13' THEN {_MDY} END AS unsettled,
  CASE WHEN o_orderkey % 2 = 0 THEN {_DMY} ELSE {_MDY} END AS mixed,
  CASE WHEN substr({_DAY}, 9, 2) = substr({_DAY}, 6, 2) THEN {_DMY} ELSE 'none' END AS indifferent FROM {{orders}}"""


def _read_as(column: str, pattern: str) -> str:
    return f"CAST(try_strptime({column}, '{pattern}') AS DATE)"


def _evidence(column: str) -> str:
    a, b = _read_as(column, "%d/%m/%Y"), _read_as(column, "%m/%d/%Y")
    return f"""SELECT '{column}' AS column_name, count(*) FILTER ({a} IS NOT NULL AND {b} IS NULL) AS first_alone,
      count(*) FILTER ({b} IS NOT NULL AND {a} IS NULL) AS second_alone, count(*) FILTER ({a} <> {b}) AS differing,
      count(*) FILTER ({a} IS NOT NULL OR {b} IS NOT NULL) AS seen FROM t"""


@query(
    "date_settle",
    f"WITH t AS ({_DATED}), e AS ("
    + " UNION ALL ".join(_evidence(c) for c in ("settled", "unsettled", "mixed", "indifferent"))
    + """) SELECT column_name,
      CASE WHEN seen = 0 THEN 'UNREAD' WHEN first_alone > 0 AND second_alone > 0 THEN 'MIXED' WHEN first_alone + second_alone > 0 THEN 'SETTLED'
        WHEN differing > 0 THEN 'UNSETTLED' ELSE 'INDIFFERENT' END AS verdict,
      CASE WHEN first_alone + second_alone > 0 AND (first_alone = 0 OR second_alone = 0) THEN CASE WHEN first_alone > 0 THEN 'dd/MM/yyyy' ELSE 'MM/dd/yyyy' END
        WHEN seen > 0 AND first_alone + second_alone = 0 AND differing = 0 THEN 'dd/MM/yyyy' END AS format,
      CASE WHEN first_alone > 0 AND second_alone > 0 OR first_alone + second_alone = 0 THEN differing ELSE 0 END AS ambiguous FROM e""",
)
def date_settle(spark: SparkSession, d: str) -> DataFrame:
    """Four columns of days in two orders, and which format each turns out to have."""
    return settle(date_evidence(role(spark, d, _DATED), ["settled", "unsettled", "mixed", "indifferent"], ["dd/MM/yyyy", "MM/dd/yyyy"]))
