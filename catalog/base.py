"""Registry, table access and the roles the given tables play.

``customer`` acts as the parties, ``orders`` as the accounts and ``lineitem`` as
the transactions. The role texts are SQL that Spark and the oracle read alike;
they turn every row of a table into a raw, partly dirty source record.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.config import Model, compile_rules, default_rules
from medalmart.operators.lookup import hot_keys_of
from medalmart.plans.bronze import MASK, stamp
from medalmart.plans.gold import dimension_frame, fact_frame
from medalmart.plans.silver import COPIES, silver_frame
from medalmart.sources.session import split_long_methods

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RUN_AT = dt.datetime(2026, 1, 15, 8, 0, tzinfo=dt.timezone.utc)
STAMP_SQL = "TIMESTAMP '2026-01-15 08:00:00'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its oracle. ``{table}`` in the SQL names a given table."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = oracle_text(sql)
        return fn

    return add


def oracle_text(sql: str) -> str:
    return re.sub(r"\{([a-z]+)\}", r"\1", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{([a-z]+)\}", sql))
    split_long_methods(spark)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


# Parties: nine provinces in varying spelling, dates of birth over 68 years,
# a risk score that leaves its range for some.
PARTY = """
SELECT concat('C', cast(c_custkey AS string)) AS customer_id,
  '****' AS id_number, c_name AS first_name, c_name AS last_name,
  cast(date '1940-01-01' + cast((c_custkey * 37) % 25000 AS int) AS string) AS dob,
  CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'NB' ELSE 'UNKNOWN' END AS gender,
  CASE c_nationkey % 9
    WHEN 0 THEN 'Eastern Cape' WHEN 1 THEN 'FREE STATE' WHEN 2 THEN ' gauteng ' WHEN 3 THEN 'KwaZulu-Natal'
    WHEN 4 THEN 'limpopo' WHEN 5 THEN 'Mpumalanga' WHEN 6 THEN 'North  West' WHEN 7 THEN 'Northern Cape'
    ELSE 'western cape' END AS province,
  CASE WHEN c_acctbal < 0 THEN 'LOW' WHEN c_acctbal < 3000 THEN 'LOWER_MIDDLE' WHEN c_acctbal < 6000 THEN 'MIDDLE'
    WHEN c_acctbal < 9000 THEN 'UPPER_MIDDLE' ELSE 'HIGH' END AS income_band,
  c_mktsegment AS segment,
  CASE WHEN c_nationkey = 7 THEN '11' WHEN c_nationkey = 13 THEN 'n/a' ELSE cast(c_custkey % 10 + 1 AS string) END AS risk_score,
  CASE WHEN c_acctbal < 0 THEN 'FAILED' ELSE 'VERIFIED' END AS kyc_status,
  'SA|CA' AS product_flags
FROM {customer}
"""

# Accounts: some refer to a customer that does not exist, some dates are d/m/y.
ACCOUNT = """
SELECT cast(o_orderkey AS string) AS account_id,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice < 20000 THEN concat('X', cast(o_custkey AS string))
    ELSE concat('C', cast(o_custkey AS string)) END AS customer_ref,
  CASE o_orderstatus WHEN 'F' THEN 'SAVINGS' WHEN 'O' THEN 'TRANSACTIONAL' ELSE 'CREDIT' END AS account_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'DORMANT' WHEN '2-HIGH' THEN 'CLOSED' ELSE 'ACTIVE' END AS account_status,
  cast(cast(o_orderdate AS date) AS string) AS open_date,
  CASE WHEN o_totalprice > 300000 THEN 'PREMIUM' ELSE 'BASIC' END AS product_tier,
  cast(NULL AS string) AS mobile_number, 'APP' AS digital_channel,
  CASE WHEN o_orderstatus = 'P' THEN cast(o_custkey + 4500 AS string) END AS credit_limit,
  cast(cast(o_totalprice AS decimal(18,2)) AS string) AS current_balance,
  CASE WHEN o_orderpriority = '3-MEDIUM'
    THEN concat(substr(cast(cast(o_orderdate AS date) AS string), 9, 2), '/', substr(cast(cast(o_orderdate AS date) AS string), 6, 2),
      '/', substr(cast(cast(o_orderdate AS date) AS string), 1, 4))
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
    ELSE cast(cast(o_orderdate AS date) AS string) END AS last_activity_date
FROM {orders}
"""

# Transactions: natural duplicates of (l_orderkey, l_linenumber), and one kind
# of dirt per column.
TX = """
SELECT
  CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN NULL
    ELSE concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) END AS transaction_id,
  CASE WHEN l_quantity = 11 AND l_linenumber = 2 THEN NULL
    WHEN l_quantity = 12 AND l_linenumber < 4 THEN concat('X', cast(l_suppkey AS string))
    ELSE cast(l_orderkey AS string) END AS account_id,
  CASE WHEN l_quantity = 21
    THEN concat(substr(cast(cast(l_shipdate AS date) AS string), 9, 2), '/', substr(cast(cast(l_shipdate AS date) AS string), 6, 2),
      '/', substr(cast(cast(l_shipdate AS date) AS string), 1, 4))
    WHEN l_quantity = 22 AND l_linenumber = 1 THEN concat(substr(cast(cast(l_shipdate AS date) AS string), 1, 4), '-3-2')
    WHEN l_quantity = 22 AND l_linenumber = 2 THEN ''
    ELSE cast(cast(l_shipdate AS date) AS string) END AS transaction_date,
  CASE WHEN l_quantity = 23 AND l_linenumber = 6 THEN NULL
    ELSE concat(lpad(cast(l_partkey % 24 AS string), 2, '0'), ':', lpad(cast(l_suppkey % 60 AS string), 2, '0'), ':05') END AS transaction_time,
  CASE WHEN l_returnflag = 'A' THEN 'DEBIT' WHEN l_returnflag = 'N' THEN 'CREDIT'
    WHEN l_linestatus = 'O' THEN 'FEE' ELSE 'REVERSAL' END AS transaction_type,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('MCC', cast(l_suppkey % 20 AS string)) END AS merchant_category,
  CASE WHEN l_quantity = 31 AND l_linenumber = 3 THEN 'abc'
    WHEN l_quantity = 31 AND l_linenumber = 4 THEN NULL
    ELSE cast(cast(l_extendedprice AS decimal(18,2)) AS string) END AS amount,
  CASE WHEN l_quantity = 31 AND l_linenumber = 4 THEN NULL
    WHEN l_quantity IN (31, 32) THEN 'STRING' ELSE 'NUMBER' END AS amount_kind,
  CASE WHEN l_quantity = 41 THEN 'R' WHEN l_quantity = 42 THEN 'rands' WHEN l_quantity = 43 THEN '710'
    WHEN l_quantity = 44 AND l_linenumber = 5 THEN NULL ELSE 'ZAR' END AS currency,
  CASE WHEN l_quantity = 45 AND l_linenumber < 3 THEN 'FAX' WHEN l_suppkey % 3 = 0 THEN 'POS'
    WHEN l_suppkey % 3 = 1 THEN 'APP' ELSE 'ATM' END AS channel,
  CASE WHEN l_linestatus = 'O' THEN 'Gauteng' ELSE 'Limpopo' END AS province,
  concat('City', cast(l_suppkey % 10 AS string)) AS city, cast(NULL AS string) AS coordinates,
  cast(NULL AS string) AS device_id, cast(NULL AS string) AS session_id, l_tax = 0 AS retry_flag
FROM {lineitem}
"""

def iso(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({col} AS DATE) END"


def dmy(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime({col}, '%d/%m/%Y') AS DATE) END"


def sk(col: str) -> str:
    return f"CAST(('0x' || substr(sha256({col}), 1, 15)) AS BIGINT)"


# Oracle form of the rules and the silver layer, built from the role texts.
SILVER_PARTY_SQL = f"""
SELECT customer_id, id_number, first_name, last_name, TRY_CAST(dob AS DATE) AS dob, gender,
  CASE lower(regexp_replace(trim(province), '\\s+', ' ', 'g'))
    WHEN 'eastern cape' THEN 'Eastern Cape' WHEN 'free state' THEN 'Free State' WHEN 'gauteng' THEN 'Gauteng'
    WHEN 'kwazulu-natal' THEN 'KwaZulu-Natal' WHEN 'limpopo' THEN 'Limpopo' WHEN 'mpumalanga' THEN 'Mpumalanga'
    WHEN 'north west' THEN 'North West' WHEN 'northern cape' THEN 'Northern Cape' WHEN 'western cape' THEN 'Western Cape'
    ELSE province END AS province,
  income_band, segment, TRY_CAST(risk_score AS INTEGER) AS risk_score, kyc_status, product_flags,
  {STAMP_SQL} AS ingestion_timestamp,
  CASE WHEN TRY_CAST(risk_score AS INTEGER) NOT BETWEEN 1 AND 10 OR (risk_score IS NOT NULL AND TRY_CAST(risk_score AS INTEGER) IS NULL)
    THEN 'TYPE_MISMATCH' END AS dq_flag
FROM ({PARTY}) p
"""

SILVER_ACCOUNT_SQL = f"""
SELECT account_id, customer_ref, account_type, account_status, CAST(open_date AS DATE) AS open_date, product_tier,
  mobile_number, digital_channel, TRY_CAST(credit_limit AS DECIMAL(18,2)) AS credit_limit,
  TRY_CAST(current_balance AS DECIMAL(18,2)) AS current_balance,
  coalesce({iso('last_activity_date')}, {dmy('last_activity_date')}) AS last_activity_date,
  {STAMP_SQL} AS ingestion_timestamp, true AS customer_linked,
  CASE WHEN TRY_CAST(credit_limit AS DECIMAL(18,2)) NOT BETWEEN 5000 AND 250000 THEN 'TYPE_MISMATCH'
    WHEN {iso('last_activity_date')} IS NULL AND last_activity_date IS NOT NULL THEN 'DATE_FORMAT' END AS dq_flag
FROM ({ACCOUNT}) a
WHERE customer_ref IN (SELECT concat('C', CAST(c_custkey AS VARCHAR)) FROM {{customer}})
"""

TX_RULES_SQL = f"""
SELECT t.*,
  transaction_id IS NULL AS b_null_key,
  (account_id IS NULL OR transaction_date IS NULL OR transaction_time IS NULL OR amount IS NULL
    OR transaction_type IS NULL OR currency IS NULL OR channel IS NULL) AS b_null,
  coalesce(amount_kind = 'STRING' AND TRY_CAST(amount AS DECIMAL(18,2)) IS NOT NULL, false) AS b_quoted,
  amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(18,2)) IS NULL AS b_cast,
  coalesce(transaction_type NOT IN ('DEBIT', 'CREDIT', 'FEE', 'REVERSAL'), false) AS b_type,
  coalesce(channel NOT IN ('POS', 'APP', 'ATM', 'EFT', 'USSD', 'INTERNAL'), false) AS b_channel,
  {iso('transaction_date')} IS NULL AND {dmy('transaction_date')} IS NOT NULL AS b_other_date,
  transaction_date IS NOT NULL AND {iso('transaction_date')} IS NULL AND {dmy('transaction_date')} IS NULL AS b_bad_date,
  coalesce(currency <> 'ZAR', false) AS b_currency,
  coalesce({iso('transaction_date')}, {dmy('transaction_date')}) AS day
FROM ({TX}) t
"""

FLAG_SQL = """CASE WHEN b_null_key OR b_null THEN 'NULL_REQUIRED'
  WHEN b_quoted OR b_cast OR b_type OR b_channel THEN 'TYPE_MISMATCH'
  WHEN b_other_date OR b_bad_date THEN 'DATE_FORMAT'
  WHEN b_currency THEN 'CURRENCY_VARIANT' END"""

# Every transaction that may stay, with its rank among the copies of its key.
TX_RANKED_SQL = f"""
SELECT r.*, a.customer_ref, a.customer_linked, day + CAST(transaction_time AS TIME) AS moment,
  count(*) OVER (PARTITION BY transaction_id) AS copies,
  row_number() OVER (PARTITION BY transaction_id ORDER BY day + CAST(transaction_time AS TIME) NULLS LAST,
    r.account_id NULLS FIRST, day NULLS FIRST, transaction_time NULLS FIRST, transaction_type NULLS FIRST,
    merchant_category NULLS FIRST, TRY_CAST(amount AS DECIMAL(18,2)) NULLS FIRST, amount_kind NULLS FIRST,
    channel NULLS FIRST, province NULLS FIRST, city NULLS FIRST, retry_flag NULLS FIRST,
    b_null, b_quoted, b_channel, b_other_date, b_currency) AS rn
FROM ({TX_RULES_SQL}) r
LEFT JOIN ({SILVER_ACCOUNT_SQL}) a ON r.account_id = a.account_id
WHERE NOT b_null_key AND NOT b_cast AND NOT b_bad_date AND (r.account_id IS NULL OR a.account_id IS NOT NULL)
"""

SILVER_TX_SQL = f"""
SELECT transaction_id, account_id, day AS transaction_date, transaction_time, transaction_type, merchant_category,
  CAST(amount AS DECIMAL(18,2)) AS amount, 'ZAR' AS currency, channel, {STAMP_SQL} AS ingestion_timestamp,
  province, city, coordinates, device_id, session_id, retry_flag, moment AS transaction_timestamp,
  customer_ref AS customer_id, customer_linked, customer_linked IS NOT NULL AS account_linked, {FLAG_SQL} AS dq_flag
FROM ({TX_RANKED_SQL}) x WHERE rn = 1
"""

_AGE = f"CAST(floor(date_diff('day', dob, DATE '{RUN_AT.date()}') / 365.25) AS INTEGER)"

DIM_CUSTOMER_SQL = f"""
SELECT {sk('customer_id')} AS customer_sk, customer_id, gender, province, income_band, segment, risk_score, kyc_status,
  CASE WHEN {_AGE} >= 65 THEN '65+' WHEN {_AGE} >= 56 THEN '56-65' WHEN {_AGE} >= 46 THEN '46-55'
    WHEN {_AGE} >= 36 THEN '36-45' WHEN {_AGE} >= 26 THEN '26-35' WHEN {_AGE} >= 18 THEN '18-25' END AS age_band
FROM ({SILVER_PARTY_SQL}) p
"""

DIM_ACCOUNT_SQL = f"""
SELECT {sk('account_id')} AS account_sk, account_id, customer_ref AS customer_id, account_type, account_status, open_date,
  product_tier, digital_channel, credit_limit, current_balance, last_activity_date
FROM ({SILVER_ACCOUNT_SQL}) a
"""

FACT_SQL = f"""
SELECT {sk('transaction_id')} AS transaction_sk, transaction_id,
  CASE WHEN account_linked THEN {sk('account_id')} END AS account_sk,
  CASE WHEN customer_linked THEN {sk('customer_id')} END AS customer_sk,
  transaction_date, transaction_timestamp, transaction_type, merchant_category, amount, currency, channel, province,
  dq_flag, ingestion_timestamp
FROM ({SILVER_TX_SQL}) t
"""


class Bank:
    """The banking model over the role tables. Layers are frames over each other; nothing is written."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.model = Model.load()
        doc = default_rules()
        self.rules = {n: compile_rules(doc, t) for n, t in self.model.tables.items()}
        self._texts = {"customers": PARTY, "accounts": ACCOUNT, "transactions": TX}
        self._silver: dict[str, DataFrame] = {}

    def rows(self, name: str) -> DataFrame:
        """The role's rows, for readers of few columns: no other column's text is evaluated."""
        return role(self.spark, self.sf_dir, self._texts[name])

    def raw(self, name: str) -> DataFrame:
        """The role's rows. They pass a generator, which keeps the texts above from being copied into every rule."""
        rows = self.rows(name)
        return rows.select(F.inline(F.array(F.struct(*rows.columns))))

    def hot(self, name: str) -> DataFrame | None:
        """Hot keys of the column that links the role's rows, counted without what else the text says of them."""
        link = self.model.tables[name].link
        return hot_keys_of(self.rows(name), link.field) if link else None

    def bronze(self, name: str) -> DataFrame:
        return stamp(self.raw(name), RUN_AT)

    def one_silver(self, name: str) -> DataFrame:
        """The same frame every time, so that plans over it can share its exchanges."""
        if name not in self._silver:
            self._silver[name] = self.silver(name)
        return self._silver[name]

    def parent(self, name: str) -> DataFrame | None:
        link = self.model.tables[name].link
        return self.one_silver(link.table) if link else None

    def silver(self, name: str) -> DataFrame:
        return self.silver_with_metrics(name).drop(MASK, COPIES)

    def silver_with_metrics(self, name: str) -> DataFrame:
        return silver_frame(self.bronze(name), self.model.tables[name], self.rules[name], self.parent(name), hot=self.hot(name))

    def dimension(self, name: str, keys: str = "hash") -> DataFrame:
        dim = self.model.dimensions[name]
        return dimension_frame(self.one_silver(dim.table), dim, RUN_AT.date(), keys)

    def fact(self) -> DataFrame:
        spec = self.model.facts["fact_transactions"]
        return fact_frame(self.silver("transactions"), spec, {}, self.model.dimensions)


def naive(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock time, the form the oracle's timestamps have."""
    names = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c in names})
