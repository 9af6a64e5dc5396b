"""Rules, flags, handling, counts and the report."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medalmart.config import default_rules
from medalmart.operators import rules as R
from medalmart.operators.lookup import lookup
from medalmart.operators.rules import REMOVED
from medalmart.plans.bronze import MASK, STAMP, stamp
from medalmart.plans.medallion import Medallion
from medalmart.plans.replay import held_back
from medalmart.plans.report import disposition_counts
from medalmart.plans.silver import COPIES, orphan_keys, removed_rows, silver_frame
from medalmart.sources.scratch import scratch_path
from medalmart.sources.writers import write_table

from .base import (
    ACCOUNT,
    FLAG_SQL,
    PARTY,
    RUN_AT,
    SILVER_ACCOUNT_SQL,
    TX,
    TX_RANKED_SQL,
    TX_RULES_SQL,
    Bank,
    query,
    role,
)
from .mart import configured, medallion

_REQUIRED = ["account_id", "transaction_date", "transaction_time", "amount", "transaction_type", "currency", "channel"]


def _flagged(spark: SparkSession, d: str, text: str, *rules: R.Rule) -> DataFrame:
    df = role(spark, d, text)
    ruleset = R.RuleSet(rules)
    return df.withColumn("dq_flag", ruleset.flag(ruleset.mask(df)))


@query(
    "dq_null_required",
    f"SELECT transaction_id, amount, CASE WHEN b_null THEN 'NULL_REQUIRED' END AS dq_flag FROM ({TX_RULES_SQL}) t",
)
def dq_null_required(spark: SparkSession, d: str) -> DataFrame:
    rule = R.Rule("null_required", "NULL_REQUIRED", "FLAGGED", R.missing(*_REQUIRED), tuple(_REQUIRED))
    return _flagged(spark, d, TX, rule).select("transaction_id", "amount", "dq_flag")


@query(
    "dq_currency_variant",
    f"SELECT transaction_id, currency, CASE WHEN b_currency THEN 'CURRENCY_VARIANT' END AS dq_flag FROM ({TX_RULES_SQL}) t",
)
def dq_currency_variant(spark: SparkSession, d: str) -> DataFrame:
    rule = R.Rule("currency_variants", "CURRENCY_VARIANT", "NORMALISED_CURRENCY", R.differs("currency", "ZAR"))
    return _flagged(spark, d, TX, rule).select("transaction_id", "currency", "dq_flag")


@query(
    "dq_orphan_flag",
    f"""SELECT transaction_id, account_id,
          CASE WHEN account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM ({ACCOUNT}) a)
            THEN 'ORPHANED_ACCOUNT' END AS dq_flag
        FROM ({TX}) t""",
)
def dq_orphan_flag(spark: SparkSession, d: str) -> DataFrame:
    tx = role(spark, d, TX).select("transaction_id", "account_id")
    linked = lookup(tx, role(spark, d, ACCOUNT), ("account_id", "account_id"), {}, found="linked")
    rules = R.RuleSet([R.Rule("orphaned_transactions", "ORPHANED_ACCOUNT", "QUARANTINED")])
    orphan = F.col("account_id").isNotNull() & ~F.col("linked")
    mask = rules.set_bit(F.lit(0).cast("bigint"), "orphaned_transactions", orphan)
    return linked.select("transaction_id", "account_id", rules.flag(mask).alias("dq_flag"))


@query(
    "dq_type_check",
    f"""SELECT transaction_id, amount, amount_kind, b_quoted AS delivered_as_text, b_cast AS cast_failed
        FROM ({TX_RULES_SQL}) t""",
)
def dq_type_check(spark: SparkSession, d: str) -> DataFrame:
    quoted = R.quoted("amount", "amount_kind", "decimal(18,2)")(F.col)
    return role(spark, d, TX).select(
        "transaction_id",
        "amount",
        "amount_kind",
        F.coalesce(quoted, F.lit(False)).alias("delivered_as_text"),
        R.uncastable("amount", "decimal(18,2)")(F.col).alias("cast_failed"),
    )


@query(
    "dq_cast_lost",
    f"""SELECT customer_id, risk_score, dob,
          CASE WHEN risk_score IS NOT NULL AND TRY_CAST(risk_score AS INTEGER) IS NULL THEN 'TYPE_MISMATCH' END AS dq_flag
        FROM ({PARTY}) p""",
)
def dq_cast_lost(spark: SparkSession, d: str) -> DataFrame:
    """The rules that every typed column has: a value that can't be typed is told before silver loses it."""
    bank = Bank(spark, d)
    rules, own = bank.rules["customers"].rules, ("risk_score_cast_failed", "dob_unreadable")
    ruleset = R.RuleSet([r for r in rules.rules if r.issue_type in own])
    df = bank.raw("customers")
    return df.select("customer_id", "risk_score", "dob", ruleset.flag(ruleset.mask(df)).alias("dq_flag"))


@query(
    "dq_domain",
    f"""SELECT transaction_id, transaction_type, channel, CASE WHEN b_type OR b_channel THEN 'TYPE_MISMATCH' END AS dq_flag
        FROM ({TX_RULES_SQL}) t""",
)
def dq_domain(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        R.Rule("type", "TYPE_MISMATCH", "FLAGGED", R.outside("transaction_type", ["DEBIT", "CREDIT", "FEE", "REVERSAL"])),
        R.Rule("channel", "TYPE_MISMATCH", "FLAGGED", R.outside("channel", ["POS", "APP", "ATM", "EFT", "USSD", "INTERNAL"])),
    ]
    return _flagged(spark, d, TX, *rules).select("transaction_id", "transaction_type", "channel", "dq_flag")


@query(
    "dq_range",
    f"""SELECT customer_id, risk_score, coalesce(TRY_CAST(risk_score AS INTEGER) NOT BETWEEN 1 AND 10, false) AS risk_out,
          coalesce(TRY_CAST(dob AS DATE) < DATE '1950-01-01', false) AS dob_out
        FROM ({PARTY}) p""",
)
def dq_range(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, PARTY).select(
        "customer_id",
        "risk_score",
        R.beyond("risk_score", 1, 10, "int")(F.col).alias("risk_out"),
        R.beyond("dob", "1950-01-01", None, "date")(F.col).alias("dob_out"),
    )


@query(
    "dq_flag_priority",
    f"SELECT transaction_id, amount, currency, channel, {FLAG_SQL} AS dq_flag FROM ({TX_RULES_SQL}) t",
)
def dq_flag_priority(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    tx, rules = bank.raw("transactions"), bank.rules["transactions"].rules
    return tx.select("transaction_id", "amount", "currency", "channel", rules.flag(rules.mask(tx)).alias("dq_flag"))


_ORPHAN = f"(account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM ({SILVER_ACCOUNT_SQL}) s))"


@query(
    "quarantine_split",
    f"""SELECT transaction_id, account_id, transaction_date, amount,
          coalesce({FLAG_SQL}, 'ORPHANED_ACCOUNT') AS dq_flag,
          CASE WHEN b_null_key THEN 'EXCLUDED_NULL_PK' WHEN b_cast THEN 'EXCLUDED_CAST_FAILED' ELSE 'QUARANTINED' END AS dq_handling,
          concat_ws(',', CASE WHEN b_null_key THEN 'null_transaction_id' END, CASE WHEN b_null THEN 'null_required' END,
            CASE WHEN b_quoted THEN 'amount_type_mismatch' END, CASE WHEN b_cast THEN 'amount_cast_failed' END,
            CASE WHEN b_type THEN 'transaction_type_domain' END, CASE WHEN b_channel THEN 'channel_domain' END,
            CASE WHEN b_other_date THEN 'date_format_inconsistency' END, CASE WHEN b_bad_date THEN 'date_unreadable' END,
            CASE WHEN b_currency THEN 'currency_variants' END, CASE WHEN orphan THEN 'orphaned_transactions' END) AS dq_issues
        FROM (SELECT *, {_ORPHAN} AS orphan FROM ({TX_RULES_SQL}) t) x
        WHERE b_null_key OR b_cast OR b_bad_date OR orphan""",
)
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    spec, rules = bank.model.tables["transactions"], bank.rules["transactions"]
    tx = bank.bronze("transactions")
    out = removed_rows(tx, spec, rules, orphan_keys(tx, spec, bank.parent("transactions")), bank.hot("transactions"))
    return out.select(
        "transaction_id",
        "account_id",
        "transaction_date",
        "amount",
        "dq_flag",
        "dq_handling",
        F.array_join("dq_issues", ",").alias("dq_issues"),
    )


_ISSUES = {
    "corrupt_record_transactions": "false",
    "transaction_timestamp_uncomposable": "false",
    "null_transaction_id": "b_null_key",
    "null_required": "b_null",
    "amount_type_mismatch": "b_quoted",
    "amount_cast_failed": "b_cast",
    "transaction_type_domain": "b_type",
    "channel_domain": "b_channel",
    "date_format_inconsistency": "b_other_date",
    "date_unreadable": "b_bad_date",
    "currency_variants": "b_currency",
}


def _counts_sql(source: str, extra: dict[str, str]) -> str:
    parts = [
        f"SELECT '{name}' AS issue_type, count(*) FILTER ({test}) AS records_affected FROM t" for name, test in {**_ISSUES, **extra}.items()
    ]
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


@query(
    "dq_issue_counts",
    _counts_sql(TX_RULES_SQL, {"orphaned_transactions": "false", "duplicate_transactions": "false"}),
)
def dq_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Row rules only; orphans and duplicates are decided by a join and a grouping."""
    bank = Bank(spark, d)
    return R.issue_counts(bank.raw("transactions"), bank.rules["transactions"].rules)


@query(
    "dq_reconcile",
    f"""SELECT disposition, count(*) AS source_rows,
          CASE WHEN disposition = 'KEPT' THEN count(DISTINCT transaction_id) ELSE 0 END AS output_rows
        FROM (SELECT transaction_id, CASE WHEN b_null_key THEN 'EXCLUDED_NULL_PK' WHEN b_cast THEN 'EXCLUDED_CAST_FAILED'
                WHEN b_bad_date OR {_ORPHAN} THEN 'QUARANTINED' ELSE 'KEPT' END AS disposition
              FROM ({TX_RULES_SQL}) t) x
        GROUP BY disposition""",
)
def dq_reconcile(spark: SparkSession, d: str) -> DataFrame:
    bank = Bank(spark, d)
    return disposition_counts(
        bank.bronze("transactions"), bank.model.tables["transactions"], bank.rules["transactions"], bank.parent("transactions")
    )


@query(
    "row_metrics",
    "SELECT issue_type AS metric, records_affected AS value FROM ("
    + _counts_sql(
        f"SELECT * FROM ({TX_RANKED_SQL}) x WHERE rn = 1",
        {"rows": "true", "__copies": "copies > 1", "orphaned_transactions": "false", "duplicate_transactions": "false"},
    )
    + ") m",
)
def row_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the silver write, observed by the write itself."""
    bank = Bank(spark, d)
    rules = bank.rules["transactions"].rules
    seen = write_table(
        bank.silver_with_metrics("transactions"),
        scratch_path(spark, "silver"),
        metrics=[F.count_if(COPIES).alias(COPIES), *rules.counts(F.col(MASK))],
        helpers=[MASK, COPIES],
    )
    return spark.createDataFrame(list(seen.items()), "metric string, value bigint")


_REPORT_ENTRIES = f"""
WITH p AS ({PARTY}), a AS ({ACCOUNT}), s AS ({SILVER_ACCOUNT_SQL}), t AS ({TX_RULES_SQL}), k AS ({TX_RANKED_SQL}),
o AS (SELECT * FROM k WHERE rn = 1),
n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM t) AS nt),
e AS (
  SELECT 'risk_score_range' AS issue_type, count(*) AS affected, any_value(np) AS total, 'FLAGGED' AS handling, count(*) AS kept
    FROM p, n WHERE TRY_CAST(risk_score AS INTEGER) NOT BETWEEN 1 AND 10
  UNION ALL SELECT 'credit_limit_range', count(*), any_value(na), 'FLAGGED',
    (SELECT count(*) FROM s WHERE credit_limit NOT BETWEEN 5000 AND 250000)
    FROM a, n WHERE TRY_CAST(credit_limit AS DECIMAL(18,2)) NOT BETWEEN 5000 AND 250000
  UNION ALL SELECT 'risk_score_cast_failed', count(*), any_value(np), 'FLAGGED', count(*)
    FROM p, n WHERE risk_score IS NOT NULL AND TRY_CAST(risk_score AS INTEGER) IS NULL
  UNION ALL SELECT 'account_date_format_inconsistency', count(*), any_value(na), 'NORMALISED_DATE',
    (SELECT count(*) FROM a WHERE contains(last_activity_date, '/') AND account_id IN (SELECT account_id FROM s))
    FROM a, n WHERE contains(last_activity_date, '/')
  UNION ALL SELECT 'unlinked_accounts', count(*), any_value(na), 'QUARANTINED', 0 FROM a, n WHERE account_id NOT IN (SELECT account_id FROM s)
  UNION ALL SELECT 'orphaned_transactions', count(*), any_value(nt), 'QUARANTINED', 0
    FROM t, n WHERE account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM s)
  UNION ALL SELECT 'duplicate_transactions', (SELECT count(*) FROM k WHERE rn > 1), any_value(nt), 'DEDUPLICATED_KEEP_FIRST',
    (SELECT count(*) FROM o WHERE copies > 1) FROM n
""" + "".join(
    f"  UNION ALL SELECT '{name}', (SELECT count(*) FROM t WHERE {test}), any_value(nt), '{how}', (SELECT count(*) FROM o WHERE {test}) FROM n\n"
    for name, test, how in [
        ("null_transaction_id", "b_null_key", "EXCLUDED_NULL_PK"),
        ("null_required", "b_null", "FLAGGED"),
        ("amount_type_mismatch", "b_quoted", "CAST_TO_DECIMAL"),
        ("amount_cast_failed", "b_cast", "EXCLUDED_CAST_FAILED"),
        ("channel_domain", "b_channel", "FLAGGED"),
        ("date_format_inconsistency", "b_other_date", "NORMALISED_DATE"),
        ("date_unreadable", "b_bad_date", "QUARANTINED"),
        ("currency_variants", "b_currency", "NORMALISED_CURRENCY"),
    ]
) + """)
SELECT issue_type, affected AS records_affected, round(100.0 * affected / total, 2)::DOUBLE AS percentage_of_total,
  handling AS handling_action, kept AS records_in_output FROM e WHERE affected > 0"""


def _entries(spark: SparkSession, run: Medallion) -> DataFrame:
    text = spark.read.text(run.config["output"]["report_path"])
    entry = (
        "issue_type string, records_affected bigint, percentage_of_total double, "
        "handling_action string, records_in_output bigint"
    )
    doc = text.select(F.from_json("value", f"dq_issues array<struct<{entry.replace(' ', ':').replace(',:', ',')}>>").alias("doc"))
    return doc.select(F.inline("doc.dq_issues"))


@query("dq_report", _REPORT_ENTRIES)
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    """The issue entries of the JSON report that a complete run has written."""
    return _entries(spark, medallion(spark, d))


@query("dq_report_apart", _REPORT_ENTRIES)
def dq_report_apart(spark: SparkSession, d: str) -> DataFrame:
    """The same from stages that know of each other only through the ledger."""
    config = configured(spark, d)
    stages = [Medallion(spark, config, default_rules(), run_at=RUN_AT) for _ in range(4)]
    stages[0].bronze()
    stages[1].silver()
    stages[2].gold()
    stages[3].write_report()
    return _entries(spark, stages[3])


_LATE = "TRY_CAST(r.account_id AS BIGINT) % 3 = 0"


@query(
    "quarantine_replay",
    f"""SELECT transaction_id, account_id, amount, flag AS dq_flag, NOT first_line AS released FROM (
          SELECT x.transaction_id, x.account_id, CAST(x.amount AS DECIMAL(18,2)) AS amount, {FLAG_SQL} AS flag,
            x.transaction_id LIKE '%-1' AS first_line, rn
          FROM ({TX_RANKED_SQL} AND (transaction_id LIKE '%-1' OR {_LATE})) x) y
        WHERE rn = 1""",
)
def quarantine_replay(spark: SparkSession, d: str) -> DataFrame:
    """Two days: on the first a third of the accounts is missing; the second has them all, and the first lines again.

    Silver of the second day has the first lines once and the rows that their late accounts free.
    """
    bank = Bank(spark, d)
    spec, rules = bank.model.tables["transactions"], bank.rules["transactions"]
    tx, accounts = bank.bronze("transactions"), bank.parent("transactions")
    early = accounts.where(F.col("account_id").cast("bigint") % 3 != 0)
    # Both days bring keys of the same source. More or fewer hot keys change no row.
    hot = bank.hot("transactions")
    taken = removed_rows(tx, spec, rules, orphan_keys(tx, spec, early), hot).drop(*REMOVED)
    again = stamp(bank.raw("transactions").where("transaction_id LIKE '%-1'"), RUN_AT + dt.timedelta(days=1))
    held = held_back(taken, again, STAMP)
    silver = silver_frame(again.unionByName(held), dataclasses.replace(spec, flatten={}), rules, accounts, hot=hot)
    released = F.col(STAMP) < F.lit((RUN_AT + dt.timedelta(days=1)).isoformat()).cast("timestamp")
    return silver.select("transaction_id", "account_id", "amount", "dq_flag", released.alias("released"))
