import dataclasses
import gzip
import json
import time
from decimal import Decimal

import pytest
import yaml
from pyspark.sql import functions as F

import medalmart
from support import RUN_AT, tx
from medalmart.__main__ import main
from medalmart.operators.checks import rerun_check
from medalmart.plans import medallion
from medalmart.plans.validation import mart_checks, open_gold
from medalmart.sources.session import RELEASE, shuffles_released


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_dirty_sources_come_out_as_specified(run):
    m = run()
    tx = by(m.table("silver", "transactions"), "transaction_id")
    flags = {k: r.dq_flag for k, r in tx.items()}
    assert flags == {
        "t01": None,
        "t02": None,
        "t03": "NULL_REQUIRED",
        "t04": "CURRENCY_VARIANT",
        "t05": "CURRENCY_VARIANT",
        "t06": "CURRENCY_VARIANT",
        "t07": None,
        "t08": None,
        "t09": "TYPE_MISMATCH",
        "t10": "TYPE_MISMATCH",
        "t13": "DATE_FORMAT",
        "t16": "NULL_REQUIRED",
        "t18": "NULL_REQUIRED",
        "t19": "TYPE_MISMATCH",
        "t20": "NULL_REQUIRED",
        "t21": None,
        "t23": None,
    }
    assert tx["t02"].channel == "ATM"  # the earliest copy
    assert {r.currency for r in tx.values()} == {"ZAR"}
    assert [tx[k].amount for k in ("t07", "t08", "t09", "t10")] == [Decimal(x) for x in ("349.51", "1000.00", "349.51", "12.50")]
    assert str(tx["t13"].transaction_date) == "2025-03-22"
    assert tx["t16"].transaction_timestamp is None and tx["t21"].province is None
    assert tx["t23"].amount == 7  # the good copy, although the bad one is earlier

    fact = by(m.table("gold", "fact_transactions"), "transaction_id")
    assert set(fact) == set(tx)
    assert fact["t18"].account_sk is None and fact["t18"].customer_sk is None
    dims = by(m.table("gold", "dim_accounts"), "account_id")
    customers = by(m.table("gold", "dim_customers"), "customer_id")
    assert set(dims) == {"a1", "a2"} and set(customers) == {"c1", "c2", "c3"}
    assert fact["t23"].account_sk == dims["a2"].account_sk and fact["t23"].customer_sk == customers["c2"].customer_sk
    assert customers["c1"].age_band == "56-65" and customers["c3"].age_band is None
    assert customers["c2"].province == "Western Cape" and customers["c3"].risk_score is None
    assert str(dims["a2"].last_activity_date) == "2025-02-03"
    stamps = {r.ingestion_timestamp for r in fact.values()}
    assert len(stamps) == 1

    gone = m.table("bronze", "quarantine/transactions").collect()
    assert sorted((r.transaction_id or "", r.dq_handling) for r in gone) == sorted(
        [("", "EXCLUDED_NULL_PK")] * 2
        + [("", "QUARANTINED")]
        + [(t, "EXCLUDED_CAST_FAILED") for t in ("t11", "t12", "t23")]
        + [(t, "QUARANTINED") for t in ("t14", "t15", "t17", "t22")]
    )
    assert [r._corrupt_record for r in gone if r._corrupt_record] == ['{"transaction_id": "t99", broken']


def test_report_adds_up(run):
    m = run()
    written = m.spark.read.text(m.config["output"]["report_path"]).collect()
    assert len(written) == 1
    doc = json.loads(written[0].value)
    assert doc["run_timestamp"] == "2025-06-30T08:00:00Z"
    assert doc["source_record_counts"] == {"customers_raw": 6, "accounts_raw": 4, "transactions_raw": 29}
    assert doc["gold_layer_record_counts"] == {"fact_transactions": 17, "dim_accounts": 2, "dim_customers": 3}
    issues = {(i["issue_type"], i["percentage_of_total"]): i for i in doc["dq_issues"]}
    named = {i["issue_type"]: i for i in doc["dq_issues"]}
    assert all(i["records_affected"] > 0 for i in doc["dq_issues"]) and len(issues) == len(doc["dq_issues"])
    assert (named["duplicate_transactions"]["records_affected"], named["duplicate_transactions"]["records_in_output"]) == (2, 1)
    assert (named["orphaned_transactions"]["records_affected"], named["orphaned_transactions"]["handling_action"]) == (2, "QUARANTINED")
    assert named["amount_cast_failed"]["records_in_output"] == 0
    assert named["null_required"]["records_affected"] == 5 and named["null_required"]["percentage_of_total"] == 17.24
    assert m.source["transactions"]["rows"] == m.removed["transactions"] + 2 + m.output["transactions"]["rows"]


def test_clean_sources_lose_nothing(spark, extracts, rules_doc, tmp_path):
    keep = {"customers": ("c1",), "accounts": ("a1", "account_id"), "transactions": ("t01", "t02")}
    for name, words in keep.items():
        path = extracts["input"][f"{name}_path"]
        lines = open(path, encoding="utf-8").read().splitlines()
        head = lines[:1] if name != "transactions" else []
        good = [x for x in lines if any(f'"{w}"' in x or x.startswith(f"{w},") for w in words)]
        seen = set()
        unique = [x for x in good if not (x[:30] in seen or seen.add(x[:30]))]
        open(path, "w", encoding="utf-8").write("\n".join([*head, *[u for u in unique if u not in head]]) + "\n")
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.run()
    assert m.removed == {"customers": 0, "accounts": 0, "transactions": 0}
    assert json.loads(m.report().first().value)["dq_issues"] == []
    assert m.table("bronze", "quarantine/transactions").isEmpty()
    assert m.gold_rows == {"dim_customers": 1, "dim_accounts": 1, "fact_transactions": 2}


def test_orphans_can_be_kept_and_flagged(run, rules_doc):
    rules_doc["referential_integrity"]["fact_transactions"][0]["handling"] = "FLAGGED"
    m = run()
    fact = by(m.table("gold", "fact_transactions"), "transaction_id")
    assert fact["t17"].dq_flag == "ORPHANED_ACCOUNT" and fact["t17"].account_sk is None
    assert fact["t18"].dq_flag == "NULL_REQUIRED"
    assert m.removed["transactions"] == 8


def test_survivors_can_be_flagged(run, rules_doc):
    rules_doc["deduplication"]["transactions"]["flag_survivors"] = True
    m = run()
    tx = by(m.table("silver", "transactions"), "transaction_id")
    assert tx["t02"].dq_flag == "DUPLICATE_DEDUPED" and tx["t01"].dq_flag is None


def test_dense_keys_link_like_hash_keys(run):
    m = run(surrogate_keys="dense")
    dims = by(m.table("gold", "dim_accounts"), "account_id")
    fact = by(m.table("gold", "fact_transactions"), "transaction_id")
    assert [dims[k].account_sk for k in ("a1", "a2")] == [1, 2]
    assert sorted(r.transaction_sk for r in fact.values()) == list(range(1, 18))
    assert fact["t23"].account_sk == 2 and fact["t23"].customer_sk == 2 and fact["t18"].account_sk is None


def test_a_second_run_gives_the_same_keys_and_rows(run):
    m = run()
    fact = m.table("gold", "fact_transactions")
    before = m.spark.createDataFrame(fact.collect(), fact.schema)
    again = run()
    row = rerun_check(before, again.table("gold", "fact_transactions")).first()
    assert (row.first_rows, row.second_rows, row.differing_rows) == (17, 17, 0)


def test_stages_can_run_apart(spark, extracts, rules_doc, tmp_path, monkeypatch):
    (tmp_path / "dq_rules.yaml").write_text(yaml.safe_dump(rules_doc))
    config = {**extracts, "dq": {"rules_path": str(tmp_path / "dq_rules.yaml")}}
    (tmp_path / "pipeline_config.yaml").write_text(yaml.safe_dump(config))
    path = str(tmp_path / "pipeline_config.yaml")
    assert main(["check", "--config", path]) == 1
    for stage in ("bronze", "silver", "gold"):
        assert main([stage, "--config", path]) == 0
    assert main(["check", "--config", path]) == 1  # the sources are dirty, and the mart shows it
    gold = open_gold(spark, extracts["output"]["gold_path"], ["fact_transactions", "dim_accounts", "dim_customers"])
    assert gold["fact_transactions"].count() == 17
    sql = "select count(*) from dim_accounts a left join dim_customers c on a.customer_id = c.customer_id where c.customer_id is null"
    assert spark.sql(sql).first()[0] == 0
    kinds = spark.sql("select transaction_type, count(*) n, sum(amount) s from fact_transactions group by 1").collect()
    assert [(r[0], r[1]) for r in kinds] == [("DEBIT", 17)]
    assert main(["gold", "--config", str(tmp_path / "absent.yaml")]) == 1


def test_unexpected_columns_are_reported_and_kept_in_bronze(spark, extracts, rules_doc):
    path = extracts["input"]["customers_path"]
    lines = open(path, encoding="utf-8").read().splitlines()
    open(path, "w", encoding="utf-8").write("\n".join([lines[0] + ",shoe", lines[1] + ",41"]) + "\n")
    with open(extracts["input"]["transactions_path"], "a", encoding="utf-8") as f:
        f.write('{"transaction_id": "t77", "loyalty": 3}\n')
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.bronze()
    assert m.drift["customers"].extra == ("shoe",) and m.drift["accounts"].extra == ()
    assert m.drift["transactions"].extra == ("loyalty",)
    assert m.table("bronze", "customers").first().shoe == "41"
    assert m.table("bronze", "transactions").where("transaction_id = 't77'").first()._undeclared == {"loyalty": "3"}


def test_every_undeclared_field_is_told(spark, extracts, rules_doc, caplog):
    with open(extracts["input"]["transactions_path"], "a", encoding="utf-8") as f:
        f.write("".join(f'{{"transaction_id": "u{i}", "extra{i:03}": 1}}\n' for i in range(130)))
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.bronze()
    assert m.undeclared == {"transactions": 130} and len(m.drift["transactions"].extra) == 100
    assert "130 undeclared fields" in caplog.text
    assert {r.field for r in m.table("bronze", "transactions_undeclared").collect()} == {f"extra{i:03}" for i in range(130)}


def test_nothing_is_lost_in_silence(spark, extracts, rules_doc):
    """Values that silver can't type, lines that don't fit, references that are missing: all told."""
    with open(extracts["input"]["customers_path"], "a", encoding="utf-8") as f:
        f.write("c8,****8,A,B,31/12/1990,F,Gauteng,LOW,MASS,5,VERIFIED,\nc9,****9,A,B,1990-01-01,F,Gauteng,LOW,MASS,5,VERIFIED,,more\n")
    with open(extracts["input"]["accounts_path"], "a", encoding="utf-8") as f:
        f.write("a8,c1,SAVINGS,ACTIVE,01/02/2020,BASIC,,APP,xx,yy,\na9,,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,1.00,\n")
    with open(extracts["input"]["transactions_path"], "a", encoding="utf-8") as f:
        f.write(tx("t70", transaction_time="25:61:00") + "\n" + tx("t71", metadata={"retry_flag": "maybe"}) + "\n" + tx("t72", location="nowhere") + "\n")
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.run()
    flags = {r.customer_id: r.dq_flag for r in m.table("silver", "customers").collect()}
    assert flags["c8"] == "DATE_FORMAT" and flags["c3"] == "TYPE_MISMATCH" and "c9" not in flags
    assert {r.account_id: r.dq_flag for r in m.table("silver", "accounts").collect()}["a8"] == "TYPE_MISMATCH"
    gone = {(t, r[0]): r.dq_handling for t in ("customers", "accounts", "transactions") for r in m.table("bronze", f"quarantine/{t}").collect()}
    for key in (("customers", "c9"), ("accounts", "a9"), ("transactions", "t70"), ("transactions", "t71"), ("transactions", "t72")):
        assert gone[key] == "QUARANTINED"
    told = {i["issue_type"]: i["records_affected"] for i in json.loads(m.report().first().value)["dq_issues"]}
    assert told["dob_unreadable"] == told["open_date_unreadable"] == told["credit_limit_cast_failed"] == told["current_balance_cast_failed"] == 1
    assert told["corrupt_record_customers"] == 1 and told["corrupt_record_transactions"] == 3 and told["null_customer_ref"] == 1
    assert told["transaction_timestamp_uncomposable"] == 1


def test_gold_contracts_hold(run):
    m = run(partition_by={"fact_transactions": ["transaction_type"]})
    fact = m.table("gold", "fact_transactions")
    assert len(fact.columns) == 14 and fact.columns[6] == "transaction_type" and fact.count() == 17
    assert not [r for r in m.checks().collect() if r.check.endswith(": schema") and r.violations]
    assert len(m.table("gold", "dim_accounts").columns) == 11 and m.table("gold", "dim_accounts").columns[2] == "customer_id"
    assert len(m.table("gold", "dim_customers").columns) == 9 and "dob" not in m.table("gold", "dim_customers").columns


def test_broken_contracts_are_counted(spark, run, model):
    m = run()
    checks = {r.check: r.violations for r in m.checks().collect()}
    assert len(checks) == 16 and m.unfilled() == []
    dirty = {"dim_customers: not null": 1, "fact_transactions: province as in dim_customers": 2, "dim_customers: province members": 6}
    assert {k: v for k, v in checks.items() if v} == dirty
    gold = {n: m.table("gold", n) for n in [*model.dimensions, *model.facts]}
    gold["dim_accounts"] = gold["dim_accounts"].filter("account_id = 'a1'").unionAll(gold["dim_accounts"].filter("account_id = 'a1'"))
    gold["dim_customers"] = gold["dim_customers"].withColumnRenamed("gender", "sex")
    found = {r.check: r.violations for r in mart_checks(gold, model, {"currency": "USD"}).collect() if r.violations}
    assert found == {
        "dim_accounts: account_sk": 1,
        "dim_customers: schema": 2,
        "fact_transactions: account_sk -> dim_accounts": 1,
        "fact_transactions: currency = USD": 17,
        **dirty,
    }
    gold["dim_accounts"] = gold["dim_accounts"].withColumn("customer_id", F.when(F.col("account_id") != "a1", F.col("customer_id")))
    gold["fact_transactions"] = gold["fact_transactions"].withColumn("customer_sk", F.when(F.col("transaction_id") != "t01", F.col("customer_sk")))
    found = {r.check: r.violations for r in mart_checks(gold, model).collect() if r.violations}
    assert found["dim_accounts: customer_id -> dim_customers"] == 2 and found["dim_accounts: not null"] == 2
    assert found["fact_transactions: not null"] == 1


def test_silver_plan_moves_rows_once(spark, run):
    m = run()
    text = m.silver_frame("transactions")._jdf.queryExecution().executedPlan().toString()
    # A broadcast of the accounts' keys, and one shuffle for the deduplication.
    assert text.count("Exchange hashpartitioning") == 1 and text.count("BroadcastExchange") == 1
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    fact = m.fact_frame("fact_transactions")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in fact and "Join" not in fact


def test_unknown_formats_are_refused(spark, extracts, rules_doc, model):
    tables = {n: dataclasses.replace(t, format="xml") for n, t in model.tables.items()}
    m = medalmart.Medallion(spark, extracts, rules_doc, dataclasses.replace(model, tables=tables))
    with pytest.raises(ValueError, match="xml"):
        m.bronze()


STORED_BY = {
    "bronze": {"transactions": "account_id"},
    "silver": {"accounts": "account_id", "transactions": "account_id"},
    "gold": {"fact_transactions": "account_sk", "dim_accounts": "account_sk"},
}


@pytest.mark.parametrize("hot", [True, False])
def test_layers_stored_by_key_hold_the_same(spark, run, extracts, tmp_path, monkeypatch, hot):
    if not hot:
        # In so few rows each key has a large share; here none counts as hot, so all rows lie in buckets.
        monkeypatch.setattr(medalmart.sources.layout, "hot_keys", lambda counts, key: counts.where(F.col(key).isNull()).select(key))
    plain = run()
    elsewhere = {f"{layer}_path": str(tmp_path / "by_key" / layer) for layer in ("bronze", "silver", "gold", "report")}
    by_key = run(output=elsewhere, stored_by=STORED_BY)
    for layer, name in [("bronze", "transactions"), ("bronze", "quarantine/transactions"), ("silver", "transactions"), ("silver", "accounts"), ("gold", "fact_transactions"), ("gold", "dim_accounts")]:
        a, b = plain.table(layer, name), by_key.table(layer, name)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    assert (plain.source, plain.output, plain.removed, plain.orphans) == (by_key.source, by_key.output, by_key.removed, by_key.orphans)
    # Another process finds the layout in the folders.
    later = medalmart.Medallion(spark, {**extracts, "output": elsewhere}, medalmart.config.default_rules(), run_at=RUN_AT)
    assert sorted(map(tuple, later.checks().collect())) == sorted(map(tuple, plain.checks().collect()))
    assert (later.by_key("gold", "fact_transactions").hot_keys == ()) is not hot


def test_links_and_checks_of_stored_layers_move_no_fact(spark, run, monkeypatch):
    monkeypatch.setattr(medalmart.sources.layout, "hot_keys", lambda counts, key: counts.where(F.col(key).isNull()).select(key))
    m = run(stored_by=STORED_BY)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = m._linked_by_key("transactions")
        keys = medalmart.sources.layout.unlinked_keys(*by, "account_id")
        silver = m.silver_frame("transactions")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # The one shuffle of facts is that of the deduplication.
    assert silver.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(transaction_id" in silver
    # Counts of the few hot keys move, the buckets don't.
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and {r.account_id for r in keys.collect()} == {"a3", "a9"}


def test_layouts_that_cannot_be_are_refused(spark, extracts, rules_doc):
    for wrong, told in [({"stored_by": {"iron": {}}}, "layer"), ({"stored_by": {"gold": {"x": "y"}}}, "no gold table"),
                        ({"stored_by": {"gold": {"fact_transactions": "account_sk"}}, "partition_by": {"fact_transactions": ["channel"]}}, "partitioned")]:
        with pytest.raises(ValueError, match=told):
            medalmart.Medallion(spark, {**extracts, **wrong}, rules_doc)


def test_buckets_grow_with_the_sources(spark, extracts, rules_doc, monkeypatch):
    from medalmart.sources import layout

    monkeypatch.setattr(layout, "BUCKET_BYTES", 512)
    config = {**extracts, "stored_by": {"bronze": {"transactions": "account_id"}}}
    m = medalmart.Medallion(spark, config, rules_doc, run_at=RUN_AT)
    m.bronze()
    n = m.by_key("bronze", "transactions").buckets
    assert n == m.buckets >= 16
    # A later stage goes by what bronze has; a configured number is taken as it is.
    monkeypatch.setattr(layout, "BUCKET_BYTES", 1 << 40)
    assert medalmart.Medallion(spark, config, rules_doc).buckets == n
    assert medalmart.Medallion(spark, {**config, "buckets": 3}, rules_doc).buckets == 3
    # Without a bronze table stored by key, and with its sources gone, it is the bronze tables that tell.
    apart = {**extracts, "input": {k: f"{v}.gone" for k, v in extracts["input"].items()}}
    assert medalmart.Medallion(spark, apart, rules_doc).buckets == 8


def shuffle_files(spark):
    """Shuffle files on disk of this session's executors, which are threads of the driver."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_stages_leave_no_shuffle_files(spark, extracts, rules_doc):
    before = shuffle_files(spark)
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.bronze()
    m.silver()
    m.gold()
    # Files go a moment after the query. Before, all lay there until the driver collected its garbage.
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(RELEASE, None) is None


def test_a_session_that_keeps_its_shuffles_keeps_them(spark):
    spark.conf.set(RELEASE, "false")
    try:
        with shuffles_released(spark):
            assert spark.conf.get(RELEASE) == "false"
        assert spark.conf.get(RELEASE) == "false"
    finally:
        spark.conf.unset(RELEASE)


def test_linked_rows_settle_before_the_deduplication(spark, run, tmp_path, monkeypatch):
    """Beyond the broadcast limit the link's shuffle is over before that of the deduplication begins."""
    plain = run()
    written = {}
    monkeypatch.setattr(medallion, "drop_path", lambda spark, path: written.update({path.rsplit("/", 1)[1].rsplit("-", 1)[0]: path}))
    elsewhere = {f"{layer}_path": str(tmp_path / "shuffled" / layer) for layer in ("bronze", "silver", "gold", "report")}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = run(output=elsewhere)
        linked = spark.read.parquet(written["linked-transactions"])
        silver = shuffled.silver_frame("transactions", lambda rows: linked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for layer, name in [("bronze", "quarantine/transactions"), ("silver", "transactions"), ("silver", "accounts"), ("gold", "fact_transactions")]:
        assert sorted(map(str, plain.table(layer, name).collect())) == sorted(map(str, shuffled.table(layer, name).collect())), name
    assert (plain.output, plain.removed, plain.orphans) == (shuffled.output, shuffled.removed, shuffled.orphans)
    # Rows of good accounts and without any: the others have left, the copies have not.
    assert {r.account_id for r in linked.collect()} == {"a1", "a2", None} and linked.where("transaction_id = 't02'").count() == 3
    assert "Join" not in silver and silver.count("Exchange hashpartitioning") == 1


def test_buckets_of_compressed_sources_are_about_as_many(spark, extracts, rules_doc, monkeypatch):
    from medalmart.sources import layout

    monkeypatch.setattr(layout, "BUCKET_BYTES", 64)
    inputs = {}
    for name, path in extracts["input"].items():
        text = open(path, encoding="utf-8").read()
        inputs[name] = f"{path}.gz"
        with gzip.open(inputs[name], "wt", encoding="utf-8") as f:
            f.write(text)
    m, packed = (medalmart.Medallion(spark, {**extracts, "input": i}, rules_doc) for i in (extracts["input"], inputs))
    # Without regard to the packing they were a thirteenth, as these few lines are packed.
    assert 2 * packed.buckets >= m.buckets
