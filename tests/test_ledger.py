import datetime as dt
from decimal import Decimal
import json

import pytest
import yaml

import medalmart
from medalmart.__main__ import main
from medalmart.plans.ledger import Ledger, began, run_id
from medalmart.plans.replay import held_back
from support import RUN_AT, tx


def report(spark, config):
    return json.loads(spark.read.text(config["output"]["report_path"]).first().value)


def configured(tmp_path, extracts, rules_doc, **more):
    (tmp_path / "dq_rules.yaml").write_text(yaml.safe_dump(rules_doc))
    config = {**extracts, "dq": {"rules_path": str(tmp_path / "dq_rules.yaml")}, **more}
    (tmp_path / "pipeline_config.yaml").write_text(yaml.safe_dump(config))
    return str(tmp_path / "pipeline_config.yaml")


def test_run_names_are_times():
    assert began(run_id(RUN_AT)) == RUN_AT
    assert run_id(RUN_AT) < run_id(RUN_AT + dt.timedelta(microseconds=1))
    assert run_id(RUN_AT.replace(tzinfo=None)) == run_id(RUN_AT)


def test_stages_run_apart_give_the_report_of_a_whole_run(spark, extracts, rules_doc, tmp_path):
    whole = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    whole.run()
    want = report(spark, extracts)
    apart = {**extracts, "output": {k: v.replace("/out/", "/apart/") for k, v in extracts["output"].items()}}
    path = configured(tmp_path, apart, rules_doc)
    for stage in ("bronze", "silver", "gold"):
        assert main([stage, "--config", path]) == 0
    got = report(spark, apart)
    assert got.keys() == want.keys()
    for field in set(want) - {"run_timestamp", "execution_duration_seconds"}:
        assert got[field] == want[field], field
    # The report names the time at which bronze began, and can be had again from the ledger alone.
    runs = Ledger(spark, apart["output"]["report_path"] + "_ledger").stages()
    assert list(runs.values()) == [["bronze", "silver", "gold"]]
    assert got["run_timestamp"] == began(next(iter(runs))).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert main(["report", "--config", path]) == 0 and report(spark, apart) == got


def test_a_stage_again_replaces_its_entry(spark, extracts, rules_doc):
    m = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT)
    m.bronze()
    medalmart.Medallion(spark, extracts, rules_doc).silver()
    medalmart.Medallion(spark, extracts, rules_doc).silver()
    assert m.ledger.stages() == {run_id(RUN_AT): ["bronze", "silver"]}
    counts = m.ledger.counts(run_id(RUN_AT))
    assert counts["source"]["transactions"]["rows"] == 29 and counts["removed"]["transactions"]["rows"] == 10
    assert not medalmart.Medallion(spark, extracts, rules_doc).is_complete()


def test_counts_of_replaced_tables_are_taken_anew(spark, extracts, rules_doc):
    """A later bronze that died after its tables: its ledger entry is missing, and the tables are its own."""
    medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT).bronze()
    with open(extracts["input"]["transactions_path"], "a", encoding="utf-8") as f:
        f.write(tx("t80") + "\n")
    later = medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT + dt.timedelta(days=1))
    later.ledger = None
    later.bronze()
    m = medalmart.Medallion(spark, extracts, rules_doc)
    m.silver()
    assert m.source["transactions"]["rows"] == 30


def test_history_over_runs(spark, extracts, rules_doc):
    for day in range(2):
        with open(extracts["input"]["transactions_path"], "a", encoding="utf-8") as f:
            f.write(tx(f"u{day}") + "\n")
        medalmart.Medallion(spark, extracts, rules_doc, run_at=RUN_AT + dt.timedelta(days=day)).bronze()
    ledger = Ledger(spark, extracts["output"]["report_path"] + "_ledger")
    rows = [(r.value, r.change) for r in ledger.history().where("table_name = 'transactions'").orderBy("run_id").collect()]
    assert rows == [(30, None), (31, 1)]


def test_no_report_path_means_no_ledger(spark, extracts, rules_doc):
    out = {k: v for k, v in extracts["output"].items() if k != "report_path"}
    m = medalmart.Medallion(spark, {**extracts, "output": out}, rules_doc, run_at=RUN_AT)
    m.run()
    assert m.ledger is None and m.is_complete() and m.report().count() == 1


def test_report_without_a_run_fails(spark, extracts, rules_doc, tmp_path):
    assert main(["report", "--config", configured(tmp_path, extracts, rules_doc)]) == 1


# Replay of rows that were taken out.


def deliver(extracts, accounts=(), transactions=()):
    head = open(extracts["input"]["accounts_path"], encoding="utf-8").readline()
    open(extracts["input"]["accounts_path"], "w", encoding="utf-8").write(head + "".join(f"{a}\n" for a in accounts))
    open(extracts["input"]["transactions_path"], "w", encoding="utf-8").write("".join(f"{t}\n" for t in transactions))


def balanced(m):
    held = m.replayed["transactions"]["rows"]
    doc = json.loads(m.report().first().value)
    told = {i["issue_type"]: i for i in doc["dq_issues"]}
    surplus = told.get("duplicate_transactions", {"records_affected": 0})["records_affected"]
    assert m.source["transactions"]["rows"] + held == m.output["transactions"]["rows"] + m.removed["transactions"] + surplus
    assert doc["source_record_counts"]["transactions_replayed"] == held
    return told


A1 = "a1,c1,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,10.505,2025-01-02"
A9 = "a9,c1,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,10.505,2025-01-02"


@pytest.fixture()
def days(spark, extracts, rules_doc):
    at = [RUN_AT]

    def go(accounts, transactions, rules=rules_doc):
        deliver(extracts, accounts, transactions)
        m = medalmart.Medallion(spark, {**extracts, "replay_quarantine": True}, rules, run_at=at[0])
        m.run()
        at[0] += dt.timedelta(days=1)
        return m

    return go


def test_a_late_account_frees_its_transactions(days):
    m = days([A1], [tx("t1"), tx("t2", account_id="a9"), tx("t3", account_id="a9"), tx("t4", account_id="a7"), tx("t5", amount="abc")])
    assert m.removed["transactions"] == 4 and m.replayed["transactions"] == {"rows": 0}
    m = days([A1, A9], [tx("t6")])
    silver = {r.transaction_id: r for r in m.table("silver", "transactions").collect()}
    assert set(silver) == {"t2", "t3", "t6"} and silver["t2"].account_linked
    # Rows keep the stamp of the delivery they came with.
    assert silver["t2"].ingestion_timestamp < silver["t6"].ingestion_timestamp
    assert m.output["transactions"]["released"] == 2 and m.replayed["transactions"]["rows"] == 4 and m.removed["transactions"] == 2
    assert sorted(r.transaction_id for r in m.table("bronze", "quarantine/transactions").collect()) == ["t4", "t5"]
    assert balanced(m)["orphaned_transactions"]["records_affected"] == 1
    facts = {r.transaction_id: r for r in m.table("gold", "fact_transactions").collect()}
    assert facts["t2"].account_sk is not None
    # Freed once: the next run neither has them nor holds them.
    m = days([A1, A9], [tx("t7")])
    assert {r.transaction_id for r in m.table("silver", "transactions").collect()} == {"t7"} and m.replayed["transactions"]["rows"] == 2


def test_a_changed_rule_frees_its_rows(days, rules_doc):
    m = days([A1], [tx("t1"), tx("t2", account_id="a9")])
    assert m.removed["transactions"] == 1
    rules_doc["referential_integrity"]["fact_transactions"][0]["handling"] = "FLAGGED"
    m = days([A1], [tx("t3")], rules_doc)
    assert {r.transaction_id: r.dq_flag for r in m.table("silver", "transactions").collect()} == {"t2": "ORPHANED_ACCOUNT", "t3": None}
    balanced(m)


def test_rows_delivered_again_count_once(days):
    held = [tx("t2", account_id="a9"), tx("t3", account_id="a9"), tx("t3", account_id="a9")]
    m = days([A1], [tx("t1"), *held])
    assert m.removed["transactions"] == 3
    m = days([A1, A9], [tx("t1"), held[0]])
    # t2 came again; both copies of t3 were held and are one row now.
    assert m.replayed["transactions"]["rows"] == 2
    assert sorted(r.transaction_id for r in m.table("silver", "transactions").collect()) == ["t1", "t2", "t3"]
    assert balanced(m)["duplicate_transactions"]["records_affected"] == 1


def test_silver_again_gives_the_same(days, spark, extracts, rules_doc):
    days([A1], [tx("t1"), tx("t2", account_id="a9")])
    m = days([A1, A9], [tx("t3")])
    config = {**extracts, "replay_quarantine": True}
    again = medalmart.Medallion(spark, config, rules_doc)
    again.silver()
    assert again.output == m.output and again.removed == m.removed


def test_held_back_tells_null_from_empty(spark):
    schema = "a string, b int, at timestamp"
    at, later = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    taken = spark.createDataFrame([("", 1, at), (None, 1, at), ("x", None, at), ("x", None, at)], schema)
    delivered = spark.createDataFrame([(None, 1, later)], schema)
    assert sorted(map(tuple, held_back(taken, delivered, "at").select("a", "b").collect()), key=repr) == sorted([("", 1), ("x", None), ("x", None)], key=repr)
    assert held_back(taken, delivered.limit(0), "at").count() == 4


def test_held_back_keeps_values_apart(spark):
    schema = "a string, b string, n decimal(4,1), at timestamp"
    at = dt.datetime(2025, 1, 1)
    taken = [("x1=y", "z", None, at), ("x", "1=y1=z", None, at), ("x-", None, None, at), ("x", "-", None, at), ("é", "\u0001", 1, at)]
    held = spark.createDataFrame([(a, b, n and Decimal(n), t) for a, b, n, t in taken], schema)
    for i, row in enumerate(held.collect()):
        left = held_back(held, spark.createDataFrame([row], schema), "at").collect()
        assert len(left) == 4 and row not in left, i


def test_held_back_compares_texts_with_other_types(spark):
    at = dt.datetime(2025, 1, 1)
    taken = spark.createDataFrame([("1.5", at), ("2", at)], "a string, at timestamp")
    delivered = spark.sql("SELECT parse_json('\"1.5\"') AS a, timestamp'2025-01-02' AS at")
    assert [r.a for r in held_back(taken, delivered, "at").collect()] == ["2"]
