import pytest
import yaml
from pyspark.sql import functions as F

from medalmart.config import CONFIG_VARIABLE, Model, compile_rules, load_config, load_dq_rules
from medalmart.operators import rules as R

# Rules in the short form: no issue types, no handling.
SHORT = """
null_checks:
  fact_transactions: [transaction_id, account_id, amount, currency]
type_checks:
  fact_transactions: {amount: decimal, transaction_date: date, transaction_timestamp: timestamp}
domain_checks:
  channel: {allowed: [POS, APP], dq_flag: TYPE_MISMATCH}
currency_normalisation: {target_value: ZAR, flag_variants: true}
date_format_checks: [transaction_date, last_activity_date]
referential_integrity:
  fact_transactions:
    - {field: account_id, references: dim_accounts.account_id, dq_flag: ORPHANED_ACCOUNT}
"""


def names(rules):
    return [r.issue_type for r in rules.rules.rules]


def test_short_rules_take_the_defaults(spark, model):
    got = compile_rules(yaml.safe_load(SHORT), model.tables["transactions"])
    assert names(got) == [
        "corrupt_record_transactions",
        "null_transaction_id",
        "null_required",
        "amount_type_mismatch",
        "amount_cast_failed",
        "transaction_timestamp_uncomposable",
        "channel_domain",
        "date_format_inconsistency",
        "date_unreadable",
        "currency_variants",
        "orphaned_transactions",
        "duplicate_transactions",
    ]
    assert got.constants == {"currency": "ZAR"} and got.orphan_drops


def test_an_empty_section_is_off(spark, model):
    doc = yaml.safe_load(SHORT)
    doc["null_checks"]["fact_transactions"] = []
    doc["currency_normalisation"]["flag_variants"] = False
    del doc["referential_integrity"], doc["domain_checks"]
    got = compile_rules(doc, model.tables["transactions"])
    assert not {"null_required", "currency_variants", "orphaned_transactions", "channel_domain"} & set(names(got))
    assert got.constants == {"currency": "ZAR"}


@pytest.mark.parametrize(
    "priority,flag",
    [
        (R.FLAGS, "NULL_REQUIRED"),
        (["ORPHANED_ACCOUNT", *[f for f in R.FLAGS if f != "ORPHANED_ACCOUNT"]], "ORPHANED_ACCOUNT"),
    ],
)
def test_priority_is_configuration(spark, priority, flag):
    rules = R.RuleSet(
        [R.Rule("n", "NULL_REQUIRED", "FLAGGED", R.missing("a"), ("a",)), R.Rule("o", "ORPHANED_ACCOUNT", "FLAGGED")],
        priority,
    )
    df = spark.createDataFrame([(None, True), ("x", True), ("x", False)], "a string, orphan boolean")
    mask = rules.set_bit(rules.mask(df), "o", F.col("orphan"))
    rows = df.select(rules.flag(mask), rules.issues(mask)).collect()
    assert [r[0] for r in rows] == [flag, "ORPHANED_ACCOUNT", None]
    assert [r[1] for r in rows] == [["n", "o"], ["o"], []]


def test_counts_see_every_issue_of_a_row(spark):
    rules = R.RuleSet(
        [
            R.Rule("null", "NULL_REQUIRED", "FLAGGED", R.missing("a", "b"), ("a", "b")),
            R.Rule("domain", "TYPE_MISMATCH", "FLAGGED", R.outside("b", ["x"]), ("b",)),
            R.Rule("range", "TYPE_MISMATCH", "FLAGGED", R.beyond("a", 1, 10, "int"), ("a",)),
            R.Rule("absent", "TYPE_MISMATCH", "FLAGGED", R.missing("zzz"), ("zzz",)),
        ]
    )
    df = spark.createDataFrame([(None, "q"), ("11", "x"), ("abc", None), ("10", "x")], "a string, b string")
    got = {r.issue_type: r.records_affected for r in R.issue_counts(df, rules).collect()}
    assert got == {"null": 2, "domain": 1, "range": 1, "absent": 0}


def test_bad_rules_are_refused():
    with pytest.raises(ValueError, match="dq_flag"):
        R.Rule("x", "NOPE", "FLAGGED")
    with pytest.raises(ValueError, match="handling"):
        R.Rule("x", None, "NOPE")
    with pytest.raises(ValueError, match="differ"):
        R.RuleSet([R.Rule("x", None, "FLAGGED"), R.Rule("x", None, "FLAGGED")])
    with pytest.raises(ValueError, match="priority"):
        R.RuleSet([R.Rule("x", "DATE_FORMAT", "FLAGGED")], ["NULL_REQUIRED"])


def test_config_search_order(tmp_path, monkeypatch):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, name in ((a, "first"), (b, "second")):
        folder.mkdir()
        (folder / "pipeline_config.yaml").write_text(f"name: {name}\n")
        (folder / "dq_rules.yaml").write_text(f"name: {name}\n")
    monkeypatch.delenv(CONFIG_VARIABLE, raising=False)
    search = [str(a), str(b)]
    assert load_config(search=search)["name"] == "first"
    monkeypatch.setenv(CONFIG_VARIABLE, str(b / "pipeline_config.yaml"))
    assert load_config(search=search)["name"] == "second"
    assert load_config(str(a / "pipeline_config.yaml"), search)["name"] == "first"
    assert load_dq_rules({"dq": {"rules_path": str(b / "dq_rules.yaml")}}, search)["name"] == "second"
    assert load_dq_rules({}, search)["name"] == "first"
    monkeypatch.delenv(CONFIG_VARIABLE)
    with pytest.raises(FileNotFoundError):
        load_config(search=[str(tmp_path)])


def test_links_must_follow_their_table(tmp_path):
    spec = {"gold": "g", "input": "i", "format": "csv", "schema": "a string", "key": ["a"]}
    doc = {"tables": {"t": {**spec, "link": {"field": "a", "table": "later", "column": "b", "linked": "ok"}}}}
    (tmp_path / "m.yaml").write_text(yaml.safe_dump(doc))
    with pytest.raises(ValueError, match="before"):
        Model.load(tmp_path / "m.yaml")


def test_date_ranges_know_the_formats(spark):
    df = spark.createDataFrame([("22/03/1999",), ("1999-03-22",), ("22/03/2009",), ("?",)], "d string")
    test = R.beyond("d", "2000-01-01", None, "date", ["yyyy-MM-dd", "dd/MM/yyyy"])
    assert [r[0] for r in df.select(test(F.col)).collect()] == [True, True, False, False]
