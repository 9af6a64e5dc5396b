import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import medalmart  # noqa: E402
from medalmart.config import Model, default_rules  # noqa: E402
from support import ACCOUNTS, CUSTOMERS, RUN_AT, TRANSACTIONS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def model():
    return Model.load()


@pytest.fixture()
def rules_doc():
    return default_rules()


@pytest.fixture()
def extracts(tmp_path):
    """A folder with the three dirty sources, and a run configuration over it."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "customers.csv").write_text(CUSTOMERS, encoding="utf-8")
    (src / "accounts.csv").write_text(ACCOUNTS, encoding="utf-8")
    (src / "transactions.jsonl").write_text("\n".join(TRANSACTIONS) + "\n", encoding="utf-8")
    return {
        "input": {
            "customers_path": str(src / "customers.csv"),
            "accounts_path": str(src / "accounts.csv"),
            "transactions_path": str(src / "transactions.jsonl"),
        },
        "output": {f"{layer}_path": str(tmp_path / "out" / layer) for layer in ("bronze", "silver", "gold", "report")},
    }


@pytest.fixture()
def run(spark, extracts, rules_doc):
    def go(**config):
        m = medalmart.Medallion(spark, {**extracts, **config}, rules_doc, run_at=RUN_AT)
        m.run()
        return m

    return go
