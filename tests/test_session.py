import pytest

from catalog.base import TX, role
from medalmart.plans.medallion import Medallion
from medalmart.sources.session import SETTINGS

NAME = "spark.sql.codegen.hugeMethodLimit"


@pytest.fixture()
def fresh(spark):
    session = spark.newSession()
    session.conf.unset(NAME)
    return session


def test_a_run_has_long_rules_split(fresh, extracts, rules_doc):
    assert fresh.conf.get(NAME, None) is None
    Medallion(fresh, extracts, rules_doc)
    assert fresh.conf.get(NAME) == SETTINGS[NAME]


def test_a_session_with_its_own_limit_keeps_it(fresh, extracts, rules_doc):
    fresh.conf.set(NAME, "20000")
    Medallion(fresh, extracts, rules_doc)
    assert fresh.conf.get(NAME) == "20000"


def test_roles_have_long_texts_split(fresh, tmp_path):
    kinds = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    fresh.createDataFrame([], kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    role(fresh, str(tmp_path), TX)
    assert fresh.conf.get(NAME) == SETTINGS[NAME]
