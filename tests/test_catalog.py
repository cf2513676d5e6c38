"""Every named query against its SQL, and the plans of the main ones."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck
from wardlens.catalog.oracle import ORACLE_SQL as SQL
from wardlens.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(sample):
    return duck(sample)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sample, con, name):
    assert differences(QUERIES[name](spark, sample), con, SQL[name]) == []


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["n_pacientes", "planta"] and df.count() > 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_on_the_engine(spark, sample, name):
    plan = plan_of(QUERIES[name](spark, sample))
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, sample):
    plan = plan_of(QUERIES["q01_valid_active"](spark, sample))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans and not any("o_totalprice" in s or "c_acctbal" in s for s in scans)
    assert "lineitem" not in plan  # its page gives no wanted column


def test_isolation_map_reads_its_input_once(spark, sample):
    plan = plan_of(QUERIES["q13_isolation_map"](spark, sample))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
