"""Every claims query gives the rows of its SQL on the small tables; plans are as they should be."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from adjudica.catalog import CLAIMS
from adjudica.plans import claims_queries, registry  # noqa: F401
from adjudica.sources import files

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for file in os.listdir(SMALL):
            c.sql(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
        yield c


@pytest.mark.parametrize("name", sorted(CLAIMS.queries))
def test_query(spark, duck, name):
    df = CLAIMS.queries[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in CLAIMS.sql:
        wanted = duck.sql(CLAIMS.sql[name])
        assert sorted(wanted.columns) == sorted(df.columns)
        assert Counter(map(repr, rows)) == Counter(map(repr, wanted.select(*[f'"{c}"' for c in df.columns]).fetchall()))
    else:
        assert rows


def test_entry(spark):
    assert 0 < entry_module.entry(spark).count() <= 5
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_plans(spark):
    plan = claims_queries.checked(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    # every table is read as often as the mapping onto claims and lines needs it, and no more
    for name, scans in (("process_batch", {"lineitem": 1, "orders": 2}), ("daily_processing_summary", {"lineitem": 1, "orders": 2}), ("validate_claims", {"lineitem": 1, "orders": 2}), ("compliance_dashboard", {"lineitem": 1, "orders": 3})):
        plan = CLAIMS.queries[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        for table, n in scans.items():
            assert plan.count(f"{table}.parquet") == n, (name, table)
    plan = CLAIMS.queries["pending_claims"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["outcome_split", "nested_lines", "failed_records", "potential_revenue_loss", "sort_failed", "process_batch"])
def test_tasks_grow_with_the_files(spark, monkeypatch, name):
    """Lines are grouped and prices joined over as many tasks as the files need, not over the session's few; rows stay the same."""
    rows = Counter(map(repr, CLAIMS.queries[name](spark, SMALL).collect()))
    for setting, value in (("TASK_BYTES", 10_000), ("DEALT_FROM", 0)):
        monkeypatch.setattr(files, setting, value)
    df = CLAIMS.queries[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\((?:l_orderkey|claim_id|_code)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) > 4 and plan.count("Union") == 0
    assert Counter(map(repr, df.collect())) == rows
