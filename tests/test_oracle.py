"""Every registered plan against its DuckDB statement on the smallest tables
(the driver runs the same check at sf0.01); plans without a statement must
at least run and give rows."""

import pytest

import __spark_entry__ as entry
from migrakit.plans import load_all
from tests.conftest import SF_SMALL
from tests.harness import compare

PLANS, ORACLE = load_all()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_plan_matches_oracle(spark, con, name):
    res = compare(PLANS[name](spark, SF_SMALL), con, ORACLE[name])
    assert res["ok"], res


def test_every_plan_has_an_oracle():
    assert set(ORACLE) == set(PLANS)


def test_entry_lists_every_plan():
    assert set(PLANS) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 14
    assert {r["verdict"] for r in rows} == {"match"}
    assert df.columns == ["database", "table_name", "source_count", "target_count", "verdict"]
