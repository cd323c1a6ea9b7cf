"""Every registered query with a statement against DuckDB; the others at least
return one row per document."""

import pytest

from migrakit.llm import queries as llm
from tests.conftest import SF_SMALL
from tests.harness import compare

PER_DOCUMENT = ["op2_ctw_score", "op4_language_id", "op8_shard_bytes", "op9_simhash", "op10_pseudonymise"]


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_matches_statement(spark, con, name):
    res = compare(llm.QUERIES[name](spark, SF_SMALL), con, llm.ORACLE[name])
    assert res["ok"], res


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ids = [r["doc_id"] for r in llm.QUERIES[name](spark, SF_SMALL).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_all_operators_and_the_pipeline_are_registered():
    names = list(llm.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_line_dedup", "op7_decontaminate", "op10_pseudonymise"])
def test_native_operators_run_no_python(spark, name):
    plan = llm.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
