"""Physical plan shapes the scale design relies on."""

import re

from pyspark.sql import functions as F

from migrakit.operators.sync import plan_sync
from migrakit.operators.verify import verify_counts
from migrakit.sources import fixtures as fx
from migrakit.sources.tables import TableRef, _count_frame, read_table
import __spark_entry__ as entry
from migrakit.plans import load_all
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_outer_matches_are_one_aggregation_without_join(spark):
    for df in (verify_counts(fx.source_counts(spark, SF_SMALL), fx.target_counts(spark, SF_SMALL)),
               plan_sync(fx.inventory(spark, SF_SMALL), fx.target_inventory(spark, SF_SMALL))):
        p = _plan(df)
        assert "Join" not in p
        assert "partial_" in p or p.count("HashAggregate(keys=") >= 2   # map-side partial aggregation before the shuffle


def test_count_reads_no_column(spark):
    ref = TableRef("d", "lineitem", "parquet", f"{SF_SMALL}/lineitem.parquet")
    p = _plan(_count_frame(ref, read_table(spark, ref)))
    assert re.search(r"ReadSchema: struct<>", p)


def test_scans_prune_columns(spark):
    p = _plan(entry.queries()["grants_by_principal"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert schema == "struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>"
    assert "collect_list" in p and re.search(r"HashAggregate\(keys=\[schema_name", p)   # distinct before the lists


def test_documents_parse_once_and_do_not_shuffle_by_key(spark):
    for name in ("each_cluster", "rebase_paths", "derive_mode", "flatten_acl"):
        p = _plan(entry.queries()[name](spark, SF_SMALL))
        assert p.count("from_json") == 1, name
        exchanges = re.findall(r"Exchange (\w+)", p)
        assert set(exchanges) <= {"RoundRobinPartitioning"}, (name, exchanges)


def test_document_rewrites_use_every_core(spark, tmp_path):
    """One small file is one read task; its rows are rewritten by many, evenly."""
    rows = [(i, i % 50, "click") for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("job_rewrite", "cluster_rewrite", "library_rewrite", "repeated_keys"):
        df = entry.queries()[name](spark, str(tmp_path))
        exchanges = re.findall(r"Exchange (\w+)\((\d+)", _plan(df))
        assert exchanges and all(k == "RoundRobinPartitioning" and int(n) >= 3 * spark.sparkContext.defaultParallelism for k, n in exchanges), name
        sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) >= 12 and max(sizes) < 2 * sum(sizes) / len(sizes), (name, sizes)


def test_no_udf_anywhere(spark):
    for name, fn in load_all()[0].items():
        if name in ("copy_verify", "copy_outcomes", "resumable_copy", "sync_apply", "view_cut_over"):
            continue
        p = _plan(fn(spark, SF_SMALL))
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_record_frames_are_local_relations(spark):
    from migrakit.operators.copying import OUTCOME_SCHEMA
    from migrakit.sources.tables import records
    for schema, rows in ((OUTCOME_SCHEMA, [("d", "t", "/a", "/b", "parquet", True, "copied", None, 1, None)]),
                         ("a array<string>, m map<string,string>, s struct<x:int>", [(["x"], {"k": "v"}, (1,))]),
                         ("n long", [])):
        df = records(spark, rows, schema)
        assert df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"
        assert len(df.collect()) == len(rows)
