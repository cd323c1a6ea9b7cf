"""Whole workflows as operator chains (README: the reference's workflows)."""

import uuid

from pyspark.sql import functions as F

import migrakit as mk
from migrakit.functions.parallel import parse_json
from migrakit.operators import documents as D
from migrakit.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_copy_workflow(spark):
    db = "flow_" + uuid.uuid4().hex[:8]
    base = mk.work_dir(spark, "tests", db)
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    for t in ("orders", "region"):
        spark.catalog.createTable(f"{db}.{t}", path=f"{SF_SMALL}/{t}.parquet", source="parquet")
    inv = mk.inventory_from_catalog(spark, [db])
    refs = [mk.TableRef(r.database, r.table_name, r.provider, r.location) for r in inv.collect()]
    counts = mk.count_tables(spark, refs)
    plan = mk.plan_copy(inv, counts, f"{base}/copies")          # local paths are not on "s3": all copied
    outcomes = mk.copy_from_plan(spark, plan)
    assert {r.table_name: r.action for r in outcomes.collect()} == {"orders": "copied", "region": "copied"}
    pairs = [(r, r.at(f"{base}/copies/{r.database}/{r.table}")) for r in refs]
    ok, bad = mk.split_outcomes(mk.verify_copies(spark, pairs))
    assert ok.count() == 2 and bad.count() == 0


def test_job_clone_workflow(spark):
    docs = fx.config_docs(spark, SF_SMALL)
    good, bad = mk.read_docs(docs, "doc", D.JOB_DOC_DDL)
    assert bad.count() == 0
    wanted = mk.filter_ids(good, "doc_id", fx.id_map(spark, SF_SMALL), id_col="old_id")
    jobs = mk.promote(wanted.select("doc_id", "doc.*"), "settings")
    p = mk.JobParams(catalog="main", pause_status="PAUSED", run_as="svc-1")
    settings = F.struct(*[F.col(c) for c in jobs.columns if c not in ("doc_id", "run_as_user_name")])
    out = jobs.select("doc_id", mk.rewrite_job(settings, F.col("run_as_user_name"), p).alias("s"))
    rows = out.select("doc_id", "s.name", "s.schedule.pause_status", "s.run_as.service_principal_name").collect()
    assert len(rows) == wanted.count() > 0
    assert all(r.name.endswith("-UC") and r.service_principal_name == "svc-1" for r in rows)
    assert {r.pause_status for r in rows} <= {"PAUSED", None}


def test_cluster_clone_workflow(spark):
    docs = parse_json(fx.config_docs(spark, SF_SMALL), "doc", f"settings struct<{D.CLUSTER_DDL}>", "d",
                      keep=("doc_id",))
    p = mk.ClusterParams(volume_path="/Volumes/main/ops", single_user="ml@x.org", policy_id="P1")
    out = docs.select("doc_id", mk.rewrite_cluster(F.col("d.settings"), p).alias("c"))
    rows = out.select("doc_id", "c.spark_version", "c.data_security_mode", "c.init_scripts").collect()
    assert all(r.data_security_mode in ("SINGLE_USER", "USER_ISOLATION") for r in rows)
    assert not any(s.workspace for r in rows if r.init_scripts for s in r.init_scripts
                   if r.data_security_mode == "USER_ISOLATION")
