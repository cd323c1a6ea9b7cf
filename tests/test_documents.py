"""Document rewrites: each rule on hand-made documents."""

import json

from pyspark.sql import functions as F

from migrakit.functions.maps import drop_keys, set_key
from migrakit.functions.parallel import parse_json
from migrakit.functions.versions import floor_version
from migrakit.operators import documents as D


def test_floor_version(spark):
    cases = {
        "9.1.x-scala2.12": "13.3.x-scala2.12",
        "13.3.x-scala2.12": "13.3.x-scala2.12",
        "13.10.x-cpu-ml-scala2.12": "13.10.x-cpu-ml-scala2.12",   # 13.10 > 13.3 (not a float compare)
        "12.2.x-gpu-ml-scala2.12": "13.3.x-gpu-ml-scala2.12",
        "custom:gpu-ml": "13.3.x-gpu-ml-scala2.12",
        "custom:ml": "13.3.x-cpu-ml-scala2.12",
        "custom:img": "13.3.x-scala2.12",
        "nightly": "nightly",                                     # not a number: left
        "14": "14",                                               # no .x: left
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    got = {r.v: r.n for r in df.select("v", floor_version(F.col("v")).alias("n")).collect()}
    assert got == {**cases, None: None}


def _cluster(spark, doc: dict):
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    return df.select(F.from_json("doc", f"struct<{D.CLUSTER_DDL}>").alias("c"))


def test_cluster_rewrite(spark):
    doc = {"cluster_name": "etl", "spark_version": "11.3.x-scala2.12", "data_security_mode": "NONE",
           "policy_id": "old", "disk_spec": {"disk_count": 1},
           "aws_attributes": {"ebs_volume_type": "GP3"},
           "spark_conf": {"spark.databricks.acl.dfAclsEnabled": "true", "x": "1"},
           "init_scripts": [{"workspace": {"destination": "/Users/a/s.sh"}},
                            {"volumes": {"destination": "/Volumes/v/t.sh"}},
                            {"s3": {"destination": "s3://b/u.sh"}},
                            {"dbfs": {"destination": "dbfs:/x.sh"}}]}
    p = D.ClusterParams(volume_path="/Volumes/main/ops/", single_user="ml@x.org", policy_id="new")
    out = json.loads(_cluster(spark, doc).select(F.to_json(D.rewrite_cluster(F.col("c"), p))).first()[0])
    assert out["cluster_name"] == "etl-UC"
    assert out["spark_version"] == "13.3.x-scala2.12"
    assert out["data_security_mode"] == "USER_ISOLATION"
    assert "single_user_name" not in out
    assert out["policy_id"] == "new"
    assert "disk_spec" not in out
    assert out["spark_conf"] == {"x": "1"}
    assert out["init_scripts"] == [{"volumes": {"destination": "/Volumes/main/ops/s.sh"}},
                                   {"volumes": {"destination": "/Volumes/v/t.sh"}},
                                   {"s3": {"destination": "s3://b/u.sh"}}]


def test_ml_cluster_gets_single_user_and_keeps_scripts(spark):
    doc = {"cluster_name": "ml-UC", "spark_version": "custom:gpu-ml",
           "init_scripts": [{"workspace": {"destination": "/Users/a/s.sh"}}]}
    p = D.ClusterParams(single_user="ml@x.org")
    out = json.loads(_cluster(spark, doc).select(F.to_json(D.rewrite_cluster(F.col("c"), p))).first()[0])
    assert out["cluster_name"] == "ml-UC"          # suffix not doubled
    assert out["spark_version"] == "13.3.x-gpu-ml-scala2.12"
    assert out["data_security_mode"] == "SINGLE_USER" and out["single_user_name"] == "ml@x.org"
    assert out["init_scripts"] == [{"workspace": {"destination": "/Users/a/s.sh"}}]


def test_job_cluster_rules_set_catalog_inside_and_apply_version_rule(spark):
    c1 = {"spark_version": "10.4.x-scala2.12", "spark_conf": {"spark.databricks.repl.allowedLanguages": "sql"}}
    c2 = {"spark_version": "14.1.x-scala2.12"}
    doc = {"tasks": [{"task_key": "a", "new_cluster": c1}, {"task_key": "b", "new_cluster": c2},
                     {"task_key": "c", "existing_cluster_id": "old"}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(
        F.from_json("doc", f"struct<{D.JOB_SETTINGS_DDL}>").alias("s"))
    tasks = D.each(F.col("s.tasks"), "new_cluster", lambda c: D.rewrite_job_cluster(c, "main"))
    tasks = F.transform(tasks, lambda t: t.withField("existing_cluster_id",
                                                     D.override(t["existing_cluster_id"], "new")))
    out = json.loads(df.select(F.to_json(tasks)).first()[0])
    a, b, c = out
    assert a["new_cluster"]["spark_version"] == "13.3.x-scala2.12"
    assert b["new_cluster"]["spark_version"] == "14.1.x-scala2.12"   # the rule acts (not forced)
    assert a["new_cluster"]["data_security_mode"] == "SINGLE_USER"
    assert a["new_cluster"]["spark_conf"] == {D.DEFAULT_CATALOG_KEY: "main"}
    assert b["new_cluster"]["spark_conf"] == {D.DEFAULT_CATALOG_KEY: "main"}  # created inside
    assert "new_cluster" not in c and c["existing_cluster_id"] == "new"


def test_pause_principal_promote(spark):
    doc = {"job_id": "1", "run_as_user_name": "sp-7",
           "settings": {"name": "j", "schedule": {"pause_status": "UNPAUSED"}, "continuous": {}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(
        F.from_json("doc", D.JOB_DOC_DDL).alias("d")).select("d.*")
    r = df.select(D.set_pause(F.col("settings.schedule"), "PAUSED").alias("s"),
                  D.set_pause(F.col("settings.continuous"), "PAUSED").alias("c"),
                  D.set_pause(F.col("settings.schedule"), "NONE").alias("n"),
                  D.tag_principal(F.col("run_as_user_name")).alias("ra"),
                  D.tag_principal(F.col("run_as_user_name"), "me@x.org").alias("ro")).first()
    assert r.s.pause_status == "PAUSED" and r.c.pause_status is None and r.n.pause_status == "UNPAUSED"
    assert r.ra.service_principal_name == "sp-7" and r.ra.user_name is None
    assert r.ro.user_name == "me@x.org"
    clash = df.withColumn("name", F.lit("outer"))
    p = D.promote(clash, "settings")
    assert "settings" not in p.columns and p.first().name == "j"   # nested value wins


def test_map_edits_and_json_edit_keep_types(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1, 2]}, "drop": true}', None)],
                               "doc string, m map<string,string>")
    out = D.edit_json(df, "doc", lambda m: set_key(drop_keys(m, ["drop"]), "k", F.lit("v"), "variant"))
    assert json.loads(out.first().doc) == {"a": 1, "b": {"c": [1, 2]}, "k": "v"}
    r = df.select(set_key(F.col("m"), "k", "v").alias("m")).first()
    assert r.m == {"k": "v"}                                         # map created when missing
    r = df.select(set_key(F.create_map(F.lit("k"), F.lit("old")), "k", "new").alias("m")).first()
    assert r.m == {"k": "new"}                                       # no duplicated key


def test_policy_definition(spark):
    definition = {"spark_conf.spark.databricks.repl.allowedLanguages": {"type": "fixed", "value": "sql"},
                  "spark.databricks.acl.dfAclsEnabled": {"type": "fixed", "value": True},
                  "autotermination_minutes": {"type": "range", "maxValue": 60}}
    df = spark.createDataFrame([(json.dumps(definition),)], "definition string")
    got = json.loads(D.rewrite_policy_definition(df).first().definition)
    assert got == {"autotermination_minutes": {"type": "range", "maxValue": 60}}


def test_read_docs_sets_bad_documents_aside(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": '), (3, None)], "id int, doc string")
    good, bad = D.read_docs(df, "doc", "k long")
    assert sorted((r.id, r.doc.k if r.doc else None) for r in good.collect()) == [(1, 5), (3, None)]
    assert [(r.id, r._corrupt_record) for r in bad.collect()] == [(2, '{"k": ')]


def test_filter_ids(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("cluster_id"))
    assert sorted(r[0] for r in D.filter_ids(df, "cluster_id", " 3, 5 ,,9").collect()) == ["3", "5", "9"]
    ids = spark.createDataFrame([("1",), ("1",), ("7",)], "id string")
    assert sorted(r[0] for r in D.filter_ids(df, "cluster_id", ids).collect()) == ["1", "7"]


def test_flatten_acl_and_remap(spark):
    acl = {"access_control_list": [
        {"user_name": "u", "all_permissions": [{"permission_level": "CAN_RUN", "inherited": False},
                                               {"permission_level": "CAN_VIEW"},
                                               {"permission_level": "CAN_MANAGE", "inherited": True}]},
        {"group_name": "g", "all_permissions": [{"permission_level": "CAN_ATTACH_TO", "inherited": False}]}]}
    empty = {"access_control_list": [{"user_name": "x", "all_permissions": [
        {"permission_level": "CAN_RUN", "inherited": True}]}]}
    df = spark.createDataFrame([("o1", json.dumps(acl)), ("o2", json.dumps(empty))], "object_id string, doc string")
    p = parse_json(df, "doc", D.ACL_DOC_DDL, "d", keep=("object_id",))
    flat = p.select("object_id", D.flatten_acl(F.col("d.access_control_list")).alias("acl"))
    got = {r.object_id: [tuple(x) for x in r.acl] for r in flat.collect()}
    assert got["o1"] == [(None, "u", None, "CAN_RUN"), ("g", None, None, "CAN_ATTACH_TO")]
    assert got["o2"] == []                                             # object stays, list empty
    mapping = spark.createDataFrame([("o1", "n1")], "old_id string, new_id string")
    remapped = D.remap_ids(flat, mapping, "object_id").collect()
    assert [(r.object_id, r.new_id) for r in remapped] == [("o1", "n1")]


def test_rebase_jars(spark):
    doc = {"library_statuses": [{"library": {"jar": "dbfs:/FileStore/jars/a.jar"}},
                                {"library": {"pypi": {"package": "x"}}}, {}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(
        F.from_json("doc", D.LIBRARY_DOC_DDL).alias("d"))
    out = json.loads(df.select(F.to_json(D.rebase_jars(F.col("d.library_statuses"), "/Volumes/l/"))).first()[0])
    assert out == [{"jar": "/Volumes/l/a.jar"}, {"pypi": {"package": "x"}}]


def test_parse_json_parses_once(spark):
    df = spark.createDataFrame([('{"a": {"b": "1", "c": "2"}}',)], "doc string")
    p = parse_json(df, "doc", "a struct<b:string,c:string>", "d")
    q = p.select(F.when(F.col("d.a.b") == "1", F.col("d.a.c")).otherwise(F.col("d.a.b")).alias("x"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and q.first().x == "2"


def test_read_doc_files(spark):
    from migrakit.session import work_dir
    path = work_dir(spark, "tests", "jsonl")
    lines = ['{"cluster_id": "a", "spark_version": "9.1.x-scala2.12"}', '{"cluster_id": "b"', '{"cluster_id": "c"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = D.read_doc_files(spark, path, "cluster_id string, spark_version string")
    assert sorted(r.doc.cluster_id for r in good.collect()) == ["a", "c"]
    assert [r._corrupt_record for r in bad.collect()] == ['{"cluster_id": "b"']


def test_rewrite_job(spark):
    doc = {"job_id": "7", "run_as_user_name": "a@x.org",
           "settings": {"name": "nightly", "schedule": {"pause_status": "UNPAUSED"},
                        "job_clusters": [{"job_cluster_key": "k", "new_cluster": {"spark_version": "12.2.x-scala2.12",
                                                                                   "disk_spec": "d",
                                                                                   "aws_attributes": {"ebs_volume_size": "100"}}}],
                        "tasks": [{"task_key": "t", "existing_cluster_id": "old"}]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(
        F.from_json("doc", D.JOB_DOC_DDL).alias("d"))
    p = D.JobParams(catalog="main", pause_status="PAUSED", existing_cluster_id="new")
    out = json.loads(df.select(F.to_json(D.rewrite_job(F.col("d.settings"), F.col("d.run_as_user_name"), p)))
                     .first()[0])
    assert out["name"] == "nightly-UC" and out["schedule"] == {"pause_status": "PAUSED"}
    assert "continuous" not in out
    nc = out["job_clusters"][0]["new_cluster"]
    assert nc["spark_version"] == "13.3.x-scala2.12" and "disk_spec" not in nc
    assert nc["spark_conf"] == {D.DEFAULT_CATALOG_KEY: "main"} and nc["data_security_mode"] == "SINGLE_USER"
    assert out["tasks"] == [{"task_key": "t", "existing_cluster_id": "new"}]
    assert out["run_as"] == {"user_name": "a@x.org"}


def test_rules_on_missing_parts(spark):
    df = spark.createDataFrame([(None,), ('{"cluster_name": "x"}',), ('{"init_scripts": [], "spark_conf": {}}',)],
                               "doc string").select(F.from_json("doc", f"struct<{D.CLUSTER_DDL}>").alias("c"))
    p = D.ClusterParams(volume_path="/V", single_user="u@x.org", policy_id="P")
    rows = df.select(D.rewrite_cluster(F.col("c"), p).alias("r")).collect()
    assert rows[0].r is None or rows[0].r.cluster_name is None          # no document: nothing invented
    assert rows[1].r.cluster_name == "x-UC" and rows[1].r.init_scripts is None
    assert rows[1].r.policy_id is None and rows[1].r.data_security_mode == "USER_ISOLATION"
    assert rows[2].r.init_scripts == [] and rows[2].r.spark_conf == {}
    acl = spark.createDataFrame([(None,), ([],)], f"a {D.ACL_DOC_DDL.split('access_control_list ')[1]}")
    assert [r.f for r in acl.select(D.flatten_acl(F.col("a")).alias("f")).collect()] == [None, []]
