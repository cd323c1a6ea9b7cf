"""Plans that return complete rewritten documents.  The documents hold keys at
every level that no rule names, and some are cut short; the statements write
out the documents that must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import set_key
from ..functions.parallel import spread
from ..operators import whole_docs as W
from ..operators.documents import DEFAULT_CATALOG_KEY, JobParams, edit_json
from ..sources import fixtures as fx
from .doc_plans import CATALOG, EXISTING_CLUSTER, ML_USER, PARAMS, PAUSE, POLICY_ID, VOLUME, _sql_floor
from .registry import plan

#: The documents, in SQL that Spark and DuckDB both read.
_VERSION = ("CASE event_id % 4 WHEN 0 THEN '9.1.x-scala2.12' WHEN 1 THEN '13.10.x-cpu-ml-scala2.12' "
            "WHEN 2 THEN 'custom:gpu-ml' ELSE 'nightly' END")
_ID, _USER = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)"
_EBS = "CASE WHEN event_id % 5 = 0 THEN ',\"ebs_volume_count\":1' ELSE '' END"
_CLUSTER_DOC = f"""concat('{{"cluster_id":"c', {_ID}, '","cluster_name":"n', {_ID}, '","spark_version":"', {_VERSION},
  '","num_workers":', CAST(event_id % 9 AS STRING), ',"ratio":0.5,"custom_tags":{{"team":"', event_type,
  '","nested":[1,{{"x":null}}]}},"disk_spec":{{"kind":"d"}},"aws_attributes":{{"zone":"z"', {_EBS},
  '}},"spark_conf":{{"spark.databricks.acl.dfAclsEnabled":"true","own":"', {_USER},
  '"}},"init_scripts":[{{"workspace":{{"destination":"/w/', {_USER}, '.sh"}}}},{{"s3":{{"destination":"s3://b/i.sh","region":"r"}}}},{{"dbfs":{{"destination":"dbfs:/x"}}}}],"policy_id":"P-OLD"}}')"""
_JOB_DOC = f"""concat('{{"job_id":', {_ID}, ',"run_as_user_name":"', CASE WHEN event_id % 2 = 0 THEN 'u@x.org' ELSE 'sp-1' END,
  '","settings":{{"name":"j', {_ID}, '","timeout_seconds":', CAST(event_id % 60 AS STRING),
  ',"schedule":{{"quartz_cron_expression":"0 0 * * * ?","timezone_id":"UTC","pause_status":"UNPAUSED"}},"job_clusters":[{{"job_cluster_key":"main","new_cluster":{{"spark_version":"', {_VERSION},
  '","num_workers":2,"disk_spec":{{"kind":"d"}},"aws_attributes":{{"zone":"z"', {_EBS}, '}}}}}}],"tasks":[{{"task_key":"run","depends_on":[{{"task_key":"first"}}],"notebook_task":{{"path":"/n/', event_type,
  '"}},"new_cluster":{{"spark_version":"9.1.x-scala2.12","node_type_id":"i3","spark_conf":{{"own":"', {_USER},
  '"}}}}}},{{"task_key":"attach","existing_cluster_id":"c-old","timeout_seconds":7}}]}}}}')"""
_LIB_DOC = f"""concat('{{"cluster_id":"', {_ID}, '","state":"ok","library_statuses":[{{"library":{{"jar":"dbfs:/FileStore/', event_type, '/', {_USER},
  '.jar"}},"status":"INSTALLED"}},{{"library":{{"egg":"dbfs:/e.egg"}}}},{{"library":{{"pypi":{{"package":"p', {_USER}, '","repo":"https://r"}}}}}},{{"status":"PENDING"}}]}}')"""


def _broken(doc: str) -> str:
    """Every document whose event_id ends in 7 is cut short by one character."""
    return f"CASE WHEN event_id % 10 = 7 THEN substr({doc}, 1, length({doc}) - 1) ELSE {doc} END"


def _docs(spark: SparkSession, sf_dir: str, doc: str) -> DataFrame:
    events = spread(fx.base(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    return events.select("event_id", F.expr(doc).alias("doc"))


def _oracle(doc: str, want: str, extra: str = "") -> str:
    return f"""
SELECT event_id, CASE WHEN event_id % 10 = 7 THEN NULL ELSE {want} END AS doc,
  CASE WHEN event_id % 10 = 7 THEN substr(raw, 1, length(raw) - 1) END AS bad_doc
FROM (SELECT *, {doc} AS raw, {_sql_floor(f'({_VERSION})')} AS nv{extra} FROM events)"""


@plan("cluster_rewrite", _oracle(_CLUSTER_DOC, f"""concat('{{"aws_attributes":{{', CASE WHEN event_id % 5 = 0 THEN '"ebs_volume_count":1,' ELSE '' END,
  '"zone":"z"}},"cluster_id":"c', {_ID}, '","cluster_name":"n', {_ID}, '-UC","custom_tags":{{"nested":[1,{{"x":null}}],"team":"', event_type,
  '"}},"data_security_mode":"', CASE WHEN contains(nv, 'ml') THEN 'SINGLE_USER' ELSE 'USER_ISOLATION' END, '"',
  CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"disk_spec":{{"kind":"d"}}' END, ',"init_scripts":[',
  CASE WHEN contains(nv, 'ml') THEN concat('{{"workspace":{{"destination":"/w/', {_USER}, '.sh"}}}},{{"s3":{{"destination":"s3://b/i.sh","region":"r"}}}},{{"dbfs":{{"destination":"dbfs:/x"}}}}')
       ELSE concat('{{"volumes":{{"destination":"{VOLUME}/', {_USER}, '.sh"}}}},{{"s3":{{"destination":"s3://b/i.sh"}}}}') END,
  '],"num_workers":', CAST(event_id % 9 AS STRING), ',"policy_id":"{POLICY_ID}","ratio":0.5',
  CASE WHEN contains(nv, 'ml') THEN ',"single_user_name":"{ML_USER}"' ELSE '' END,
  ',"spark_conf":{{"own":"', {_USER}, '"}},"spark_version":"', nv, '"}}')"""))
def q_cluster_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D3-D6, D9, D10 on whole cluster documents."""
    return W.rewrite_docs(_docs(spark, sf_dir, _broken(_CLUSTER_DOC)), "doc", lambda m: W.rewrite_cluster_doc(m, PARAMS))


@plan("job_rewrite", _oracle(_JOB_DOC, f"""concat('{{"job_clusters":[{{"job_cluster_key":"main","new_cluster":{{"aws_attributes":{{',
  CASE WHEN event_id % 5 = 0 THEN '"ebs_volume_count":1,' ELSE '' END, '"zone":"z"}},"data_security_mode":"SINGLE_USER"',
  CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"disk_spec":{{"kind":"d"}}' END,
  ',"num_workers":2,"spark_conf":{{"{DEFAULT_CATALOG_KEY}":"{CATALOG}"}},"spark_version":"', nv, '"}}}}],"job_id":', {_ID}, ',"name":"j', {_ID},
  '-UC","run_as":', CASE WHEN event_id % 2 = 0 THEN '{{"user_name":"u@x.org"}}' ELSE '{{"service_principal_name":"sp-1"}}' END,
  ',"run_as_user_name":"', CASE WHEN event_id % 2 = 0 THEN 'u@x.org' ELSE 'sp-1' END,
  '","schedule":{{"pause_status":"{PAUSE}","quartz_cron_expression":"0 0 * * * ?","timezone_id":"UTC"}},"tasks":[{{"depends_on":[{{"task_key":"first"}}],"new_cluster":{{"data_security_mode":"SINGLE_USER","node_type_id":"i3","spark_conf":{{"own":"',
  {_USER}, '","{DEFAULT_CATALOG_KEY}":"{CATALOG}"}},"spark_version":"13.3.x-scala2.12"}},"notebook_task":{{"path":"/n/', event_type,
  '"}},"task_key":"run"}},{{"existing_cluster_id":"{EXISTING_CLUSTER}","task_key":"attach","timeout_seconds":7}}],"timeout_seconds":', CAST(event_id % 60 AS STRING), '}}')"""))
def q_job_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7-D11, D14 on whole job documents."""
    p = JobParams(catalog=CATALOG, pause_status=PAUSE, existing_cluster_id=EXISTING_CLUSTER)
    return W.rewrite_docs(_docs(spark, sf_dir, _broken(_JOB_DOC)), "doc", lambda m: W.rewrite_job_doc(m, p))


@plan("library_rewrite", _oracle(_LIB_DOC, f"""concat('{{"cluster_id":"', {_ID}, '","libraries":[{{"jar":"{VOLUME}/', {_USER},
  '.jar"}},{{"egg":"dbfs:/e.egg"}},{{"pypi":{{"package":"p', {_USER}, '","repo":"https://r"}}}}],"state":"ok"}}')"""))
def q_library_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 on whole library answers."""
    return W.rewrite_docs(_docs(spark, sf_dir, _broken(_LIB_DOC)), "doc", lambda m: W.rewrite_library_doc(m, VOLUME))


#: The same small document with a key repeated at the top, in an object, in an object of a list, or nowhere.
_REPEATED = f"""concat('{{{{"name":"n', {_ID}, '",', CASE WHEN event_id % 4 = 1 THEN '"name":"again",' ELSE '' END,
  '"spark_conf":{{{{"own":"', {_USER}, '"', CASE WHEN event_id % 4 = 2 THEN ',"own":"x"' ELSE '' END, '}}}},"tasks":[{{{{"task_key":"t"',
  CASE WHEN event_id % 4 = 3 THEN ',"task_key":"u"' ELSE '' END, '}}}}]}}}}')""".replace("{{", "{").replace("}}", "}")


@plan("repeated_keys", f"""
SELECT event_id, rule, CASE WHEN event_id % 4 = 0 THEN concat('{{', CASE WHEN rule = 'cluster' THEN '"data_security_mode":"USER_ISOLATION",' ELSE '' END,
  '"name":"n', {_ID}, CASE WHEN rule = 'edit' THEN '' ELSE '-UC' END, '","spark_conf":{{"own":"', {_USER}, '"}},"tasks":[{{"task_key":"t"}}]',
  CASE WHEN rule = 'edit' THEN ',"type":"e"' ELSE '' END, '}}') END AS doc,
  CASE WHEN event_id % 4 <> 0 THEN raw END AS bad_doc
FROM (SELECT *, {_REPEATED} AS raw FROM events), (VALUES ('cluster'), ('job'), ('edit')) AS r(rule)""")
def q_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D11, D12, D14 on documents that hold a key twice: set aside whole, at
    whatever depth; none fails the run or loses a value in silence."""
    docs = _docs(spark, sf_dir, _REPEATED)
    rules = {"cluster": W.rewrite_docs(docs, "doc", lambda m: W.rewrite_cluster_doc(m, PARAMS)),
             "job": W.rewrite_docs(docs, "doc", lambda m: W.rewrite_job_doc(m, JobParams(catalog=CATALOG))),
             "edit": edit_json(docs, "doc", lambda m: set_key(m, "type", F.parse_json(F.lit('"e"')), "variant"))}
    parts = [d.select("event_id", F.lit(name).alias("rule"), "doc", "bad_doc") for name, d in rules.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
