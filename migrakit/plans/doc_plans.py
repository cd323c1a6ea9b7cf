"""Plans of the document family over configuration documents, event
properties, policy definitions and access lists derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import drop_keys, set_key
from ..functions.parallel import parse_json
from ..functions.versions import floor_version
from ..operators import documents as D
from ..operators.projections import stringify
from ..session import work_dir
from ..sources import fixtures as fx
from .registry import plan

# Parameters of the rewrites (what a user passes in).
VOLUME = "/Volumes/main/ops/init"
ML_USER = "ml-runner@x.org"
CATALOG = "main"
PAUSE = "PAUSED"
POLICY_ID = "P-NEW"
EXISTING_CLUSTER = "c-new"
DROPPED_CONF = ("acl", "error")
PARAMS = D.ClusterParams(volume_path=VOLUME, single_user=ML_USER, policy_id=POLICY_ID, catalog=CATALOG)


def _config(spark, sf_dir) -> DataFrame:
    """config_docs parsed (once per row) with the job document schema."""
    return parse_json(fx.config_docs(spark, sf_dir), "doc", D.JOB_DOC_DDL, "d", keep=("doc_id",))


def _settings(spark, sf_dir) -> DataFrame:
    return _config(spark, sf_dir).select("doc_id", "d.run_as_user_name", "d.settings")


# ---- DuckDB pieces -----------------------------------------------------

def _js(path: str) -> str:
    return f"json_extract_string(doc, '$.{path}')"


def _sql_floor(v: str) -> str:
    nbr = f"split_part({v}, '.x', 1)"
    major = f"TRY_CAST(split_part({nbr}, '.', 1) AS INTEGER)"
    minor = f"coalesce(TRY_CAST(split_part({nbr}, '.', 2) AS INTEGER), 0)"
    return (f"CASE WHEN {v} IS NULL THEN NULL "
            f"WHEN contains({v}, 'custom') THEN CASE WHEN contains({v}, 'ml') AND contains({v}, 'gpu') "
            f"THEN '13.3.x-gpu-ml-scala2.12' WHEN contains({v}, 'ml') THEN '13.3.x-cpu-ml-scala2.12' "
            f"ELSE '13.3.x-scala2.12' END "
            f"WHEN contains({v}, '.x') AND regexp_full_match({nbr}, '[0-9]+(\\.[0-9]+)?') "
            f"AND ({major} < 13 OR ({major} = 13 AND {minor} < 3)) "
            f"THEN concat('13.3.x', regexp_extract({v}, '^.*\\.x(.*)$', 1)) ELSE {v} END")


_CFG = fx.with_fixtures("SELECT 1", "config_docs")
_CFG_HEAD = _CFG[: _CFG.rindex("SELECT 1")].rstrip()
_CFG_SQL = f"""{_CFG_HEAD},
cfg AS (SELECT doc_id, doc, {_js('settings.spark_version')} AS v, {_js('settings.data_security_mode')} AS m,
  {_js('settings.single_user_name')} AS su FROM config_docs),
cfg2 AS (SELECT *, {_sql_floor('v')} AS nv FROM cfg),
cfg3 AS (SELECT *, CASE WHEN contains(nv, 'ml') THEN '{ML_USER}' ELSE su END AS nu,
  CASE WHEN contains(nv, 'ml') THEN 'SINGLE_USER' WHEN contains(coalesce(m, ''), 'SINGLE_USER') THEN 'SINGLE_USER'
       ELSE 'USER_ISOLATION' END AS nm FROM cfg2)
"""


def _cfg_sql(select: str) -> str:
    return _CFG_SQL + select.strip()


# ---- plans -------------------------------------------------------------

@plan("floor_version", _cfg_sql("SELECT doc_id, v AS spark_version, nv AS new_version FROM cfg3"))
def q_floor_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime versions raised to the floor."""
    s = _settings(spark, sf_dir)
    return s.select("doc_id", F.col("settings.spark_version").alias("spark_version"),
                    floor_version(F.col("settings.spark_version")).alias("new_version"))


@plan("derive_mode", _cfg_sql(
    "SELECT doc_id, nv AS new_version, nm AS data_security_mode, nu AS single_user_name FROM cfg3"))
def q_derive_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security mode and single user derived from the version."""
    c = D.rewrite_cluster(F.col("settings"), PARAMS)
    return _settings(spark, sf_dir).select(
        "doc_id", c["spark_version"].alias("new_version"),
        c["data_security_mode"].alias("data_security_mode"),
        c["single_user_name"].alias("single_user_name"))


@plan("override_suffix", _cfg_sql(f"""
SELECT doc_id, CASE WHEN ends_with({_js('settings.name')}, '-UC') THEN {_js('settings.name')}
                    ELSE concat({_js('settings.name')}, '-UC') END AS name,
  CASE WHEN {_js('settings.policy_id')} IS NOT NULL THEN '{POLICY_ID}' END AS policy_id FROM cfg3"""))
def q_override_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixed names; policy id replaced where one is set."""
    c = D.rewrite_cluster(F.col("settings"), PARAMS)
    return _settings(spark, sf_dir).select("doc_id", c["name"].alias("name"),
                                           c["policy_id"].alias("policy_id"))


_SCRIPTS = ("from_json(json_extract(doc, '$.settings.init_scripts'), "
            "'[{\"workspace\":{\"destination\":\"VARCHAR\"},\"volumes\":{\"destination\":\"VARCHAR\"},"
            "\"s3\":{\"destination\":\"VARCHAR\"},\"dbfs\":{\"destination\":\"VARCHAR\"}}]')")


@plan("rebase_paths", _cfg_sql(f"""
SELECT doc_id, nu AS single_user_name,
  CASE WHEN nu IS NULL THEN array_to_string(list_transform(list_filter({_SCRIPTS},
         lambda x: x.workspace IS NOT NULL OR x.volumes IS NOT NULL OR x.s3 IS NOT NULL),
         lambda x: CASE WHEN x.workspace IS NOT NULL OR x.volumes IS NOT NULL THEN 'volumes' ELSE 's3' END), ',')
       ELSE array_to_string(list_transform({_SCRIPTS}, lambda x: CASE WHEN x.workspace IS NOT NULL THEN 'workspace'
         WHEN x.volumes IS NOT NULL THEN 'volumes' WHEN x.s3 IS NOT NULL THEN 's3' ELSE 'dbfs' END), ',') END AS script_kinds,
  CASE WHEN nu IS NULL THEN array_to_string(list_transform(list_filter({_SCRIPTS},
         lambda x: x.workspace IS NOT NULL OR x.volumes IS NOT NULL OR x.s3 IS NOT NULL),
         lambda x: CASE WHEN x.workspace IS NOT NULL
           THEN concat('{VOLUME}/', regexp_extract(x.workspace.destination, '[^/]*$', 0))
           WHEN x.volumes IS NOT NULL THEN x.volumes.destination ELSE x.s3.destination END), ',')
       ELSE array_to_string(list_transform({_SCRIPTS}, lambda x: coalesce(x.workspace.destination,
         x.volumes.destination, x.s3.destination, x.dbfs.destination)), ',') END AS script_destinations
FROM cfg3"""))
def q_rebase_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Init scripts moved to the volume path unless a single
    user is set; other kinds dropped."""
    c = D.rewrite_cluster(F.col("settings"), PARAMS)
    scripts = c["init_scripts"]
    kind = F.transform(scripts, lambda x: F.when(x["workspace"].isNotNull(), "workspace")
                       .when(x["volumes"].isNotNull(), "volumes").when(x["s3"].isNotNull(), "s3")
                       .otherwise("dbfs"))
    dest = F.transform(scripts, lambda x: F.coalesce(
        x["workspace"]["destination"], x["volumes"]["destination"], x["s3"]["destination"],
        x["dbfs"]["destination"]))
    return _settings(spark, sf_dir).select(
        "doc_id", c["single_user_name"].alias("single_user_name"),
        F.array_join(kind, ",").alias("script_kinds"), F.array_join(dest, ",").alias("script_destinations"))


@plan("drop_field_if", _cfg_sql(f"""
SELECT doc_id, CASE WHEN coalesce({_js('settings.aws_attributes.ebs_volume_count')} IS NOT NULL
    OR {_js('settings.aws_attributes.ebs_volume_type')} IS NOT NULL
    OR {_js('settings.aws_attributes.ebs_volume_size')} IS NOT NULL, false) THEN NULL
  ELSE {_js('settings.disk_spec')} END AS disk_spec,
  {_js('settings.aws_attributes.ebs_volume_count')} AS ebs_volume_count FROM cfg3"""))
def q_drop_field_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """disk_spec dropped where volume fields are set."""
    c = D.rewrite_cluster(F.col("settings"), PARAMS)
    return _settings(spark, sf_dir).select(
        "doc_id", c["disk_spec"].alias("disk_spec"),
        F.col("settings.aws_attributes.ebs_volume_count").alias("ebs_volume_count"))


@plan("set_pause", _cfg_sql(f"""
SELECT doc_id, CASE WHEN {_js('settings.schedule.pause_status')} IS NOT NULL THEN '{PAUSE}' END AS schedule_pause,
  CASE WHEN {_js('settings.continuous.pause_status')} IS NOT NULL THEN '{PAUSE}' END AS continuous_pause FROM cfg3"""))
def q_set_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pause status set where a schedule or continuous trigger has one."""
    s = _settings(spark, sf_dir)
    return s.select("doc_id",
                    D.set_pause(F.col("settings.schedule"), PAUSE)["pause_status"].alias("schedule_pause"),
                    D.set_pause(F.col("settings.continuous"), PAUSE)["pause_status"].alias("continuous_pause"))


@plan("tag_principal", _cfg_sql(f"""
SELECT doc_id, {_js('run_as_user_name')} AS run_as_user_name,
  CASE WHEN contains({_js('run_as_user_name')}, '@') THEN {_js('run_as_user_name')} END AS run_as_user,
  CASE WHEN NOT contains({_js('run_as_user_name')}, '@') THEN {_js('run_as_user_name')} END AS run_as_service_principal
FROM cfg3"""))
def q_tag_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-as principal tagged as user or service principal."""
    s = _settings(spark, sf_dir)
    t = D.tag_principal(F.col("run_as_user_name"))
    return s.select("doc_id", "run_as_user_name", t["user_name"].alias("run_as_user"),
                    t["service_principal_name"].alias("run_as_service_principal"))


@plan("promote", _cfg_sql(f"""
SELECT doc_id, {_js('run_as_user_name')} AS run_as_user_name, {_js('settings.name')} AS name,
  {_js('settings.spark_version')} AS spark_version, {_js('settings.data_security_mode')} AS data_security_mode,
  {_js('settings.disk_spec')} AS disk_spec,
  CAST(to_json(from_json(json_extract(doc, '$.settings.spark_conf'), '"MAP(VARCHAR, VARCHAR)"')) AS VARCHAR) AS spark_conf
FROM cfg3"""))
def q_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings fields promoted to top-level columns."""
    p = D.promote(_config(spark, sf_dir).select("doc_id", "d.*"), "settings")
    return p.select("doc_id", "run_as_user_name", "name", "spark_version", "data_security_mode",
                    "disk_spec", F.to_json("spark_conf").alias("spark_conf"))


_CONF_DUCK = "from_json(json_extract(doc, '$.settings.spark_conf'), '\"MAP(VARCHAR, VARCHAR)\"')"


@plan("drop_keys", _cfg_sql(f"""
SELECT doc_id, CAST(to_json(map_from_entries(list_filter(map_entries({_CONF_DUCK}),
  lambda e: e.key NOT IN ('acl', 'error')))) AS VARCHAR) AS spark_conf FROM cfg3"""))
def q_drop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration keys removed."""
    s = _settings(spark, sf_dir)
    return s.select("doc_id", F.to_json(drop_keys(F.col("settings.spark_conf"), DROPPED_CONF)).alias("spark_conf"))


_JOB_CLUSTER_CONF = (f"CAST(to_json(map_concat(map_from_entries(list_filter(map_entries({_CONF_DUCK}), "
                     f"lambda e: e.key <> '{D.DEFAULT_CATALOG_KEY}')), MAP {{'{D.DEFAULT_CATALOG_KEY}': '{CATALOG}'}})) AS VARCHAR)")


@plan("each_cluster", _cfg_sql(f"""
SELECT doc_id, 'job_cluster' AS kind, 'main' AS element_key, nv AS spark_version, 'SINGLE_USER' AS data_security_mode,
  {_JOB_CLUSTER_CONF} AS spark_conf,
  CASE WHEN {_js('settings.aws_attributes.ebs_volume_count')} IS NOT NULL THEN NULL ELSE {_js('settings.disk_spec')} END AS disk_spec,
  NULL AS existing_cluster_id FROM cfg3
UNION ALL
SELECT doc_id, 'task', 'run', nv, 'SINGLE_USER', {_JOB_CLUSTER_CONF},
  CASE WHEN {_js('settings.aws_attributes.ebs_volume_count')} IS NOT NULL THEN NULL ELSE {_js('settings.disk_spec')} END,
  NULL FROM cfg3
UNION ALL
SELECT doc_id, 'task', 'attach', NULL, NULL, NULL, NULL, '{EXISTING_CLUSTER}' FROM cfg3"""))
def q_each_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job-cluster rules applied to every element of a job's
    ``job_clusters`` and ``tasks`` lists.  Each document becomes a job whose
    cluster list holds its settings (one job cluster, one task running on a
    new cluster, one task attached to an existing cluster)."""
    s = _settings(spark, sf_dir)
    cluster = F.col("settings").dropFields("schedule", "continuous", "job_clusters", "tasks")
    none = F.lit(None).cast(s.schema["settings"].dataType).dropFields(
        "schedule", "continuous", "job_clusters", "tasks")
    job = s.select("doc_id",
                   F.array(F.struct(F.lit("main").alias("job_cluster_key"),
                                    cluster.alias("new_cluster"))).alias("job_clusters"),
                   F.array(F.struct(F.lit("run").alias("task_key"),
                                    F.lit(None).cast("string").alias("existing_cluster_id"),
                                    cluster.alias("new_cluster")),
                           F.struct(F.lit("attach").alias("task_key"),
                                    F.lit("c-old").alias("existing_cluster_id"),
                                    none.alias("new_cluster"))).alias("tasks"))
    fn = lambda c: D.rewrite_job_cluster(c, CATALOG)
    job = job.select(
        "doc_id",
        D.each(F.col("job_clusters"), "new_cluster", fn).alias("job_clusters"),
        F.transform(D.each(F.col("tasks"), "new_cluster", fn), lambda t: t.withField(
            "existing_cluster_id", D.override(t["existing_cluster_id"], EXISTING_CLUSTER))).alias("tasks"))
    # Both lists in one generate: each document is read and parsed once.
    elements = F.concat(
        F.transform("job_clusters", lambda x: F.struct(
            F.lit("job_cluster").alias("kind"), x["job_cluster_key"].alias("element_key"),
            x["new_cluster"].alias("c"), F.lit(None).cast("string").alias("existing_cluster_id"))),
        F.transform("tasks", lambda x: F.struct(
            F.lit("task").alias("kind"), x["task_key"].alias("element_key"),
            x["new_cluster"].alias("c"), x["existing_cluster_id"].alias("existing_cluster_id"))))
    return job.select("doc_id", F.explode(elements).alias("e")).select(
        "doc_id", "e.kind", "e.element_key", F.col("e.c.spark_version").alias("spark_version"),
        F.col("e.c.data_security_mode").alias("data_security_mode"),
        F.to_json("e.c.spark_conf").alias("spark_conf"), F.col("e.c.disk_spec").alias("disk_spec"),
        "e.existing_cluster_id")


# Documents of one event type are cut short by one character.
_BROKEN = "CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END"


# ---- event properties --------------------------------------------------

@plan("set_key", """
SELECT event_id, CAST(to_json(map_concat(map_from_entries(list_filter(map_entries(from_json(props, '"MAP(VARCHAR, VARCHAR)"')),
  lambda e: e.key <> 'source')), MAP {'source': event_type})) AS VARCHAR) AS props FROM events""")
def q_set_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key set in every property map (replacing an existing one)."""
    e = fx.base(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.to_json(set_key(m, "source", F.col("event_type"))).alias("props"))


@plan("edit_json", """
SELECT event_id, CASE WHEN json_valid(props) THEN CAST(to_json(map_concat(map_from_entries(list_filter(map_entries(from_json(props, '"MAP(VARCHAR, JSON)"')),
  lambda e: e.key NOT IN (""" + ", ".join(f"'{k}'" for k in (*D.LEGACY_CONF_KEYS, "type")) + """))),
  MAP {'type': to_json(event_type)})) AS VARCHAR) END AS props, CASE WHEN NOT json_valid(props) THEN props END AS bad_doc
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END AS props FROM events)""")
def q_edit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text parsed, edited (legacy keys out, a key set) and
    written back; values keep their JSON types."""
    e = fx.base(spark, sf_dir, "events").withColumn("props", F.expr(_BROKEN))
    out = D.edit_json(e, "props", lambda m: set_key(drop_keys(m, D.LEGACY_CONF_KEYS), "type",
                                                     F.col("event_type"), value_type="variant"))
    return out.select("event_id", "props", "bad_doc")


@plan("stringify", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, CAST(user_id AS VARCHAR) AS user_id,
  event_type, CAST(value AS VARCHAR) AS value, CAST(to_json(from_json(props, '"MAP(VARCHAR, JSON)"')) AS VARCHAR) AS props
FROM events""")
def q_stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column as a string, the parsed properties as JSON."""
    e = fx.base(spark, sf_dir, "events").withColumn("props", F.from_json("props", "map<string,variant>"))
    return stringify(e)


def _broken_events(spark, sf_dir) -> DataFrame:
    e = fx.base(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error",
                                       F.expr("substr(props, 1, length(props) - 1)"))
                    .otherwise(F.col("props")).alias("doc"))


@plan("read_docs", f"""
SELECT event_id, CASE WHEN json_valid(doc) THEN TRY_CAST(json_extract(doc, '$.k') AS BIGINT) END AS k,
  CASE WHEN json_valid(doc) THEN 'good' ELSE 'bad' END AS status,
  CASE WHEN json_valid(doc) THEN NULL ELSE doc END AS raw
FROM (SELECT event_id, {_BROKEN} AS doc FROM events)""")
def q_read_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parsed to a typed struct; broken ones set aside whole."""
    parsed = D.parse_docs(_broken_events(spark, sf_dir), "doc", "k long", corrupt_col="raw")
    bad = F.col("raw").isNotNull()
    return parsed.select("event_id", F.col("doc.k").alias("k"),
                         F.when(bad, "bad").otherwise("good").alias("status"),
                         "raw")


@plan("read_doc_files", f"""
SELECT CASE WHEN json_valid(doc) THEN TRY_CAST(json_extract(doc, '$.k') AS BIGINT) END AS k,
  CASE WHEN NOT json_valid(doc) THEN doc END AS line
FROM (SELECT {_BROKEN} AS doc FROM events)""")
def q_read_doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 over files: JSON lines written and read back, lines that do not parse
    set aside whole.  (The folder stays: the result reads it.)"""
    path = work_dir(spark, "read_doc_files")
    _broken_events(spark, sf_dir).select("doc").write.text(path)
    good, bad = D.read_doc_files(spark, path, "k long", corrupt_col="line")
    none = F.lit(None)
    return good.select(F.col("doc.k").alias("k"), none.cast("string").alias("line")).unionByName(
        bad.select(none.cast("long").alias("k"), "line"))


@plan("filter_ids", fx.with_fixtures("""
SELECT doc_id, json_extract_string(doc, '$.settings.name') AS name FROM config_docs
WHERE CAST(doc_id AS VARCHAR) IN (SELECT old_id FROM id_map)""", "config_docs", "id_map"))
def q_filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is in a list of ids (here: the old ids
    that have a mapping)."""
    docs = _settings(spark, sf_dir).select("doc_id", F.col("settings.name").alias("name"))
    return D.filter_ids(docs, "doc_id", fx.id_map(spark, sf_dir), id_col="old_id")


ID_LIST = " 7, 42 ,,9,not-an-id, 100,100"


@plan("filter_id_list", fx.with_fixtures("""
SELECT doc_id, json_extract_string(doc, '$.settings.name') AS name FROM config_docs
WHERE CAST(doc_id AS VARCHAR) IN (SELECT trim(x) FROM (SELECT unnest(string_split('""" + ID_LIST + """', ',')) AS x))""", "config_docs"))
def q_filter_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 as a user types it: a comma-separated string with blanks and a
    value that is no id."""
    docs = _settings(spark, sf_dir).select("doc_id", F.col("settings.name").alias("name"))
    return D.filter_ids(docs, "doc_id", ID_LIST)


# ---- policy definitions ------------------------------------------------

def _policy_docs(spark, sf_dir) -> DataFrame:
    e = fx.base(spark, sf_dir, "events")
    definition = F.concat(
        F.lit('{"spark_conf.spark.databricks.repl.allowedLanguages":{"type":"fixed","value":"python,sql"},'
              '"autotermination_minutes":{"type":"range","maxValue":'), F.col("user_id").cast("string"),
        F.lit('},"init_scripts.0.workspace.destination":{"type":"fixed","value":"/w/'), F.col("event_type"),
        F.lit('.sh"},"custom_tags.team":{"type":"fixed","value":"'), F.col("event_type"), F.lit('"}}'))
    cut = F.when(F.col("event_type") == "error", F.expr("substr(definition, 2, length(definition))")).otherwise(F.col("definition"))
    return e.select("event_id", "event_type", definition.alias("definition")).select(
        F.col("event_id").cast("string").alias("policy_id"),
        F.concat(F.lit("policy-"), F.col("event_id").cast("string")).alias("name"), cut.alias("definition"))


_POLICY_DUCK = """concat('{"spark_conf.spark.databricks.repl.allowedLanguages":{"type":"fixed","value":"python,sql"},"autotermination_minutes":{"type":"range","maxValue":',
  CAST(user_id AS VARCHAR), '},"init_scripts.0.workspace.destination":{"type":"fixed","value":"/w/', event_type,
  '.sh"},"custom_tags.team":{"type":"fixed","value":"', event_type, '"}}')"""


@plan("policy_rewrite", f"""
SELECT CAST(event_id AS VARCHAR) AS policy_id, concat('policy-', CAST(event_id AS VARCHAR), '-uc') AS name,
  CASE WHEN event_type = 'error' THEN NULL ELSE
  CAST(to_json(map_from_entries(list_transform(list_filter(map_entries(from_json(d, '"MAP(VARCHAR, JSON)"')),
    lambda e: e.key NOT IN ({", ".join(f"'{k}'" for k in D.LEGACY_POLICY_KEYS)})),
    lambda e: {{'key': e.key, 'value': CASE WHEN json_type(e.value) = 'OBJECT'
      THEN to_json(map_from_entries(list_sort(map_entries(from_json(e.value, '"MAP(VARCHAR, JSON)"'))))) ELSE e.value END}}))) AS VARCHAR) END AS definition,
  CASE WHEN event_type = 'error' THEN substr(d, 2) END AS bad_doc
FROM (SELECT *, {_POLICY_DUCK} AS d FROM events)""")
def q_policy_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy definitions (JSON in a string column) without the
    legacy keys, names suffixed; nested values stay objects (written with
    their keys in sorted order, the canonical form of a variant value).
    Definitions that do not parse are set aside whole."""
    p = D.rewrite_policy_definition(_policy_docs(spark, sf_dir))
    return p.select("policy_id", D.with_suffix(F.col("name"), D.POLICY_SUFFIX).alias("name"), "definition", "bad_doc")


# ---- access lists ------------------------------------------------------

_ACL_DUCK = """
acl AS (SELECT object_id, generate_subscripts(from_json(doc, '{"access_control_list":["JSON"]}').access_control_list, 1) AS i, unnest(from_json(doc, '{"access_control_list":[{"group_name":"VARCHAR","user_name":"VARCHAR","service_principal_name":"VARCHAR","all_permissions":[{"permission_level":"VARCHAR","inherited":"BOOLEAN"}]}]}').access_control_list) AS e FROM acl_docs),
perm AS (SELECT object_id, i, e, generate_subscripts(e.all_permissions, 1) AS j, unnest(e.all_permissions) AS p FROM acl),
flat AS (
  SELECT object_id, i, j, 'group_name' AS principal_type, e.group_name AS principal, p.permission_level FROM perm
    WHERE e.group_name IS NOT NULL AND p.permission_level IS NOT NULL AND p.inherited = false
  UNION ALL SELECT object_id, i, j, 'user_name', e.user_name, p.permission_level FROM perm
    WHERE e.user_name IS NOT NULL AND p.permission_level IS NOT NULL AND p.inherited = false
  UNION ALL SELECT object_id, i, j, 'service_principal_name', e.service_principal_name, p.permission_level FROM perm
    WHERE e.service_principal_name IS NOT NULL AND p.permission_level IS NOT NULL AND p.inherited = false),
full_acl AS (
  SELECT a.object_id, f.principal_type, f.principal, f.permission_level
  FROM acl_docs a LEFT JOIN flat f ON a.object_id = f.object_id)
"""


def _acl_sql(select: str) -> str:
    sql = fx.with_fixtures("SELECT 1", "acl_docs", "id_map")
    head = sql[: sql.rindex("SELECT 1")].rstrip()
    return f"{head},\n{_ACL_DUCK.strip()}\n{select.strip()}"


def _flat_acl(spark, sf_dir) -> DataFrame:
    a = parse_json(fx.acl_docs(spark, sf_dir), "doc", D.ACL_DOC_DDL, "d", keep=("object_id",))
    entries = D.principal_rows(D.flatten_acl(F.col("d.access_control_list")))
    return a.select("object_id", F.explode_outer(entries).alias("e")).select(
        "object_id", "e.principal_type", "e.principal", "e.permission_level")


@plan("flatten_acl", _acl_sql("SELECT * FROM full_acl"))
def q_flatten_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct permissions per principal; objects whose list ends
    empty stay (with NULL principal)."""
    return _flat_acl(spark, sf_dir)


@plan("remap_ids", _acl_sql("""
SELECT f.object_id, m.new_id, f.principal_type, f.principal, f.permission_level
FROM full_acl f JOIN id_map m ON f.object_id = m.old_id"""))
def q_remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened permissions moved to the new object ids; the ids are
    joined before the documents are parsed."""
    docs = D.remap_ids(fx.acl_docs(spark, sf_dir), fx.id_map(spark, sf_dir), "object_id")
    a = parse_json(docs, "doc", D.ACL_DOC_DDL, "d", keep=("object_id", "new_id"))
    entries = D.principal_rows(D.flatten_acl(F.col("d.access_control_list")))
    return a.select("object_id", "new_id", F.explode_outer(entries).alias("e")).select(
        "object_id", "new_id", "e.principal_type", "e.principal", "e.permission_level")


@plan("acl_by_object", _acl_sql("""
SELECT a.object_id, m.new_id, concat('[', coalesce(string_agg(concat('{"', f.principal_type, '":"', f.principal,
  '","permission_level":"', f.permission_level, '"}'), ',' ORDER BY f.i, f.j) FILTER (WHERE f.principal IS NOT NULL), ''), ']') AS access_control_list
FROM acl_docs a JOIN id_map m ON a.object_id = m.old_id LEFT JOIN flat f ON a.object_id = f.object_id
WHERE json_extract(a.doc, '$.access_control_list') IS NOT NULL GROUP BY a.object_id, m.new_id"""))
def q_acl_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access list of every object under its new id, as one JSON list;
    objects without a list are left out, an empty list stays."""
    d = D.acl_by_object(fx.acl_docs(spark, sf_dir), fx.id_map(spark, sf_dir))
    return d.select("object_id", "new_id", F.to_json("access_control_list").alias("access_control_list"))


# ---- cluster libraries -------------------------------------------------

def _library_docs(spark, sf_dir) -> DataFrame:
    e = fx.base(spark, sf_dir, "events")
    doc = F.concat(
        F.lit('{"cluster_id":"'), F.col("event_id").cast("string"),
        F.lit('","library_statuses":[{"library":{"jar":"dbfs:/FileStore/jars/'), F.col("event_type"),
        F.lit("/"), F.col("user_id").cast("string"),
        F.lit('.jar"}},{"library":{"pypi":{"package":"pkg'), F.col("user_id").cast("string"),
        F.lit('"}}},{"status":"PENDING"}]}'))
    return e.select(doc.alias("doc"))


_LIB_DUCK = """from_json(concat('{"cluster_id":"', CAST(event_id AS VARCHAR), '","library_statuses":[{"library":{"jar":"dbfs:/FileStore/jars/',
  event_type, '/', CAST(user_id AS VARCHAR), '.jar"}},{"library":{"pypi":{"package":"pkg', CAST(user_id AS VARCHAR),
  '"}}},{"status":"PENDING"}]}'), '{"cluster_id":"VARCHAR","library_statuses":[{"library":{"jar":"VARCHAR","pypi":{"package":"VARCHAR"}}}]}')"""


@plan("rebase_jars", f"""
SELECT d.cluster_id,
  array_to_string(list_transform(list_filter(d.library_statuses, lambda x: x.library IS NOT NULL),
    lambda x: CASE WHEN x.library.jar IS NOT NULL
      THEN concat('{VOLUME}/', regexp_extract(x.library.jar, '[^/]*$', 0)) ELSE x.library.pypi.package END), ',') AS libraries,
  array_to_string(list_transform(list_filter(d.library_statuses, lambda x: x.library IS NOT NULL),
    lambda x: CASE WHEN x.library.jar IS NOT NULL THEN 'jar' ELSE 'pypi' END), ',') AS kinds
FROM (SELECT {_LIB_DUCK} AS d FROM events)""")
def q_rebase_jars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster libraries: jars moved to the volume path (file name
    kept), other kinds kept, entries without a library dropped."""
    d = parse_json(_library_docs(spark, sf_dir), "doc", D.LIBRARY_DOC_DDL, "d")
    libs = D.rebase_jars(F.col("d.library_statuses"), VOLUME)
    name = F.transform(libs, lambda x: F.coalesce(x["jar"], x["whl"], x["pypi"]["package"],
                                                  x["maven"]["coordinates"]))
    kind = F.transform(libs, lambda x: F.when(x["jar"].isNotNull(), "jar").when(x["whl"].isNotNull(), "whl")
                       .when(x["pypi"].isNotNull(), "pypi").otherwise("maven"))
    return d.select(F.col("d.cluster_id").alias("cluster_id"), F.array_join(name, ",").alias("libraries"),
                    F.array_join(kind, ",").alias("kinds"))
