"""Nested-document operators (D1-D14, S4, S5, J2, A7): rewrites of a table of
configuration documents (cluster, job and policy definitions, access lists)
as column expressions.  Every rule is a per-row JVM expression over typed
structs, maps and arrays, so a table of any size is rewritten in one narrow
stage: no shuffle, no UDF, no document on the driver.

A typed struct holds the declared fields only.  These forms answer questions
about single fields; ``whole_docs`` has the same rules for documents that are
written back with every other key kept."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.maps import drop_keys, repeats_keys, set_key
from ..functions.parallel import parse_json
from ..functions.strings import basename, is_blank, join_path
from ..functions.versions import floor_version, is_ml
from ..sources.tables import records

# Cluster configuration keys that do not apply on the new catalog.
LEGACY_CONF_KEYS = (
    "spark.databricks.repl.allowedLanguages",
    "spark.databricks.acl.dfAclsEnabled",
    "spark.databricks.pyspark.enablePy4JSecurity",
)
# Cluster policy definition keys that are removed.
LEGACY_POLICY_KEYS = (
    "spark_conf.spark.databricks.repl.allowedLanguages",
    "spark.databricks.pyspark.enablePy4JSecurity",
    "spark.databricks.acl.dfAclsEnabled",
    "init_scripts.0.workspace.destination",
)
# The configuration key of the default catalog.
DEFAULT_CATALOG_KEY = "spark.databricks.sql.initial.catalog.name"
# Volume fields whose presence makes ``disk_spec`` redundant.
EBS_FIELDS = ("ebs_volume_count", "ebs_volume_type", "ebs_volume_size")
# Security modes and the suffixes of copied definitions.
SINGLE_USER = "SINGLE_USER"
USER_ISOLATION = "USER_ISOLATION"
CLUSTER_SUFFIX = "-UC"
POLICY_SUFFIX = "-uc"

# Longest id list that travels in the plan as a literal.
LITERAL_IDS = 1000

_DEST = "struct<destination:string>"
INIT_SCRIPT_DDL = f"struct<workspace:{_DEST},volumes:{_DEST},s3:{_DEST},dbfs:{_DEST}>"
CLUSTER_DDL = (
    "cluster_id:string,cluster_name:string,name:string,spark_version:string,"
    "data_security_mode:string,single_user_name:string,policy_id:string,disk_spec:string,"
    "aws_attributes:struct<ebs_volume_count:string,ebs_volume_type:string,ebs_volume_size:string>,"
    f"spark_conf:map<string,string>,init_scripts:array<{INIT_SCRIPT_DDL}>")
JOB_SETTINGS_DDL = (
    f"{CLUSTER_DDL},schedule:struct<pause_status:string>,continuous:struct<pause_status:string>,"
    f"job_clusters:array<struct<job_cluster_key:string,new_cluster:struct<{CLUSTER_DDL}>>>,"
    f"tasks:array<struct<task_key:string,existing_cluster_id:string,new_cluster:struct<{CLUSTER_DDL}>>>")
JOB_DOC_DDL = f"job_id string, run_as_user_name string, settings struct<{JOB_SETTINGS_DDL}>"
ACL_DOC_DDL = ("object_id string, access_control_list array<struct<group_name:string,user_name:string,"
               "service_principal_name:string,all_permissions:array<struct<permission_level:string,"
               "inherited:boolean>>>>")
_PERMISSIONS = "array<struct<permission_level:string,inherited:boolean>>"
LIBRARY_DOC_DDL = "cluster_id string, library_statuses array<struct<library:struct<jar:string,whl:string,pypi:struct<package:string>,maven:struct<coordinates:string>>>>"


# ---------------------------------------------------------------- sources

def parse_docs(df: DataFrame, col: str, schema: str | StructType,
               corrupt_col: str = "_corrupt_record") -> DataFrame:
    """S4 in one pass: ``col`` parsed to a typed struct (NULL for a document
    that does not parse) and ``corrupt_col`` holding the raw text of such a
    document (NULL otherwise).  Callers that need both parts read this once."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    st = StructType(st.fields + [StructField(corrupt_col, StringType(), True)])
    parsed = parse_json(df, col, st, "_doc", keep=tuple(df.columns),
                        options={"columnNameOfCorruptRecord": corrupt_col})
    bad = F.col(col).isNotNull() & F.col(f"_doc.{corrupt_col}").isNotNull()
    return parsed.select(
        *[c for c in df.columns if c != col],
        F.when(~bad, F.col("_doc").dropFields(corrupt_col)).alias(col),
        F.when(bad, F.col(f"_doc.{corrupt_col}")).alias(corrupt_col))


def read_docs(df: DataFrame, col: str, schema: str | StructType,
              corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """Parse one JSON document per row into a typed struct column.

    Returns (good, bad): good rows carry the struct in ``col``; bad rows keep
    the raw text in ``corrupt_col`` (set aside, not lost).  Two filters of
    ``parse_docs``; to consume both parts in one pass use ``parse_docs``."""
    parsed = parse_docs(df, col, schema, corrupt_col)
    bad_cond = F.col(corrupt_col).isNotNull()
    return parsed.where(~bad_cond).drop(corrupt_col), parsed.where(bad_cond).drop(col)


def read_doc_files(spark, path: str, schema: str | StructType,
                   corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """S4 over files: JSON lines (saved service answers, exports), one
    document per line, parsed with a declared schema; lines that do not parse
    are set aside whole.  Returns (good, bad) as ``read_docs`` does, with the
    document in column ``doc`` (good) or the raw line in ``corrupt_col``
    (bad)."""
    lines = spark.read.text(path).withColumnRenamed("value", "doc")
    return read_docs(lines, "doc", schema, corrupt_col)


def filter_ids(df: DataFrame, key: str, ids: str | Sequence[str] | DataFrame,
               id_col: str = "id") -> DataFrame:
    """Keep the rows whose ``key`` is in ``ids``: a comma-separated
    string (entries trimmed, blanks ignored), a list, or a frame of ids.  Ids
    are cast to the key's type (one that is no such value matches nothing), so
    the key itself stays bare and the filter reaches the scan.  A list of up to
    ``LITERAL_IDS`` ids is a literal; a longer one, or a frame, is a left-semi
    join, planned by Spark (and AQE) on measured sizes."""
    kind = df.schema[key].dataType
    if isinstance(ids, DataFrame):
        # A semi join never repeats a left row, so the ids need no distinct.
        return df.join(ids.select(F.col(id_col).try_cast(kind).alias("_id")), F.col(key) == F.col("_id"), "left_semi")
    if isinstance(ids, str):
        ids = ids.split(",")
    wanted = sorted({str(i).strip() for i in ids if i is not None and str(i).strip()})
    if len(wanted) > LITERAL_IDS:
        frame = records(df.sparkSession, [(i,) for i in wanted], "id string")
        return filter_ids(df, key, frame)
    return df.where(F.col(key).isin([F.lit(i).try_cast(kind) for i in wanted]) if wanted else F.lit(False))


# ------------------------------------------------------------ cluster rules

def security_mode(version: Column, mode: Column) -> Column:
    """D4 for clusters: an ml runtime is single-user; otherwise a mode naming
    single user stays ``SINGLE_USER`` and every other becomes
    ``USER_ISOLATION``."""
    return (F.when(is_ml(version), F.lit(SINGLE_USER))
             .when(F.coalesce(mode.contains(SINGLE_USER), F.lit(False)), F.lit(SINGLE_USER))
             .otherwise(F.lit(USER_ISOLATION)))


def single_user(version: Column, current: Column, user: str | None) -> Column:
    """The named user is set on ml runtimes when one is given."""
    if is_blank(user):
        return current
    return F.when(is_ml(version), F.lit(user)).otherwise(current)


def rebase_init_scripts(scripts: Column, base: str) -> Column:
    """Workspace scripts move to ``base`` + file name (as volumes);
    volumes and s3 scripts are kept with their destination only; any other
    kind is dropped."""
    def one(x: Column) -> Column:
        ws, vol, s3 = x["workspace"], x["volumes"], x["s3"]
        new_vol = (F.when(ws.isNotNull(), F.struct(join_path(base, basename(ws["destination"]))
                                                     .alias("destination")))
                    .when(vol.isNotNull(), F.struct(vol["destination"].alias("destination"))))
        new_s3 = F.when(ws.isNull() & vol.isNull() & s3.isNotNull(),
                        F.struct(s3["destination"].alias("destination")))
        return (x.withField("workspace", F.lit(None).cast(_DEST))
                 .withField("dbfs", F.lit(None).cast(_DEST))
                 .withField("volumes", new_vol).withField("s3", new_s3))

    kept = F.filter(scripts, lambda x: x["workspace"].isNotNull() | x["volumes"].isNotNull()
                    | x["s3"].isNotNull())
    return F.transform(kept, one)


def rebase_jars(libraries: Column, base: str) -> Column:
    """D5 for libraries: a jar moves to ``base`` + file name; other library
    kinds are kept.  Elements without a library are dropped."""
    kept = F.filter(libraries, lambda x: x["library"].isNotNull())
    return F.transform(kept, lambda x: x["library"].withField(
        "jar", F.when(x["library"]["jar"].isNotNull(),
                      join_path(base, basename(x["library"]["jar"])))))


def ebs_volume_set(aws: Column) -> Column:
    cond = None
    for f in EBS_FIELDS:
        c = aws[f].isNotNull()
        cond = c if cond is None else cond | c
    return F.coalesce(cond, F.lit(False))


def drop_field_if(s: Column, field: str, cond: Column) -> Column:
    """``field`` of struct ``s`` becomes NULL (and leaves the JSON) where
    ``cond`` holds.  NULL keeps the struct's type in both branches."""
    return s.withField(field, F.when(~cond, s[field]))


def override(current: Column, value: str | None) -> Column:
    """Replace a field where it is present and ``value`` is not blank."""
    if is_blank(value):
        return current
    return F.when(current.isNotNull(), F.lit(value)).otherwise(current)


def with_suffix(name: Column, suffix: str) -> Column:
    """``name + suffix``, unless it already ends with it (idempotent)."""
    return F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))


@dataclass(frozen=True)
class ClusterParams:
    """Parameters of the cluster rewrite (blank = leave as it is)."""

    volume_path: str = "/Volumes/main/default/init"
    single_user: str | None = None
    policy_id: str | None = None
    catalog: str | None = None
    drop_conf_keys: tuple[str, ...] = LEGACY_CONF_KEYS
    suffix: str = CLUSTER_SUFFIX


def rewrite_cluster(c: Column, p: ClusterParams) -> Column:
    """All cluster rules on one cluster struct (D3, D4, D5, D1, D6, D9, D10),
    in the order the rules depend on each other: the version decides the
    mode and user, the user decides whether init scripts move."""
    version = floor_version(c["spark_version"])
    user = single_user(version, c["single_user_name"], p.single_user)
    scripts = F.when(user.isNull(), rebase_init_scripts(c["init_scripts"], p.volume_path)) \
               .otherwise(c["init_scripts"])
    conf = drop_keys(c["spark_conf"], p.drop_conf_keys)
    out = (c.withField("spark_version", version)
            .withField("single_user_name", user)
            .withField("data_security_mode", security_mode(version, c["data_security_mode"]))
            .withField("init_scripts", scripts)
            .withField("spark_conf", conf)
            .withField("policy_id", override(c["policy_id"], p.policy_id)))
    out = drop_field_if(out, "disk_spec", ebs_volume_set(c["aws_attributes"]))
    for f in ("cluster_name", "name"):
        out = out.withField(f, F.when(c[f].isNotNull(), with_suffix(c[f], p.suffix)))
    return out


def rewrite_job_cluster(c: Column, catalog: str | None = None,
                        drop_conf_keys: Sequence[str] = LEGACY_CONF_KEYS) -> Column:
    """Rules on the ``new_cluster`` of a job cluster or task: version floor,
    always single-user, legacy conf keys dropped, default catalog set inside
    the cluster's conf (created when missing), ``disk_spec`` dropped when
    volume fields are set."""
    conf = F.when(c["spark_conf"].isNotNull(), drop_keys(c["spark_conf"], drop_conf_keys))
    if not is_blank(catalog):
        conf = set_key(conf, DEFAULT_CATALOG_KEY, catalog)
    out = (c.withField("spark_version", floor_version(c["spark_version"]))
            .withField("data_security_mode", F.lit(SINGLE_USER))
            .withField("spark_conf", conf))
    return F.when(c.isNotNull(), drop_field_if(out, "disk_spec", ebs_volume_set(c["aws_attributes"])))


def each(arr: Column, field: str, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to ``field`` of every element of an array of structs."""
    return F.transform(arr, lambda x: x.withField(field, fn(x[field])))


# --------------------------------------------------------------- job rules

def set_pause(s: Column, status: str | None) -> Column:
    """Set ``pause_status`` where the struct has one; only the two known
    values act, anything else leaves it."""
    if status not in ("PAUSED", "UNPAUSED"):
        return s
    return F.when(s["pause_status"].isNotNull(), s.withField("pause_status", F.lit(status))).otherwise(s)


def tag_principal(name: Column, override_name: str | None = None) -> Column:
    """Run-as principal: the override, else the given name; with ``@`` it
    is a user, else a service principal.  NULL name -> NULL."""
    who = name if is_blank(override_name) else F.when(name.isNotNull(), F.lit(override_name))
    is_user = who.contains("@")
    return F.when(who.isNotNull(), F.struct(
        F.when(is_user, who).alias("user_name"),
        F.when(~is_user, who).alias("service_principal_name")))


@dataclass(frozen=True)
class JobParams:
    """Parameters of the job rewrite (blank = leave as it is)."""

    catalog: str | None = None
    pause_status: str | None = None
    run_as: str | None = None
    existing_cluster_id: str | None = None
    suffix: str = CLUSTER_SUFFIX


def rewrite_job(settings: Column, run_as_user_name: Column, p: JobParams) -> Column:
    """All job rules on one job's settings struct: name suffix (D9), pause
    status of schedule and continuous trigger (D7), run-as principal (D8,
    added as ``run_as``), the job-cluster rules on every ``job_clusters`` and
    ``tasks`` element (D14) and the existing-cluster override of tasks
    (D10)."""
    def task(t: Column) -> Column:
        return t.withField("new_cluster", rewrite_job_cluster(t["new_cluster"], p.catalog)) \
                .withField("existing_cluster_id", override(t["existing_cluster_id"], p.existing_cluster_id))

    return (settings
            .withField("name", F.when(settings["name"].isNotNull(), with_suffix(settings["name"], p.suffix)))
            .withField("schedule", set_pause(settings["schedule"], p.pause_status))
            .withField("continuous", set_pause(settings["continuous"], p.pause_status))
            .withField("job_clusters", each(settings["job_clusters"], "new_cluster",
                                            lambda c: rewrite_job_cluster(c, p.catalog)))
            .withField("tasks", F.transform(settings["tasks"], task))
            .withField("run_as", tag_principal(run_as_user_name, p.run_as)))


def promote(df: DataFrame, col: str) -> DataFrame:
    """The fields of struct ``col`` become top-level columns and ``col``
    goes; on a name clash the nested value wins."""
    inner = df.schema[col].dataType.fieldNames()
    keep = [c for c in df.columns if c != col and c not in inner]
    return df.select(*[F.col(f"`{c}`") for c in keep], f"{col}.*")


def edit_json(df: DataFrame, col: str, fn: Callable[[Column], Column],
              schema: str = "map<string,variant>", bad: str = "bad_doc") -> DataFrame:
    """Parse a JSON text column, edit it, write it back as JSON text.
    With the default ``map<string,variant>`` every value keeps its JSON type
    (numbers stay numbers, objects stay objects).  Text that does not parse is
    set aside: it goes to column ``bad`` as it is and ``col`` is NULL there, so it is
    neither lost nor replaced; so is a document that holds a key twice, at any
    depth (which value holds is not ours to choose).  A column that is already
    parsed is edited and written as it is."""
    if not isinstance(df.schema[col].dataType, StringType):
        return df.withColumn(col, F.to_json(fn(F.col(col)))).withColumn(bad, F.lit(None).cast("string"))
    keep = tuple(c for c in df.columns if c != col)
    parsed = parse_json(df, col, schema, "_doc", keep=tuple(df.columns))
    twice = F.coalesce(repeats_keys(F.col("_doc")), F.lit(False))
    broken = F.col(col).isNotNull() & (F.col("_doc").isNull() | twice)
    return parsed.select(*keep, F.when(~broken, F.to_json(fn(F.col("_doc")))).alias(col),
                         F.when(broken, F.col(col)).alias(bad))


def rewrite_policy_definition(df: DataFrame, col: str = "definition",
                              keys: Sequence[str] = LEGACY_POLICY_KEYS, bad: str = "bad_doc") -> DataFrame:
    """D12 + D1 as the policy rewrite: legacy keys out of the definition; a
    definition that does not parse is set aside in ``bad``."""
    return edit_json(df, col, lambda m: drop_keys(m, keys), bad=bad)


# --------------------------------------------------------------- ACL rules

def flatten_acl(acl: Column) -> Column:
    """The access list as (group_name | user_name |
    service_principal_name, permission_level) entries: one per entry, direct
    permission (``inherited`` present and false) and kind of principal the
    entry names.  An entry without ``all_permissions`` gives nothing and leaves
    the others alone.  An object whose list ends empty keeps ``[]``; one without
    a list keeps NULL.  Per-row higher-order functions: no explode, no regroup,
    no shuffle."""
    kinds = ("group_name", "user_name", "service_principal_name")

    def per_entry(e: Column) -> Column:
        direct = F.filter(F.coalesce(e["all_permissions"], F.array().cast(_PERMISSIONS)), lambda p: p["permission_level"].isNotNull()
                          & (p["inherited"] == F.lit(False)))

        def per_perm(p: Column) -> Column:
            items = []
            for k in kinds:
                fields = [(e[k] if k == kk else F.lit(None).cast("string")).alias(kk) for kk in kinds]
                items.append(F.when(e[k].isNotNull(), F.struct(
                    *fields, p["permission_level"].alias("permission_level"))))
            return F.array(*items)

        return F.flatten(F.transform(direct, per_perm))

    present = F.filter(acl, lambda e: e.isNotNull())
    return F.filter(F.flatten(F.transform(present, per_entry)), lambda x: x.isNotNull())


def acl_by_object(docs: DataFrame, mapping: DataFrame, key: str = "object_id", doc: str = "doc") -> DataFrame:
    """(key, new_id, access_control_list) per object that has an access list
    and a new id, the list flattened.  The ids are joined before anything is
    parsed; the list stays in its row."""
    moved = remap_ids(docs.select(key, doc), mapping, key)
    parsed = parse_json(moved, doc, ACL_DOC_DDL, "_d", keep=(key, "new_id"))
    return parsed.where(F.col("_d.access_control_list").isNotNull()).select(
        key, "new_id", flatten_acl(F.col("_d.access_control_list")).alias("access_control_list"))


def remap_ids(df: DataFrame, mapping: DataFrame, key: str, old: str = "old_id", new: str = "new_id",
              out: str = "new_id") -> DataFrame:
    """Old id -> new id by an inner join on the old id (an id without a
    new one is dropped).  Keyed by id, not by name, so equal names cannot
    overwrite each other."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias(out))
    return df.join(m, F.col(key) == F.col("_old"), "inner").drop("_old")


def principal_rows(entries: Column) -> Column:
    """A7 inverse, for reports: each entry as (principal_type, principal,
    permission_level)."""
    return F.transform(entries, lambda x: F.struct(
        F.when(x["group_name"].isNotNull(), "group_name")
         .when(x["user_name"].isNotNull(), "user_name")
         .otherwise("service_principal_name").alias("principal_type"),
        F.coalesce(x["group_name"], x["user_name"], x["service_principal_name"]).alias("principal"),
        x["permission_level"].alias("permission_level")))
