"""Relations with the shapes the migration tools read (inventory, counts,
grants, view texts, configuration and ACL documents), derived by Spark from
the driver's tables so that they grow with the scale factor.

Each function mirrors one statement of FIXTURES.md; ``FIXTURE_SQL`` holds the
same statements for the DuckDB oracle.  The one deliberate change: view texts
carry the whole document text, not its first 80 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ALL_TABLES = TPCH_TABLES + ("events", "documents", "embeddings", "pages", "benchmark", "labels",
                            "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _case(key: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr.otherwise(default) if default is not None else expr


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("db"), _s(F.col("o_custkey") % 10)).alias("database"),
        F.concat(F.lit("t"), _s(k)).alias("table_name"),
        _case(k % 5, {0: "parquet", 1: "delta", 2: "hive", 3: "csv"}).alias("provider"),
        _case(k % 4, {0: F.concat(F.lit("s3://b/"), _s(k)), 1: F.concat(F.lit("dbfs:/m/"), _s(k)),
                      2: F.lit("")}).alias("location"),
        F.when(k % 8 == 3, "VIEW").otherwise("TABLE").alias("table_type"),
        (k % 17 == 0).alias("is_temporary"),
    )


def target_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.where(k % 6 != 0).select(
        F.concat(F.lit("db"), _s(F.col("o_custkey") % 10)).alias("database"),
        F.concat(F.when(k % 29 == 0, "x").otherwise("t"), _s(k)).alias("table_name"),
        F.when(k % 9 == 0, "orc").otherwise(
            _case(k % 5, {0: "parquet", 1: "delta", 2: "hive", 3: "csv"})).alias("provider"),
    )


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("db"), _s(F.col("l_orderkey") % 10)).alias("database"),
        F.concat(F.lit("t"), _s("l_orderkey")).alias("table_name"), "n")


def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    g = li.where(k % 13 != 0).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    return g.select(
        F.concat(F.lit("db"), _s(k % 10)).alias("database"),
        F.concat(F.lit("t"), _s(k)).alias("table_name"),
        F.when(k % 11 == 0, F.lit(None).cast("long"))
         .when(k % 7 == 0, F.col("c") - 1).otherwise(F.col("c")).alias("n"))


def describe_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base(spark, sf_dir, "part")
    k = F.col("p_partkey")
    a = p.select(k.alias("entity"), F.lit(1).alias("ordinal"), F.lit("Provider").alias("attr"),
                 F.col("p_brand").alias("val"))
    b = p.where(k % 3 != 0).select(k.alias("entity"), F.lit(2).alias("ordinal"),
                                   F.lit("Type").alias("attr"), F.col("p_type").alias("val"))
    c = p.where(k % 10 == 0).select(k.alias("entity"), F.lit(3).alias("ordinal"),
                                    F.lit("Provider").alias("attr"), F.col("p_name").alias("val"))
    return a.unionByName(b).unionByName(c)


def view_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    k = F.col("doc_id")
    src = _case(k % 4, {0: "sales.t", 1: "`Sales`.t", 2: "old_catalog.sales.t"}, "presales.t")
    return d.select(
        F.concat(F.lit("db"), _s(k % 5)).alias("schema_name"),
        F.concat(F.lit("v"), _s(k)).alias("view_name"),
        F.concat(F.lit("SELECT '"), F.replace(F.col("text"), F.lit("'"), F.lit("")),
                 F.lit("' AS s FROM "), src, _s(k % 7),
                 F.lit(",hr.u h WHERE h.sales = 1")).alias("view_text"),
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grants_from(base(spark, sf_dir, "lineitem"))


def grants_from(li: DataFrame) -> DataFrame:
    """``grants`` over a given lineitem frame."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        # A few grants name no schema: they must not become grants on another object.
        F.when(o % 41 != 0, F.concat(F.lit("s"), _s(F.col("l_suppkey") % 10))).alias("schema_name"),
        F.concat(F.lit("t"), _s(p % 50)).alias("table_name"),
        F.when(o % 20 == 0, "users").when(o % 31 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("p"), _s(o % 100))).alias("principal"),
        _case(o % 4, {0: "CATALOG$", 1: "DATABASE", 2: "TABLE"}, "ANY_FILE").alias("object_type"),
        _case(p % 7, {0: "SELECT", 1: "MODIFY", 2: "READ_METADATA", 3: "OWN", 4: "CREATE",
                      5: "CREATE_NAMED_FUNCTION"}, "USAGE").alias("action_type"),
    )


def config_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")
    k = F.col("event_id")
    version = _case(k % 6, {0: "9.1.x-scala2.12", 1: "13.3.x-scala2.12",
                            2: "13.10.x-cpu-ml-scala2.12", 3: "custom:gpu-ml", 4: "custom:img"},
                    "nightly")
    doc = F.concat(
        F.lit('{"settings":{"name":"n'), _s(k), F.when(k % 6 == 0, "-v2").otherwise(""),
        F.lit('","spark_version":"'), version, F.lit('"'),
        F.when(k % 3 == 0, ',"data_security_mode":"LEGACY_SINGLE_USER"').otherwise(""),
        F.when(k % 4 == 0, ',"schedule":{"pause_status":"UNPAUSED"}').otherwise(""),
        F.when(k % 5 == 0, ',"disk_spec":"d","aws_attributes":{"ebs_volume_count":"1"}')
         .otherwise(',"disk_spec":"d"'),
        F.lit(',"spark_conf":{"acl":"true","'), F.col("event_type"), F.lit('":"'), _s("user_id"),
        F.lit('"},"init_scripts":[{"workspace":{"destination":"/w/a/'), _s("user_id"),
        F.lit('.sh"}},{"s3":{"destination":"s3://b/i.sh"}},{"dbfs":{"destination":"dbfs:/x"}}]},'
              '"run_as_user_name":"'),
        F.when(k % 2 == 0, "u@x.org").otherwise("sp-1"), F.lit('"}'))
    return e.select(k.alias("doc_id"), doc.alias("doc"))


# Access lists, in SQL that Spark and DuckDB both read: some objects have no
# list, an empty one, or an entry without permissions.
ACL_DOC = """CASE event_id % 8 WHEN 6 THEN '{}' WHEN 7 THEN '{"access_control_list":[]}' ELSE
  concat('{"access_control_list":[{"user_name":"u', CAST(user_id AS STRING), '","all_permissions":[{"permission_level":"CAN_RUN","inherited":', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END,
  '},{"permission_level":"CAN_VIEW"}]},', CASE WHEN event_id % 8 = 5 THEN '{"group_name":"bare"},' ELSE '' END, '{"group_name":"', event_type,
  '","all_permissions":[{"permission_level":"CAN_MANAGE","inherited":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}]}]}') END"""


def acl_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")
    return e.select(_s("event_id").alias("object_id"), F.expr(ACL_DOC).alias("doc"))


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.where(k % 7 != 0).select(_s(k).alias("old_id"), _s(k + 1000000).alias("new_id"))


# The same relations for the DuckDB oracle (FIXTURES.md section 2).
FIXTURE_SQL = {
    "inventory": """
SELECT concat('db', CAST(o_custkey % 10 AS VARCHAR)) AS database, concat('t', CAST(o_orderkey AS VARCHAR)) AS table_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'parquet' WHEN 1 THEN 'delta' WHEN 2 THEN 'hive' WHEN 3 THEN 'csv' END AS provider,
  CASE o_orderkey % 4 WHEN 0 THEN concat('s3://b/', CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN concat('dbfs:/m/', CAST(o_orderkey AS VARCHAR)) WHEN 2 THEN '' END AS location,
  CASE WHEN o_orderkey % 8 = 3 THEN 'VIEW' ELSE 'TABLE' END AS table_type, o_orderkey % 17 = 0 AS is_temporary
FROM orders""",
    "target_inventory": """
SELECT concat('db', CAST(o_custkey % 10 AS VARCHAR)) AS database,
  concat(CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE 't' END, CAST(o_orderkey AS VARCHAR)) AS table_name,
  CASE WHEN o_orderkey % 9 = 0 THEN 'orc' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'parquet' WHEN 1 THEN 'delta' WHEN 2 THEN 'hive' WHEN 3 THEN 'csv' END END AS provider
FROM orders WHERE o_orderkey % 6 <> 0""",
    "source_counts": """
SELECT concat('db', CAST(l_orderkey % 10 AS VARCHAR)) AS database, concat('t', CAST(l_orderkey AS VARCHAR)) AS table_name, count(*) AS n
FROM lineitem GROUP BY l_orderkey""",
    "target_counts": """
SELECT concat('db', CAST(l_orderkey % 10 AS VARCHAR)) AS database, concat('t', CAST(l_orderkey AS VARCHAR)) AS table_name,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN count(*) - 1 ELSE count(*) END AS n
FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY l_orderkey""",
    "describe_long": """
SELECT p_partkey AS entity, 1 AS ordinal, 'Provider' AS attr, p_brand AS val FROM part
UNION ALL SELECT p_partkey, 2, 'Type', p_type FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 3, 'Provider', p_name FROM part WHERE p_partkey % 10 = 0""",
    "view_texts": """
SELECT concat('db', CAST(doc_id % 5 AS VARCHAR)) AS schema_name, concat('v', CAST(doc_id AS VARCHAR)) AS view_name,
  concat('SELECT ''', replace(text, '''', ''), ''' AS s FROM ', CASE doc_id % 4 WHEN 0 THEN 'sales.t' WHEN 1 THEN '`Sales`.t' WHEN 2 THEN 'old_catalog.sales.t' ELSE 'presales.t' END, CAST(doc_id % 7 AS VARCHAR), ',hr.u h WHERE h.sales = 1') AS view_text
FROM documents""",
    "grants": """
SELECT CASE WHEN l_orderkey % 41 <> 0 THEN concat('s', CAST(l_suppkey % 10 AS VARCHAR)) END AS schema_name, concat('t', CAST(l_partkey % 50 AS VARCHAR)) AS table_name,
  CASE WHEN l_orderkey % 20 = 0 THEN 'users' WHEN l_orderkey % 31 = 0 THEN NULL ELSE concat('p', CAST(l_orderkey % 100 AS VARCHAR)) END AS principal,
  CASE l_orderkey % 4 WHEN 0 THEN 'CATALOG$' WHEN 1 THEN 'DATABASE' WHEN 2 THEN 'TABLE' ELSE 'ANY_FILE' END AS object_type,
  CASE l_partkey % 7 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'MODIFY' WHEN 2 THEN 'READ_METADATA' WHEN 3 THEN 'OWN' WHEN 4 THEN 'CREATE' WHEN 5 THEN 'CREATE_NAMED_FUNCTION' ELSE 'USAGE' END AS action_type
FROM lineitem""",
    "config_docs": """
SELECT event_id AS doc_id, concat('{"settings":{"name":"n', CAST(event_id AS VARCHAR), CASE WHEN event_id % 6 = 0 THEN '-v2' ELSE '' END,
  '","spark_version":"', CASE event_id % 6 WHEN 0 THEN '9.1.x-scala2.12' WHEN 1 THEN '13.3.x-scala2.12' WHEN 2 THEN '13.10.x-cpu-ml-scala2.12' WHEN 3 THEN 'custom:gpu-ml' WHEN 4 THEN 'custom:img' ELSE 'nightly' END,
  '"', CASE WHEN event_id % 3 = 0 THEN ',"data_security_mode":"LEGACY_SINGLE_USER"' ELSE '' END,
  CASE WHEN event_id % 4 = 0 THEN ',"schedule":{"pause_status":"UNPAUSED"}' ELSE '' END,
  CASE WHEN event_id % 5 = 0 THEN ',"disk_spec":"d","aws_attributes":{"ebs_volume_count":"1"}' ELSE ',"disk_spec":"d"' END,
  ',"spark_conf":{"acl":"true","', event_type, '":"', CAST(user_id AS VARCHAR), '"},"init_scripts":[{"workspace":{"destination":"/w/a/', CAST(user_id AS VARCHAR), '.sh"}},{"s3":{"destination":"s3://b/i.sh"}},{"dbfs":{"destination":"dbfs:/x"}}]},"run_as_user_name":"',
  CASE WHEN event_id % 2 = 0 THEN 'u@x.org' ELSE 'sp-1' END, '"}') AS doc
FROM events""",
    "acl_docs": f"SELECT CAST(event_id AS VARCHAR) AS object_id, {ACL_DOC} AS doc FROM events",
    "id_map": """
SELECT CAST(event_id AS VARCHAR) AS old_id, CAST(event_id + 1000000 AS VARCHAR) AS new_id FROM events WHERE event_id % 7 <> 0""",
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle statement with the fixture relations it reads."""
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names)
    return f"WITH {ctes}\n{sql.strip()}" if names else sql.strip()
