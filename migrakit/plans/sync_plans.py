"""Plans of the schema-sync family and the describe pivot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import quote_ident
from ..operators.projections import attributes_wide
from ..operators.sync import SYNC_COLUMNS, apply_sync, column_changes, plan_sync, sync_report, views_of, with_column_changes
from ..operators.verify import verify_counts
from ..session import drop_database, remove_dir, work_dir
from ..sources import fixtures as fx
from ..sources.tables import TableRef, count_tables, records
from .copy_check import DATABASE, _counts_sql, source_refs
from .registry import plan

DESCRIBE_KEYS = ("Provider", "Type", "Location", "Owner")

SYNC_SQL = """
sync AS (
SELECT coalesce(s.database, d.database) AS source_schema, coalesce(s.table_name, d.table_name) AS source_name,
  s.table_type AS source_type, s.provider AS source_provider, d.provider AS target_provider, s.location,
  CASE WHEN s.table_name IS NULL THEN 'ORPHAN'
       WHEN s.table_type = 'VIEW' THEN 'VIEWS_NOT_SUPPORTED'
       WHEN coalesce(s.is_temporary, false) THEN 'UNSUPPORTED'
       WHEN d.table_name IS NOT NULL AND s.provider IS NOT DISTINCT FROM d.provider THEN 'EXISTS'
       WHEN d.table_name IS NOT NULL THEN 'CHANGED'
       WHEN coalesce(NOT (NOT starts_with(s.location, 's3') OR s.provider = 'hive'), false) THEN 'TO_CREATE'
       ELSE 'UNSUPPORTED' END AS status_code
FROM inventory s FULL OUTER JOIN target_inventory d ON s.database = d.database AND s.table_name = d.table_name)
"""


def _with_sync(select: str) -> str:
    sql = fx.with_fixtures("SELECT 1", "inventory", "target_inventory")
    head = sql[: sql.rindex("SELECT 1")].rstrip()
    return f"{head},\n{SYNC_SQL.strip()}\n{select.strip()}"


def _sync(spark, sf_dir):
    return plan_sync(fx.inventory(spark, sf_dir), fx.target_inventory(spark, sf_dir))


@plan("sync_plan", _with_sync("SELECT * FROM sync"))
def q_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry run of a sync of the inventory against the target."""
    return _sync(spark, sf_dir)


@plan("sync_report", _with_sync("""
SELECT 'status_code' AS dimension, status_code AS value, count(*) AS n FROM sync GROUP BY status_code
UNION ALL SELECT 'source_type' AS dimension, source_type AS value, count(*) AS n FROM sync GROUP BY source_type
"""))
def q_sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per status code and per source type, one pass."""
    return sync_report(_sync(spark, sf_dir))


# Four columns of every table on either side, in SQL that both engines read: at the target some are missing, have
# another type or another rule for NULL, stand elsewhere, or are new.
_TABLE = "concat('db', CAST(o_custkey % 10 AS STRING)) AS database, concat('t', CAST(o_orderkey AS STRING)) AS table_name"
_TYPE = "CASE (o_orderkey + i) % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' ELSE 'double' END"
_SRC_COLUMNS = f"SELECT {_TABLE}, i AS ordinal, concat('c', CAST(i AS STRING)) AS column_name, {_TYPE} AS data_type, i > 0 AS nullable FROM o4"
_DST_COLUMNS = f"""SELECT {_TABLE}, CASE WHEN o_orderkey % 15 = 4 THEN 3 - i ELSE i END AS ordinal,
  concat(CASE WHEN o_orderkey % 9 = 2 THEN 'C' ELSE 'c' END, CAST(i AS STRING)) AS column_name,
  CASE WHEN (o_orderkey + i) % 10 = 3 THEN 'decimal(10,2)' ELSE {_TYPE} END AS data_type, (i > 0) <> ((o_orderkey + i) % 8 = 5) AS nullable
  FROM o4 WHERE o_orderkey % 6 <> 0 AND (o_orderkey + i) % 11 <> 1
UNION ALL SELECT {_TABLE}, 9 AS ordinal, 'extra' AS column_name, 'int' AS data_type, true AS nullable FROM o4 WHERE i = 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 7 = 3"""
_O4 = "SELECT o_orderkey, o_custkey, i FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i)"
_COLUMNS_SQL = f"""o4 AS ({_O4}),
sc AS ({_SRC_COLUMNS}),
dc AS ({_DST_COLUMNS}),
both_cols AS (SELECT s.database, s.table_name, s.column_name, row_number() OVER (PARTITION BY s.database, s.table_name ORDER BY s.ordinal) AS ps,
  row_number() OVER (PARTITION BY s.database, s.table_name ORDER BY d.ordinal) AS pd
  FROM sc s JOIN dc d ON s.database = d.database AND s.table_name = d.table_name AND s.column_name = lower(d.column_name)),
changes AS (SELECT * FROM (
  SELECT coalesce(s.database, d.database) AS source_schema, coalesce(s.table_name, d.table_name) AS source_name,
    coalesce(s.column_name, d.column_name) AS column_name, s.data_type AS source_type, d.data_type AS target_type,
    CASE WHEN d.column_name IS NULL THEN 'ADDED' WHEN s.column_name IS NULL THEN 'DROPPED' WHEN s.data_type <> d.data_type THEN 'RETYPED'
         WHEN s.nullable <> d.nullable THEN 'NULLABILITY' WHEN b.ps <> b.pd THEN 'REORDERED' END AS change
  FROM sc s FULL OUTER JOIN dc d ON s.database = d.database AND s.table_name = d.table_name AND s.column_name = lower(d.column_name)
  LEFT JOIN both_cols b ON b.database = s.database AND b.table_name = s.table_name AND b.column_name = s.column_name)
  WHERE change IS NOT NULL AND (source_schema, source_name) IN (SELECT (database, table_name) FROM dc))"""


def _column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o4 = fx.base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    sides = [spark.sql(sql.replace("FROM o4", "FROM {o4}"), o4=o4) for sql in (_SRC_COLUMNS, _DST_COLUMNS)]
    return column_changes(*sides)


@plan("column_changes", f"WITH {_COLUMNS_SQL}\nSELECT * FROM changes")
def q_column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3/Y1 by column: added, dropped, retyped, of another rule for NULL, or moved."""
    return _column_changes(spark, sf_dir)


_AT = ("CASE WHEN o_orderkey % 14 = 8 THEN concat('s3://other/', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 4 = 0 "
       "THEN concat('s3://b/', CAST(o_orderkey AS STRING), '/') WHEN o_orderkey % 4 = 1 THEN concat('dbfs:/m/', CAST(o_orderkey AS STRING)) END")


@plan("sync_drift", _with_sync(f"""SELECT 1""").rsplit("SELECT 1", 1)[0].rstrip() + f""",
{_COLUMNS_SQL},
elsewhere AS (SELECT {_TABLE}, {_AT} AS at FROM orders),
n AS (SELECT source_schema, source_name, count(*) AS n_changed, string_agg(DISTINCT change, ',' ORDER BY change) AS changes FROM changes GROUP BY ALL)
SELECT y.source_schema, y.source_name, y.source_type, y.source_provider, y.target_provider, y.location,
  coalesce(n_changed, 0) AS n_changed, coalesce(changes, '') AS changes,
  CASE WHEN status_code = 'EXISTS' AND y.location <> '' AND rtrim(e.at, '/') <> y.location THEN 'MOVED'
       WHEN status_code = 'EXISTS' AND n_changed > 0 THEN 'COLUMNS_CHANGED' ELSE status_code END AS status_code
FROM sync y LEFT JOIN elsewhere e ON e.database = y.source_schema AND e.table_name = y.source_name
LEFT JOIN n ON n.source_schema = y.source_schema AND n.source_name = y.source_name""")
def q_sync_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync plan that tells tables over other files and tables whose
    columns have changed from those that are the same."""
    dst = fx.target_inventory(spark, sf_dir)
    at = fx.base(spark, sf_dir, "orders").select(F.expr(_TABLE.split(", concat")[0].split(" AS database")[0]).alias("database"),
                                                 F.expr("concat('t', CAST(o_orderkey AS STRING))").alias("table_name"),
                                                 F.expr(_AT).alias("location"))
    dst = dst.join(at, ["database", "table_name"], "left")
    return with_column_changes(plan_sync(fx.inventory(spark, sf_dir), dst), _column_changes(spark, sf_dir))


@plan("sync_views", _with_sync("SELECT * FROM sync WHERE status_code = 'VIEWS_NOT_SUPPORTED'"))
def q_sync_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views a sync leaves for the view rewrite."""
    return views_of(_sync(spark, sf_dir))


@plan("attributes_wide", fx.with_fixtures(
    "SELECT entity, " + ", ".join(
        f"coalesce(max_by(val, ordinal) FILTER (WHERE attr = '{k}'), '') AS {k}" for k in DESCRIBE_KEYS)
    + " FROM describe_long GROUP BY entity", "describe_long"))
def q_attributes_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Describe rows to one row per table, last value wins."""
    return attributes_wide(fx.describe_long(spark, sf_dir), DESCRIBE_KEYS)


@plan("sync_apply", _counts_sql("count(*) AS source_count, count(*) AS target_count, 'match' AS verdict"))
def q_sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: sync the 14 tables into a fresh database by registering external
    tables over their files (no data copied), then count both sides through
    the catalog and compare."""
    refs = source_refs(sf_dir)
    src_inv = records(spark, 
        [(r.database, r.table, r.provider, r.location, "TABLE", False) for r in refs],
        "database string, table_name string, provider string, location string, "
        "table_type string, is_temporary boolean")
    target_db = "mk_sync_" + uuid.uuid4().hex[:10]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote_ident(target_db)} "
              f"LOCATION '{work_dir(spark, 'sync_apply', target_db, fresh=False)}'")
    dst_inv = spark.sql(f"SHOW TABLES IN {quote_ident(target_db)}").select(
        F.lit(DATABASE).alias("database"), F.col("tableName").alias("table_name"),
        F.lit(None).cast("string").alias("provider"))
    # Everything under the data folder counts as external storage here.
    sync = plan_sync(src_inv, dst_inv, prefix=sf_dir.rstrip("/").rsplit("/", 1)[0])
    outcomes = apply_sync(spark, sync, target_db)
    created = [r["source_name"] for r in outcomes.where("status = 'success'").collect()]
    dst_refs = [TableRef(DATABASE, t, name=f"{quote_ident(target_db)}.{quote_ident(t)}") for t in created]
    verdicts = verify_counts(count_tables(spark, refs), count_tables(spark, dst_refs))     # counts are here: local rows
    drop_database(spark, target_db)
    return verdicts


@plan("sync_apply_copy", """
SELECT s AS source_schema, t AS source_name, 'success' AS status, n AS target_rows FROM (
  SELECT 'a' AS s, 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'a', 'events', count(*) FROM events
  UNION ALL SELECT 'b', 'nation', count(*) FROM supplier UNION ALL SELECT 'b', 'orders', count(*) FROM orders)
UNION ALL SELECT 'c', 'orders', 'failed', NULL UNION ALL SELECT 'd', 'orders', 'failed', NULL""")
def q_sync_apply_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2 by copy: two schemas hold a table of the same name (with other rows),
    each schema has a target database of its own; two more schemas share one
    target database and a table name, and are refused.  Checked by the rows
    that the targets hold."""
    tag = uuid.uuid4().hex[:10]
    base = work_dir(spark, "sync_copy", tag, fresh=False)
    targets = {"a": f"mk_a_{tag}", "b": f"mk_b_{tag}", "c": f"mk_c_{tag}", "d": f"mk_c_{tag}"}
    for db in sorted(set(targets.values())):
        spark.sql(f"CREATE DATABASE {quote_ident(db)} LOCATION '{base}/{db}.db'")
    data = sf_dir.rstrip("/")
    rows = [(s, t, "TABLE", "parquet", None, f"{data}/{f}.parquet", "TO_CREATE") for s, t, f in (
        ("a", "nation", "nation"), ("a", "events", "events"), ("b", "nation", "supplier"), ("b", "orders", "orders"),
        ("c", "orders", "orders"), ("d", "orders", "orders"))]
    sync = records(spark, rows, ", ".join(f"{c} string" for c in SYNC_COLUMNS))
    out = apply_sync(spark, sync, targets, mode="copy", base=f"{base}/copies").collect()
    done = [r for r in out if r["status"] == "success"]
    counts = count_tables(spark, [TableRef(r["source_schema"], r["source_name"], name=r["target_name"]) for r in done])
    got = records(spark, [(r["source_schema"], r["source_name"], r["status"]) for r in out],
                  "source_schema string, source_name string, status string")
    counts = counts.withColumnsRenamed({"database": "source_schema", "table_name": "source_name", "n": "target_rows"})
    for db in sorted(set(targets.values())):
        drop_database(spark, db)
    remove_dir(spark, base)
    return got.join(counts, ["source_schema", "source_name"], "left")


_REPEATED = """
SELECT database, table_name, provider, location, table_type, is_temporary FROM inventory
UNION ALL SELECT database, table_name, provider, location, table_type, is_temporary FROM inventory
  WHERE table_name LIKE '%7'
UNION ALL SELECT database, table_name, 'orc' AS provider, location, table_type, is_temporary FROM inventory
  WHERE table_name LIKE '%3'"""


def _with_repeated(select: str) -> str:
    sql = fx.with_fixtures("SELECT 1", "inventory", "target_inventory")
    head = sql[: sql.rindex("SELECT 1")].rstrip()
    return (f"{head},\nonce AS (SELECT DISTINCT * FROM ({_REPEATED})),\n"
            f"s AS (SELECT *, count(*) OVER (PARTITION BY database, table_name) AS n FROM once)\n{select.strip()}")


@plan("sync_duplicates", _with_repeated("""
SELECT database AS source_schema, table_name AS source_name, table_type AS source_type, provider AS source_provider,
  NULL AS target_provider, location, 'DUPLICATE' AS status_code FROM s WHERE n > 1
UNION ALL
SELECT d.database, d.table_name, NULL, NULL, d.provider, NULL, 'DUPLICATE' FROM target_inventory d
  WHERE (d.database, d.table_name) IN (SELECT (database, table_name) FROM s WHERE n > 1)"""))
def q_sync_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3/Y1 on an inventory that lists some tables twice, equal or with another
    provider: equal rows are one, differing ones are told, none is lost."""
    inv = fx.inventory(spark, sf_dir)
    src = inv.unionByName(inv.where(F.col("table_name").endswith("7"))).unionByName(
        inv.where(F.col("table_name").endswith("3")).withColumn("provider", F.lit("orc")))
    s = plan_sync(src, fx.target_inventory(spark, sf_dir))
    return s.where("status_code = 'DUPLICATE'")
