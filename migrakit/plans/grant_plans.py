"""Plans of the grants family over the grants and inventory relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grants import (dedup_grants, grant_changes, grants_by_principal, tables_by_schema, tables_of,
                                translate_privileges, with_usage)
from ..operators.projections import explode_list, with_list_size
from ..sources import fixtures as fx
from ..sources.tables import union_all
from .registry import plan

CATALOG = "main"


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c), ",").alias(c)


# DuckDB form of the same flow: translate each flat grant, then aggregate.
_TRANSLATE_SQL = f"""
flat AS (
  SELECT schema_name, table_name, principal, object_type AS object_level,
    unnest(CASE
      WHEN object_type = 'CATALOG$' AND action_type = 'OWN' THEN []::VARCHAR[]
      WHEN object_type = 'CATALOG$' AND action_type = 'READ_METADATA' THEN ['BROWSE']
      WHEN object_type = 'CATALOG$' AND action_type = 'CREATE_NAMED_FUNCTION' THEN ['CREATE FUNCTION']
      WHEN object_type = 'CATALOG$' AND action_type = 'CREATE' THEN ['CREATE SCHEMA', 'CREATE TABLE']
      WHEN object_type = 'DATABASE' AND action_type IN ('READ_METADATA', 'OWN') THEN []::VARCHAR[]
      WHEN object_type = 'DATABASE' AND action_type = 'CREATE_NAMED_FUNCTION' THEN ['CREATE FUNCTION']
      WHEN object_type = 'DATABASE' AND action_type = 'CREATE' THEN ['CREATE TABLE']
      WHEN object_type = 'TABLE' AND action_type IN ('SELECT', 'MODIFY') THEN [action_type]
      WHEN object_type IN ('CATALOG$', 'DATABASE') THEN [action_type]
      ELSE []::VARCHAR[] END) AS privilege
  FROM grants WHERE principal IS DISTINCT FROM 'users'),
translated AS (
  SELECT schema_name, table_name, principal, object_level,
    CASE object_level WHEN 'CATALOG$' THEN 'catalog' WHEN 'DATABASE' THEN 'schema' ELSE 'table' END AS securable_type,
    CASE object_level WHEN 'CATALOG$' THEN '{CATALOG}' WHEN 'DATABASE' THEN '{CATALOG}.' || schema_name
         ELSE '{CATALOG}.' || schema_name || '.' || table_name END AS securable_name,
    list_sort(list(DISTINCT privilege)) AS permission_list
  FROM flat WHERE object_level NOT IN ('DATABASE', 'TABLE') OR schema_name IS NOT NULL GROUP BY ALL),
usage AS (
  SELECT schema_name, table_name, principal, object_level, securable_type, securable_name, permission_list FROM translated
  UNION ALL SELECT schema_name, table_name, principal, object_level, 'schema', concat('{CATALOG}.', schema_name), ['USAGE']
    FROM translated WHERE object_level = 'TABLE'
  UNION ALL SELECT schema_name, table_name, principal, object_level, 'catalog', '{CATALOG}', ['USAGE']
    FROM translated WHERE object_level IN ('TABLE', 'DATABASE')),
dedup AS (SELECT DISTINCT principal, securable_type, securable_name, permission_list FROM usage)
"""


def _grant_sql(select: str) -> str:
    sql = fx.with_fixtures("SELECT 1", "grants")
    head = sql[: sql.rindex("SELECT 1")].rstrip()
    return f"{head},\n{_TRANSLATE_SQL.strip()}\n{select.strip()}"


def _grants(spark, sf_dir):
    return fx.grants(spark, sf_dir)


def _translated(spark, sf_dir):
    return translate_privileges(grants_by_principal(_grants(spark, sf_dir)), CATALOG)


@plan("tables_by_schema", fx.with_fixtures("""
SELECT database AS schema_name, count(*) AS table_count FROM inventory
WHERE NOT coalesce(is_temporary, false) GROUP BY database""", "inventory"))
def q_tables_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-temporary tables per schema."""
    return tables_by_schema(fx.inventory(spark, sf_dir))


@plan("table_list", fx.with_fixtures("""
SELECT database AS schema_name, table_name FROM inventory WHERE NOT coalesce(is_temporary, false)""", "inventory"))
def q_table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-temporary tables as flat rows."""
    return tables_of(fx.inventory(spark, sf_dir))


@plan("privilege_rows", fx.with_fixtures("""
SELECT DISTINCT schema_name, table_name, principal, object_type AS object_level, action_type AS privilege
FROM grants WHERE action_type IS NOT NULL""", "grants"))
def q_privilege_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The privilege lists flattened to one row per privilege."""
    return explode_list(grants_by_principal(_grants(spark, sf_dir)), "permission_list", "privilege")


@plan("grants_by_principal", fx.with_fixtures("""
SELECT schema_name, table_name, principal, object_type AS object_level,
  string_agg(DISTINCT action_type, ',' ORDER BY action_type) AS permission_list,
  count(DISTINCT action_type) AS n_privileges
FROM grants GROUP BY schema_name, table_name, principal, object_type""", "grants"))
def q_grants_by_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privileges per table, principal and level."""
    g = with_list_size(grants_by_principal(_grants(spark, sf_dir)), "permission_list", "n_privileges")
    return g.withColumn("permission_list", _joined("permission_list"))


@plan("translate_privileges", _grant_sql("""
SELECT schema_name, table_name, principal, object_level, securable_type, securable_name,
  array_to_string(permission_list, ',') AS permission_list FROM translated"""))
def q_translate_privileges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy privileges in the new model."""
    t = _translated(spark, sf_dir)
    return t.select(*[c for c in t.columns if c != "permission_list"], _joined("permission_list"))


@plan("usage_closure", _grant_sql("""
SELECT schema_name, table_name, principal, object_level, securable_type, securable_name,
  array_to_string(permission_list, ',') AS permission_list FROM usage"""))
def q_usage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated grants plus the usage grants they imply."""
    u = with_usage(_translated(spark, sf_dir), CATALOG)
    return u.select(*[c for c in u.columns if c != "permission_list"], _joined("permission_list"))


@plan("dedup_grants", _grant_sql("""
SELECT principal, securable_type, securable_name, array_to_string(permission_list, ',') AS permission_list
FROM dedup"""))
def q_dedup_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per principal, securable and privilege set."""
    d = dedup_grants(with_usage(_translated(spark, sf_dir), CATALOG))
    return d.select("principal", "securable_type", "securable_name", _joined("permission_list"))


@plan("grant_changes", _grant_sql("""
SELECT securable_type, securable_name, principal, array_to_string(permission_list, ',') AS add,
  CAST(to_json({'changes': [{'principal': principal, 'add': permission_list}]}) AS VARCHAR) AS body
FROM dedup WHERE principal IS NOT NULL"""))
def q_grant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change request per securable and principal."""
    c = grant_changes(dedup_grants(with_usage(_translated(spark, sf_dir), CATALOG)))
    return c.select("securable_type", "securable_name", "principal", _joined("add"), "body")


@plan("union_grants", fx.with_fixtures("""
SELECT schema_name, table_name, principal, object_type, action_type FROM grants WHERE object_type = 'TABLE'
UNION ALL SELECT schema_name, NULL AS table_name, principal, object_type, action_type FROM grants
  WHERE object_type IN ('DATABASE', 'CATALOG$')
UNION ALL SELECT schema_name, table_name, NULL, NULL, NULL FROM grants
  WHERE object_type IS NULL OR object_type NOT IN ('TABLE', 'DATABASE', 'CATALOG$')""", "grants"))
def q_union_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants arriving in three parts with differing columns (table
    grants; schema-level grants without a table column; failed tables with
    only their names) joined by name in a balanced union."""
    g = fx.grants(spark, sf_dir)
    lvl = F.col("object_type")
    tables = g.where(lvl == "TABLE")
    upper = g.where(lvl.isin("DATABASE", "CATALOG$")).select(
        "action_type", "object_type", "principal", "schema_name")
    failed = g.where(lvl.isNull() | ~lvl.isin("TABLE", "DATABASE", "CATALOG$")).select(
        "schema_name", "table_name")
    return union_all([tables, upper, failed]).select(
        "schema_name", "table_name", "principal", "object_type", "action_type")
