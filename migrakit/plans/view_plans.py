"""Plans of the view family: qualify view texts, build the statements, and a
cut-over of views defined over the 14 tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import quote_ident, quote_name
from ..operators.projections import attributes_wide
from ..operators.sqltext import cut_over_views, qualify_sql, qualify_sql_duckdb, view_statements
from ..operators.verify import verify_counts
from ..session import drop_database, work_dir
from ..sources import fixtures as fx
from ..sources.catalog import describe_long
from ..sources.tables import TableRef, count_tables
from .copy_check import source_refs
from .registry import plan

CATALOG = "main"
SCHEMAS = ("sales", "hr")
OLD_CATALOGS = ("hive_metastore", "old_catalog")

_QUALIFIED = qualify_sql_duckdb("view_text", SCHEMAS, CATALOG, OLD_CATALOGS)


@plan("qualify_sql", fx.with_fixtures(
    f"SELECT schema_name, view_name, {_QUALIFIED} AS view_text FROM view_texts", "view_texts"))
def q_qualify_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema names in every view text put under the new catalog."""
    return qualify_sql(fx.view_texts(spark, sf_dir), "view_text", SCHEMAS, CATALOG, OLD_CATALOGS)


@plan("view_statements", fx.with_fixtures(
    "SELECT schema_name, view_name, concat('CREATE OR REPLACE VIEW `main`.`', replace(schema_name, '`', '``'), "
    "'`.`', replace(view_name, '`', '``'), '` AS ', " + _QUALIFIED + ") AS view_stmt FROM view_texts",
    "view_texts"))
def q_view_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3/P5: one create statement per view."""
    return view_statements(fx.view_texts(spark, sf_dir), SCHEMAS, CATALOG, OLD_CATALOGS)


# Texts whose literals, comments, common table expressions and aliases hold the
# names, and a map of schemas in which every new name is an old one as well.
RENAMES = {"a": "b", "b": "c", "x": "y", "y": "x"}
_LITERAL = "concat('''', replace(replace(text, '''', ''), chr(92), ''), ' a.t b.u''')"
_KINDS = (
    ("concat('SELECT ', {lit}, ' AS s, a.t.k FROM a.t JOIN `B`.u ON a.t.k = u.k -- a.t', chr(10), 'WHERE k > 1 /* b.u */')",
     "concat('SELECT ', {lit}, ' AS s, `main`.`b`.t.k FROM `main`.`b`.t JOIN `main`.`c`.u ON `main`.`b`.t.k = u.k -- a.t', chr(10), "
     "'WHERE k > 1 /* b.u */')"),
    ("concat('WITH a AS (SELECT ', {lit}, ' AS s FROM x.t', CAST(doc_id AS STRING), '), y AS (SELECT 1 k) SELECT a.s, y.k FROM a, y, y.v')",
     "concat('WITH a AS (SELECT ', {lit}, ' AS s FROM `main`.`y`.t', CAST(doc_id AS STRING), '), y AS (SELECT 1 k) SELECT a.s, y.k "
     "FROM a, y, `main`.`x`.v')"),
    ("concat('SELECT b.k, x.k, ', {lit}, ' FROM hive_metastore.a.t AS b JOIN old_catalog.`b`.u x ON b.k = x.k, x.w')",
     "concat('SELECT b.k, x.k, ', {lit}, ' FROM `main`.`b`.t AS b JOIN `main`.`c`.u x ON b.k = x.k, x.w')"),
    ("concat('SELECT ', {lit}, ' FROM x.w, (SELECT * FROM a.t) y WHERE y.k IN (SELECT b.f(k) FROM main.c.t)')",
     "concat('SELECT ', {lit}, ' FROM `main`.`y`.w, (SELECT * FROM `main`.`b`.t) y WHERE y.k IN (SELECT `main`.`c`.f(k) FROM main.c.t)')"),
)


def _texts(which: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {kind[which].format(lit=_LITERAL)}" for i, kind in enumerate(_KINDS))
    return f"CASE doc_id % {len(_KINDS)} {cases} END"


@plan("qualify_references", f"SELECT doc_id, {_texts(1)} AS view_text, {_texts(1)} AS again FROM documents")
def q_qualify_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2/X5/J4 with renames that follow and swap each other: only references
    change, each once, and a second run changes nothing."""
    texts = fx.base(spark, sf_dir, "documents").select("doc_id", F.expr(_texts(0).replace("chr(", "char(")).alias("view_text"))
    once = qualify_sql(texts, "view_text", RENAMES, CATALOG, OLD_CATALOGS)
    return qualify_sql(once, "view_text", RENAMES, CATALOG, OLD_CATALOGS, out="again")


# Views of the legacy schema used by the cut-over plan: (name, text, oracle).
# ``{db}`` is the legacy schema.  Listed so that a view on views comes first.
CUT_OVER_VIEWS = (
    ("v_big_open", "SELECT b.l_orderkey, b.l_quantity FROM {db}.v_big_items b "
                   "JOIN {db}.v_open_orders o ON b.l_orderkey = o.o_orderkey",
     "SELECT count(*) FROM lineitem b JOIN orders o ON b.l_orderkey = o.o_orderkey "
     "WHERE b.l_quantity > 25 AND o.o_orderstatus = 'O'"),
    ("v_big_items", "SELECT l_orderkey, l_quantity FROM {db}.lineitem WHERE l_quantity > 25",
     "SELECT count(*) FROM lineitem WHERE l_quantity > 25"),
    ("v_open_orders", "SELECT * FROM {db}.orders WHERE o_orderstatus = 'O'",
     "SELECT count(*) FROM orders WHERE o_orderstatus = 'O'"),
    ("v_events_by_type", "SELECT event_type, count(*) AS n FROM `{db}`.events GROUP BY event_type",
     "SELECT count(DISTINCT event_type) FROM events"),
    ("v_doc_langs", "SELECT d.doc_id, d.lang, l.quality FROM {db}.documents d "
                    "LEFT JOIN {db}.labels l ON d.doc_id = l.doc_id",
     "SELECT count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    *((f"v_{t}", f"SELECT * FROM {{db}}.{t}", f"SELECT count(*) FROM {t}")
      for t in fx.ALL_TABLES if t not in ("lineitem", "orders", "events", "documents", "labels")),
)


@plan("view_cut_over", "\nUNION ALL ".join(
    f"SELECT 'legacy' AS database, '{name}' AS table_name, ({sql}) AS source_count, ({sql}) AS target_count, "
    f"'match' AS verdict" for name, _, sql in CUT_OVER_VIEWS))
def q_view_cut_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 end to end over the 14 tables: register them in a legacy schema,
    define views there (one on other views), read the view texts back from
    the catalog's describe rows (P8), qualify them, create the views in a
    new schema (retrying views whose dependencies come later) and compare
    the row count of every view on both sides."""
    tag = uuid.uuid4().hex[:10]
    legacy, target = f"mk_legacy_{tag}", f"mk_target_{tag}"
    for db in (legacy, target):
        spark.sql(f"CREATE DATABASE {quote_ident(db)} LOCATION '{work_dir(spark, 'views', db, fresh=False)}'")
    for r in source_refs(sf_dir):
        spark.catalog.createTable(quote_name(legacy, r.table), path=r.location, source=r.provider)
    for name, text, _ in reversed(CUT_OVER_VIEWS):
        spark.sql(f"CREATE VIEW {quote_name(legacy, name)} AS {text.format(db=legacy)}")

    # The view texts, as the describe output of each view (long -> wide).
    described = describe_long(spark, [(legacy, name) for name, _, _ in CUT_OVER_VIEWS])
    texts = attributes_wide(
        described.select(F.col("table_name").alias("entity"), "ordinal", "attr", "val"), ["View Text"]
    ).select(F.lit(legacy).alias("schema_name"), F.col("entity").alias("view_name"),
             F.col("View_Text").alias("view_text"))
    # The tables move too: target views read target tables and target views only.
    for r in source_refs(sf_dir):
        spark.catalog.createTable(quote_name(target, r.table), path=r.location, source=r.provider)
    stmts = view_statements(texts, {legacy: target}, "spark_catalog", target_schema=F.lit(target))
    outcomes = cut_over_views(spark, stmts)
    ok = [r["view_name"] for r in outcomes.where("status = 'success'").collect()]
    reads = describe_long(spark, [(target, n) for n in ok]).where(
        (F.col("attr") == "View Text") & F.lower("val").contains(legacy)).select("table_name").collect()
    ok = [n for n in ok if n not in {r["table_name"] for r in reads}]       # a view on the old schema is not moved
    src = [TableRef("legacy", n, name=quote_name(legacy, n)) for n, _, _ in CUT_OVER_VIEWS]
    dst = [TableRef("legacy", n, name=quote_name(target, n)) for n in ok]
    verdicts = verify_counts(count_tables(spark, src), count_tables(spark, dst))
    for db in (legacy, target):
        drop_database(spark, db)
    return verdicts
