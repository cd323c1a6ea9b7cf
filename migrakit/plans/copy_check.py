"""Plans of the copy-and-check family: count all tables, copy them (keeping
or adding a partition layout), count and hash again, give a verdict."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import quote_ident_col, quote_name
from ..operators.copying import bounded_error, copy_from_plan, copy_tables, existing_layout, plan_copy, with_target_path
from ..operators.journal import read_journal
from ..operators.locate import locate_differences
from ..operators.sqltext import copy_statement_col
from ..operators.verify import KEYS, join_results, split_outcomes, verify_copies, verify_counts
from ..session import drop_database, remove_dir, work_dir
from ..sources import fixtures as fx
from ..sources.catalog import inventory_from_catalog
from ..sources.tables import SAME_FORMAT_PROVIDERS, TableRef, count_tables, read_table, records
from .registry import plan

DATABASE = "testdata"

# Partition layout given to the copies of the two large tables.
PARTITION_LAYOUT = {"lineitem": ("l_returnflag",), "orders": ("o_orderstatus",)}


def source_refs(sf_dir: str, tables=fx.ALL_TABLES) -> list[TableRef]:
    return [TableRef(DATABASE, t, "parquet", f"{sf_dir.rstrip('/')}/{t}.parquet",
                     PARTITION_LAYOUT.get(t, ())) for t in tables]


def _counts_sql(count_cols: str, tables=fx.ALL_TABLES) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{DATABASE}' AS database, '{t}' AS table_name, {count_cols} FROM {t}" for t in tables)


@plan("count_tables", _counts_sql("count(*) AS n"))
def q_count_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of the 14 tables in one plan."""
    return count_tables(spark, source_refs(sf_dir))


def copy_and_verify(spark: SparkSession, refs: list[TableRef], base: str,
                    to_format: str | None = None, max_workers: int = 8) -> tuple[DataFrame, DataFrame]:
    """K4 + V1 with content hashes: copy every table under ``base`` and check
    each copy.  Returns (outcomes, verdicts)."""
    tasks = [(r, f"{base}/{r.database}/{r.table}") for r in refs]
    outcomes = copy_tables(spark, tasks, to_format=to_format, max_workers=max_workers)
    # What each copy wrote was fingerprinted during the write: only the
    # copies are read to check them.
    known = {(o["database"], o["table_name"]): (o["source_rows"], o["source_hash"])
             for o in outcomes.collect() if o["action"] == "copied"}
    pairs = [(r, r.at(loc, provider=to_format or r.provider)) for r, loc in tasks]
    return outcomes, verify_copies(spark, pairs, known_sources=known)


@plan("copy_verify", _counts_sql("count(*) AS source_count, count(*) AS target_count, 'match' AS verdict"))
def q_copy_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1/K2/V1: copy all 14 tables (lineitem and orders partitioned) to a
    fresh folder, then compare counts and full-row hashes."""
    base = work_dir(spark, "copy_verify")
    _, verdicts = copy_and_verify(spark, source_refs(sf_dir), base)      # both sides are local rows by now
    remove_dir(spark, base)
    return verdicts


@plan("copy_outcomes", "\nUNION ALL ".join(
    f"SELECT '{DATABASE}' AS database, '{t}' AS table_name, {run} AS run, '{action}' AS action, "
    f"true AS copied_successfully, count(*) AS target_rows FROM {t}"
    for run, action in ((1, "copied"), (2, "skipped")) for t in fx.ALL_TABLES))
def q_copy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K4: bulk copy twice into the same folder; the second run skips the
    complete targets.  One outcome row per table and run, with the rows the
    target holds after both runs."""
    base = work_dir(spark, "copy_outcomes")
    refs = source_refs(sf_dir)
    tasks = [(r, f"{base}/{r.table}") for r in refs]
    first = copy_tables(spark, tasks, if_exists="skip").withColumn("run", F.lit(1))
    second = copy_tables(spark, tasks, if_exists="skip").withColumn("run", F.lit(2))
    rows = count_tables(spark, [r.at(loc) for r, loc in tasks]).withColumnRenamed("n", "target_rows")
    remove_dir(spark, base)
    return first.unionByName(second).join(rows, ["database", "table_name"], "left").select(
        "database", "table_name", "run", "action", "copied_successfully", "target_rows")


@plan("needs_copy", fx.with_fixtures("""
SELECT i.database, i.table_name, i.location AS curr_loc, i.provider, c.n AS source_count,
       concat('s3://target/uc/', i.database, '/', i.table_name) AS ext_loc, CAST(NULL AS VARCHAR[]) AS partition_col_list
FROM inventory i LEFT JOIN source_counts c ON i.database = c.database AND i.table_name = c.table_name
WHERE (NOT starts_with(i.location, 's3') OR i.provider = 'hive')
  AND NOT coalesce(i.table_type = 'VIEW', false) AND NOT coalesce(i.is_temporary, false)
""", "inventory", "source_counts"))
def q_needs_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy plan of the inventory with source counts."""
    return plan_copy(fx.inventory(spark, sf_dir), fx.source_counts(spark, sf_dir), "s3://target/uc")


@plan("copy_statements", fx.with_fixtures("""
SELECT database, table_name, concat('CREATE TABLE IF NOT EXISTS `main`.`', database, '`.`', table_name, '` USING ',
  CASE WHEN provider IN ('parquet', 'delta') THEN provider ELSE 'parquet' END,
  CASE WHEN provider = 'delta' THEN ' PARTITIONED BY (`day`, `a b`)' ELSE '' END, ' LOCATION ''s3://target/uc/', database, '/',
  table_name, ''' AS SELECT * FROM `', database, '`.`', table_name, '`') AS stmt
FROM inventory
WHERE (NOT starts_with(location, 's3') OR provider = 'hive')
  AND NOT coalesce(table_type = 'VIEW', false) AND NOT coalesce(is_temporary, false)""", "inventory"))
def q_copy_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy plan as statements, partition columns carried through."""
    parts = F.when(F.col("provider") == "delta", F.array(F.lit("day"), F.lit("a b")))
    inv = fx.inventory(spark, sf_dir).withColumn("partition_col_list", parts)
    p = plan_copy(inv, fx.source_counts(spark, sf_dir), "s3://target/uc")
    source = F.concat_ws(".", quote_ident_col(F.col("database")), quote_ident_col(F.col("table_name")))
    fmt = F.when(F.col("provider").isin(*SAME_FORMAT_PROVIDERS), F.col("provider")).otherwise(F.lit("parquet"))
    return p.select("database", "table_name", copy_statement_col("main", F.col("database"), F.col("table_name"), source, fmt,
                                                                 F.col("ext_loc"), F.col("partition_col_list")).alias("stmt"))


@plan("verify_counts", fx.with_fixtures("""
SELECT coalesce(s.database, t.database) AS database, coalesce(s.table_name, t.table_name) AS table_name,
       s.n AS source_count, t.n AS target_count,
       CASE WHEN t.table_name IS NULL THEN 'missing' WHEN s.table_name IS NULL THEN 'extra'
            WHEN s.n IS NULL OR t.n IS NULL THEN 'unknown' WHEN s.n = t.n THEN 'match' ELSE 'mismatch' END AS verdict
FROM source_counts s FULL OUTER JOIN target_counts t ON s.database = t.database AND s.table_name = t.table_name
""", "source_counts", "target_counts"))
def q_verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source against target counts with a verdict per table."""
    return verify_counts(fx.source_counts(spark, sf_dir), fx.target_counts(spark, sf_dir))


@plan("outcome_split", fx.with_fixtures("""
SELECT * FROM (
SELECT coalesce(s.database, t.database) AS database, coalesce(s.table_name, t.table_name) AS table_name,
       s.n AS source_count, t.n AS target_count,
       CASE WHEN t.table_name IS NULL THEN 'missing' WHEN s.table_name IS NULL THEN 'extra'
            WHEN s.n IS NULL OR t.n IS NULL THEN 'unknown' WHEN s.n = t.n THEN 'match' ELSE 'mismatch' END AS verdict
FROM source_counts s FULL OUTER JOIN target_counts t ON s.database = t.database AND s.table_name = t.table_name
) WHERE verdict <> 'match'
""", "source_counts", "target_counts"))
def q_outcome_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the count check that needs attention."""
    _, bad = split_outcomes(verify_counts(fx.source_counts(spark, sf_dir),
                                          fx.target_counts(spark, sf_dir)))
    return bad


# Tables that are not Parquet, as the legacy catalog may hold them: (table, format,
# statement that makes one from the source table, partition columns).
_CATALOG_TABLES = (
    ("c_nation", "csv", "SELECT n_nationkey, n_name, n_regionkey FROM {src}", "nation", ()),
    ("o_orders", "orc", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM {src}", "orders", ("o_orderstatus",)),
    ("j_supplier", "json", "SELECT s_suppkey, s_name FROM {src}", "supplier", ()),
    ("p_maps", "parquet", "SELECT e_id, map('type', event_type) AS attrs FROM (SELECT event_id AS e_id, event_type FROM {src})", "events", ()),
)


@plan("copy_by_name", """
SELECT 'legacy' AS database, t AS table_name, 'copied' AS action, n AS source_count, n AS target_count, 'match' AS verdict,
  fields, layout FROM (
  SELECT 'c_nation' AS t, (SELECT count(*) FROM nation) AS n, 'n_nationkey:int,n_name:string,n_regionkey:int' AS fields, '' AS layout
  UNION ALL SELECT 'o_orders', (SELECT count(*) FROM orders), 'o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderstatus:string', 'o_orderstatus'
  UNION ALL SELECT 'j_supplier', (SELECT count(*) FROM supplier), 's_suppkey:bigint,s_name:string', ''
  UNION ALL SELECT 'p_maps', (SELECT count(*) FROM events), 'e_id:bigint,attrs:map<string,string>', '')""")
def q_copy_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 -> K1/K2 over catalog tables in CSV (header, own separator), ORC
    (partitioned), JSON and Parquet (a map column): the plan comes from the
    catalog's inventory, the tables are read by name, and every copy is checked
    on column names, types, layout, row count and content."""
    tag = uuid.uuid4().hex[:10]
    db, base = f"mk_formats_{tag}", work_dir(spark, "copy_by_name", tag, fresh=False)
    spark.sql(f"CREATE DATABASE {quote_name(db)} LOCATION '{base}/db'")
    for name, fmt, text, table, parts in _CATALOG_TABLES:
        layout = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        options = " OPTIONS (header 'true', sep '|')" if fmt == "csv" else ""
        src = f"parquet.`{sf_dir.rstrip('/')}/{table}.parquet`"
        spark.sql(f"CREATE TABLE {quote_name(db, name)} USING {fmt}{options}{layout} AS {text.format(src=src)}")
    inv = inventory_from_catalog(spark, [db])
    plan_rows = plan_copy(inv, count_tables(spark, [TableRef(db, n, name=quote_name(db, n)) for n, *_ in _CATALOG_TABLES]),
                          f"{base}/copies")
    done = {r["table_name"]: r for r in copy_from_plan(spark, plan_rows).collect()}
    pairs = [(TableRef(db, n, name=quote_name(db, n)), TableRef(db, n, "parquet", done[n]["ext_loc"]))
             for n, *_ in _CATALOG_TABLES]
    verdicts = {r["table_name"]: r for r in verify_copies(spark, pairs).collect()}
    rows = []
    for src, dst in pairs:
        want = read_table(spark, src).schema
        got = spark.read.schema(want).parquet(dst.location).schema
        fields = {f.name: f.dataType.simpleString() for f in got.fields}
        parts = sorted(existing_layout(spark, dst, read_table(spark, dst)))
        v = verdicts[src.table]
        rows.append(("legacy", src.table, done[src.table]["action"], v["source_count"], v["target_count"], v["verdict"],
                     ",".join(f"{f.name}:{fields[f.name]}" for f in want.fields), ",".join(parts)))
    drop_database(spark, db)
    remove_dir(spark, base)
    return records(spark, rows, "database string, table_name string, action string, source_count long, target_count long, "
                                "verdict string, fields string, layout string")


@plan("copy_safety", """
SELECT 'd1' AS database, 't' AS table_name, 'copied' AS action, true AS copied_successfully, (SELECT count(*) FROM nation) AS target_rows, '' AS error
UNION ALL SELECT 'd2', 't', 'copied', true, (SELECT count(*) FROM events), ''
UNION ALL SELECT 'd3', 'kept', 'skipped_unverified', false, (SELECT count(*) FROM region), 'the target holds other rows th'
UNION ALL SELECT 'd4', 'x', 'refused', false, NULL, 'several tables have the target'
UNION ALL SELECT 'd5', 'x', 'refused', false, NULL, 'several tables have the target'""")
def q_copy_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table name in two schemas keeps two targets; a target
    somebody else wrote, with other rows, is left alone and is no success; two tables
    sent to one folder are refused.  Checked by the rows left behind; errors are
    cut to their first characters (P6)."""
    data, base = sf_dir.rstrip("/"), work_dir(spark, "copy_safety")
    spark.read.parquet(f"{data}/region.parquet").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/d3/kept")
    listed = records(spark, [("d1", "t", f"{data}/nation.parquet"), ("d2", "t", f"{data}/events.parquet"),
                             ("d3", "kept", f"{data}/nation.parquet")], "database string, table_name string, location string")
    tasks = [(TableRef(r["database"], r["table_name"], "parquet", r["location"]), r["ext_loc"])
             for r in with_target_path(listed, base).collect()]
    tasks += [(TableRef(d, "x", "parquet", f"{data}/{t}.parquet"), f"{base}/shared/x") for d, t in (("d4", "nation"), ("d5", "region"))]
    out = bounded_error(copy_tables(spark, tasks).withColumn("error", F.coalesce("error", F.lit(""))), limit=30)
    left = count_tables(spark, [r.at(loc) for r, loc in tasks]).withColumnRenamed("n", "target_rows")
    remove_dir(spark, base)
    return out.join(left, ["database", "table_name"], "left").select(
        "database", "table_name", "action", "copied_successfully", "target_rows", "error")


@plan("copy_results", "\nUNION ALL ".join(
    f"SELECT '{DATABASE}' AS database, '{t}' AS table_name, '{t}' AS source_name, true AS copied_successfully, "
    f"count(*) AS source_count, count(*) AS target_count, 'match' AS verdict, false AS any_bad FROM {t}" for t in fx.ALL_TABLES))
def q_copy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy plan joined with its outcomes, both counts and the verdict
    in one row per table, and whether any copy is bad at all."""
    data, base = sf_dir.rstrip("/"), work_dir(spark, "copy_results")
    refs = [TableRef(DATABASE, t, "parquet", f"{data}/{t}.parquet") for t in fx.ALL_TABLES]
    listed = records(spark, [(r.database, r.table, "parquet", r.location, "TABLE") for r in refs],
                     "database string, table_name string, provider string, location string, table_type string")
    planned = plan_copy(listed, count_tables(spark, refs), base)
    outcomes = copy_from_plan(spark, planned)
    counts = count_tables(spark, [r.at(f"{base}/{r.database}/{r.table}") for r in refs])
    results = join_results(planned, outcomes, counts)
    _, bad = split_outcomes(results)
    any_bad = not bad.isEmpty()
    remove_dir(spark, base)
    return results.select("database", "table_name", F.regexp_extract("curr_loc", r"([^/]+)\.parquet$", 1).alias("source_name"),
                          "copied_successfully", "source_count", "target_count", "verdict", F.lit(any_bad).alias("any_bad"))


#: What a rerun must find, by table: (action, steps of the journal in alphabetical order).
_RERUN = dict.fromkeys(fx.ALL_TABLES, ("skipped", "published,registered,staged,started")) | {
    "nation": ("registered", "published,registered,registered,staged,started"),
    "supplier": ("skipped", "failed,published,registered,staged,started,started"),
    "labels": ("skipped_unverified", "")}


@plan("copy_rerun", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{action}' AS action, {action != 'skipped_unverified'} AS copied_successfully, "
    f"(SELECT count(*) FROM {'region' if t == 'labels' else t}) AS target_rows, "
    f"{'NULL' if t == 'labels' else f'(SELECT count(*) FROM {t})'} AS registered_rows, '{steps}' AS steps"
    for t, (action, steps) in _RERUN.items()))
def q_copy_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K4/Y2 on a rerun over all tables: one lost its catalog entry, the place of
    one holds somebody else's rows, and an overwrite of one broke half way.  Checked
    by the actions, the rows of the folders and of the names, and the journal."""
    tag = uuid.uuid4().hex[:10]
    db, base = f"mk_rerun_{tag}", work_dir(spark, "copy_rerun", tag, fresh=False)
    spark.sql(f"CREATE DATABASE {quote_name(db)} LOCATION '{base}/db'")
    refs = source_refs(sf_dir)
    tasks = [(r, f"{base}/{r.table}") for r in refs]
    names = {(r.database, r.table): quote_name(db, r.table) for r in refs}
    copy_tables(spark, [t for t in tasks if t[0].table != "labels"], target_names=names)
    spark.sql(f"DROP TABLE {quote_name(db, 'nation')}")
    spark.read.parquet(f"{sf_dir.rstrip('/')}/region.parquet").write.parquet(f"{base}/labels")
    breaks = f"mk_breaks_{tag}"
    fx.base(spark, sf_dir, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") == 1, F.raise_error(F.lit("half way")))
                                                  .otherwise(F.col("s_name"))).createOrReplaceTempView(breaks)
    copy_tables(spark, [(TableRef(DATABASE, "supplier", "parquet", name=breaks), f"{base}/supplier")], if_exists="overwrite")
    again = copy_tables(spark, tasks, target_names=names)
    rows = count_tables(spark, [r.at(loc) for r, loc in tasks]).select("table_name", F.col("n").alias("target_rows"))
    held = [TableRef(DATABASE, r.table, name=names[r.database, r.table]) for r in refs if r.table != "labels"]
    named = count_tables(spark, held).select("table_name", F.col("n").alias("registered_rows"))
    steps = read_journal(spark, [loc for _, loc in tasks]).groupBy("table_name").agg(
        F.array_join(F.sort_array(F.collect_list("step")), ",").alias("steps"))
    steps = records(spark, [tuple(r) for r in steps.collect()], "table_name string, steps string")
    spark.catalog.dropTempView(breaks)
    drop_database(spark, db)
    remove_dir(spark, base)
    return (again.join(rows, "table_name").join(named, "table_name", "left").join(steps, "table_name", "left")
            .select("table_name", "action", "copied_successfully", "target_rows", "registered_rows",
                    F.coalesce("steps", F.lit("")).alias("steps")))


#: The columns that name a row, by table.
TABLE_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
              "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
              "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",),
              "labels": ("doc_id",), "conversations": ("conv_id", "turn")}


def _place_sql(key: str) -> str:
    return f"substr(md5({key}), 1, 4)"


@plan("locate_differences", "\nUNION ALL ".join([
    f"SELECT 'orders' AS table_name, CAST(k AS VARCHAR) AS key, {_place_sql('CAST(k AS VARCHAR)')} AS range, 1 AS source_rows, "
    "1 AS target_rows, 'changed' AS kind FROM (SELECT min(o_orderkey) AS k FROM orders)",
    f"SELECT 'documents', CAST(k AS VARCHAR), {_place_sql('CAST(k AS VARCHAR)')}, 1, 1, 'changed' FROM (SELECT max(doc_id) AS k FROM documents)",
    f"SELECT 'customer', CAST(k AS VARCHAR), {_place_sql('CAST(k AS VARCHAR)')}, 1, 0, 'missing' FROM (SELECT max(c_custkey) AS k FROM customer)",
    f"SELECT 'part', CAST(k AS VARCHAR), {_place_sql('CAST(k AS VARCHAR)')}, 0, 1, 'extra' FROM (SELECT max(p_partkey) + 1 AS k FROM part)",
    f"SELECT 'lineitem', k, {_place_sql('k')}, n, 2 * n, 'changed' FROM (SELECT concat(l_orderkey, '|', l_linenumber) AS k, count(*) AS n "
    "FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem) GROUP BY ALL)"]))
def q_locate_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: copies of all 14 tables, five of which came out wrong (a value and a text
    changed, a row lost, a row too many, the rows of an order twice): the check names
    the tables, the hash ranges and the keys that differ, and those alone."""
    base = work_dir(spark, "locate_differences")
    refs = source_refs(sf_dir)
    t = {r.table: read_table(spark, r) for r in refs}
    last = lambda name, c, f=F.max: t[name].agg(f(c)).first()[0]
    swap = lambda name, k, at, c, new: t[name].withColumn(c, F.when(F.col(k) == at, new).otherwise(F.col(c)))
    most = {k: last(k, c) for k, c in (("documents", "doc_id"), ("customer", "c_custkey"), ("part", "p_partkey"), ("lineitem", "l_orderkey"))}
    wrong = {
        "orders": swap("orders", "o_orderkey", last("orders", "o_orderkey", F.min), "o_totalprice", F.col("o_totalprice") + 1),
        "documents": swap("documents", "doc_id", most["documents"], "text", F.concat(F.coalesce("text", F.lit("")), F.lit("."))),
        "customer": t["customer"].where(F.col("c_custkey") != most["customer"]),
        "part": t["part"].unionByName(t["part"].where(F.col("p_partkey") == most["part"]).withColumn(
            "p_partkey", F.lit(most["part"] + 1).cast(t["part"].schema["p_partkey"].dataType))),
        "lineitem": t["lineitem"].unionByName(t["lineitem"].where(F.col("l_orderkey") == most["lineitem"]))}
    honest = [(r, f"{base}/{r.table}") for r in refs if r.table not in wrong]
    for name, df in wrong.items():
        df.write.parquet(f"{base}/{name}")
    done = copy_tables(spark, honest)
    known = {(o["database"], o["table_name"]): (o["source_rows"], o["source_hash"]) for o in done.collect() if o["action"] == "copied"}
    pairs = [(r, r.at(f"{base}/{r.table}")) for r in refs]
    verdicts = verify_copies(spark, pairs, known_sources=known)
    out = locate_differences(spark, pairs, {(DATABASE, k): v for k, v in TABLE_KEYS.items()}, verdicts, f"{base}/ranges")
    return out.select("table_name", "key", F.substring("range", 1, 4).alias("range"), "source_rows", "target_rows", "kind")


@plan("count_reasons", _counts_sql("count(*) AS source_count, count(*) AS target_count, 'match' AS verdict, NULL AS source_reason, "
                                   "NULL AS target_reason") + f"""
UNION ALL SELECT '{DATABASE}', 'lost_copy', count(*), NULL, 'unknown', NULL, 'PATH_NOT_FOUND' FROM nation
UNION ALL SELECT '{DATABASE}', 'lost_source', NULL, count(*), 'unknown', 'PATH_NOT_FOUND', NULL FROM nation
UNION ALL SELECT '{DATABASE}', 'lost_name', NULL, NULL, 'unknown', 'TABLE_OR_VIEW_NOT_FOUND', 'PATH_NOT_FOUND'""")
def q_count_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count check of all tables and of three that lost a side: an unknown
    verdict comes with the class of the error on either side."""
    refs, gone = source_refs(sf_dir), f"{sf_dir.rstrip('/')}/no_such_table.parquet"
    nation = next(r.location for r in refs if r.table == "nation")
    lost = [(TableRef(DATABASE, name, "parquet", a, name=by), TableRef(DATABASE, name, "parquet", b))
            for name, a, b, by in (("lost_copy", nation, gone, None), ("lost_source", gone, nation, None), ("lost_name", None, gone, "no_such_table"))]
    out = verify_copies(spark, [(r, r) for r in refs] + lost, content=False, reasons=True)
    told = lambda c: F.nullif(F.regexp_extract(c, r"^\[([A-Z_]+)", 1), F.lit(""))
    return out.select(*KEYS, "source_count", "target_count", "verdict", told("source_error").alias("source_reason"),
                      told("target_error").alias("target_reason"))


@plan("content_check", f"""
SELECT '{DATABASE}' AS database, t AS table_name, n AS source_count, n AS target_count, v AS verdict
FROM (SELECT count(*) AS n FROM events), (VALUES ('shifted', 'mismatch'), ('same', 'match')) AS x(t, v)""")
def q_content_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 on content: a copy in which values have moved across NULLs (every row
    has one value and one NULL, in the other column) has the right count and is a
    mismatch; an honest copy in another row order is a match."""
    base = work_dir(spark, "content_check")
    e = fx.base(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    a, b = F.when(even, F.col("event_type")), F.when(~even, F.col("event_type"))
    e.select("event_id", a.alias("a"), b.alias("b")).write.parquet(f"{base}/src")
    e.select("event_id", b.alias("a"), a.alias("b")).write.parquet(f"{base}/shifted")
    spark.read.parquet(f"{base}/src").repartition(3, "b").write.parquet(f"{base}/same")
    src = [TableRef(DATABASE, t, "parquet", f"{base}/src") for t in ("shifted", "same")]
    verdicts = verify_copies(spark, [(r, r.at(f"{base}/{r.table}")) for r in src])
    remove_dir(spark, base)
    return verdicts


__all__ = ["copy_and_verify", "source_refs"]
