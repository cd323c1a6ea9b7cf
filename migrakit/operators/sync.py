"""Schema sync: the dry-run plan of what a sync would do (Y1, J3), its status
summaries (Y3, A1, A2), the views it cannot do (Y4) and the apply step (Y2)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import quote_name
from ..sources.tables import records
from .copying import copy_tables, needs_copy_predicate, same_place, source_ref, table_at
from .merge import both_sides, outer_match

KEYS = ("database", "table_name")

# Fixed status codes of a sync plan.
TO_CREATE = "TO_CREATE"
EXISTS = "EXISTS"
CHANGED = "CHANGED"
ORPHAN = "ORPHAN"
UNSUPPORTED = "UNSUPPORTED"
VIEWS_NOT_SUPPORTED = "VIEWS_NOT_SUPPORTED"
DUPLICATE = "DUPLICATE"
MOVED = "MOVED"
COLUMNS_CHANGED = "COLUMNS_CHANGED"

# Fixed kinds of a column's change.
ADDED, DROPPED, RETYPED, NULLABILITY, REORDERED = "ADDED", "DROPPED", "RETYPED", "NULLABILITY", "REORDERED"

SYNC_COLUMNS = ("source_schema", "source_name", "source_type", "source_provider",
                "target_provider", "location", "status_code")


def _place(location):
    """A location as it is compared: without slashes at its end; an empty one is none."""
    bare = F.rtrim(location, F.lit("/"))
    return F.when(bare != "", bare)


def plan_sync(src: DataFrame, dst: DataFrame, prefix: str = "s3", legacy: str = "hive",
              keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per table on either side with what a sync would do.

    ORPHAN: only in the target.  VIEWS_NOT_SUPPORTED: a source view.
    UNSUPPORTED: a temporary table, or one that must be copied (not on the
    object store, or on the legacy provider).  EXISTS / CHANGED: in both,
    same / other provider.  MOVED (only where ``dst`` has a ``location``): in both,
    same provider, over other files.  TO_CREATE: can be registered over its files.
    DUPLICATE: the key is repeated on a side; every distinct row of it is listed,
    with the other side's columns NULL.  Both sides are one union: equal rows go
    by a distinct with map-side partial aggregation, then a window over the key
    brings the two sides together.  No join, no writes."""
    tmp = F.col("is_temporary") if "is_temporary" in src.columns else F.lit(False)
    sides = both_sides(src, dst, keys, [F.col("table_type"), F.col("provider").alias("source_provider"),
                                        F.col("location"), tmp.alias("tmp")],
                       [F.col("provider").alias("target_provider"),
                        (F.col("location") if "location" in dst.columns else F.lit(None).cast("string")).alias("at")]).distinct()
    w = Window.partitionBy(*keys)
    m = sides.select(*keys, F.col("_l").alias("_own_l"), F.col("_r").alias("_own_r"), F.max("_l").over(w).alias("_l"),
                     F.max("_r").over(w).alias("_r"), F.count("_l").over(w).alias("_l_n"), F.count("_r").over(w).alias("_r_n"))
    single = (F.col("_l_n") <= 1) & (F.col("_r_n") <= 1)
    # A single match is told by its source row, or by the target row of an orphan.
    m = m.where(~single | F.col("_own_l").isNotNull() | (F.col("_l_n") == 0)).select(
        *keys, F.when(single, F.col("_l")).otherwise(F.col("_own_l")).alias("_l"),
        F.when(single, F.col("_r")).otherwise(F.col("_own_r")).alias("_r"), single.alias("_single"))
    in_src, in_dst = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    sp, tp = F.col("_l.source_provider"), F.col("_r.target_provider")
    external = F.coalesce(~needs_copy_predicate(F.col("_l.location"), sp, prefix, legacy), F.lit(False))
    status = (F.when(~F.col("_single"), DUPLICATE)
               .when(~in_src, ORPHAN)
               .when(F.col("_l.table_type") == "VIEW", VIEWS_NOT_SUPPORTED)
               .when(F.coalesce(F.col("_l.tmp"), F.lit(False)), UNSUPPORTED)
               .when(in_dst & sp.eqNullSafe(tp) & F.coalesce(_place(F.col("_l.location")) != _place(F.col("_r.at")), F.lit(False)), MOVED)
               .when(in_dst & sp.eqNullSafe(tp), EXISTS)
               .when(in_dst, CHANGED)
               .when(external, TO_CREATE)
               .otherwise(UNSUPPORTED))
    return m.select(F.col(keys[0]).alias("source_schema"), F.col(keys[1]).alias("source_name"),
                    F.col("_l.table_type").alias("source_type"), sp.alias("source_provider"),
                    tp.alias("target_provider"), F.col("_l.location").alias("location"),
                    status.alias("status_code"))


def column_changes(src: DataFrame, dst: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """J3/Y1 by column: one row per column that differs between two column
    inventories (keys, ``ordinal``, ``column_name``, ``data_type``, ``nullable``), for tables
    that are on both sides.

    ADDED / DROPPED: only in the source / target.  RETYPED, NULLABILITY: another
    type; the same type, but NULL is allowed on one side only.  REORDERED: the
    same, but at another place among the columns that both sides have.  DUPLICATE:
    listed twice, with different entries, on a side.  Names are compared
    without regard to letter case.  One aggregation by column and one window by table
    (a table's columns are few); no join."""
    one = [F.struct("column_name", "ordinal", "data_type", "nullable").alias("c")]
    named = lambda d: d.select(*keys, F.lower("column_name").alias("_c"), "column_name", "ordinal", "data_type", "nullable").distinct()
    m = outer_match(named(src), named(dst), [*keys, "_c"], one, one)
    table, common = Window.partitionBy(*keys), F.col("_l").isNotNull() & F.col("_r").isNotNull()
    m = m.withColumn("_both", F.max(F.col("_l").isNotNull()).over(table) & F.max(F.col("_r").isNotNull()).over(table)).where("_both")
    place = lambda side: F.row_number().over(Window.partitionBy(*keys, common).orderBy(F.col(f"{side}.c.ordinal"), "_c"))
    m = m.withColumn("_pl", place("_l")).withColumn("_pr", place("_r"))
    l, r = (lambda f: F.col(f"_l.c.{f}")), (lambda f: F.col(f"_r.c.{f}"))  # noqa: E741
    change = (F.when((F.col("_l_n") > 1) | (F.col("_r_n") > 1), DUPLICATE)
              .when(F.col("_r").isNull(), ADDED).when(F.col("_l").isNull(), DROPPED)
              .when(~l("data_type").eqNullSafe(r("data_type")), RETYPED)
              .when(~l("nullable").eqNullSafe(r("nullable")), NULLABILITY)
              .when(F.col("_pl") != F.col("_pr"), REORDERED))
    return m.select(F.col(keys[0]).alias("source_schema"), F.col(keys[1]).alias("source_name"),
                    F.coalesce(l("column_name"), r("column_name")).alias("column_name"), l("data_type").alias("source_type"),
                    r("data_type").alias("target_type"), change.alias("change")).where("change is not null")


def with_column_changes(sync: DataFrame, changes: DataFrame) -> DataFrame:
    """A sync plan with the number of changed columns of every table; a table that
    EXISTS with changed columns is COLUMNS_CHANGED."""
    keys = ["source_schema", "source_name"]
    n = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changed"), F.sort_array(F.collect_set("change")).alias("changes"))
    out = sync.join(n, keys, "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0).cast("long")))
    status = F.when((F.col("status_code") == EXISTS) & (F.col("n_changed") > 0), COLUMNS_CHANGED).otherwise(F.col("status_code"))
    return out.withColumn("status_code", status).withColumn("changes", F.array_join(F.coalesce("changes", F.array().cast("array<string>")), ","))


def sync_report(sync: DataFrame, dims: Sequence[str] = ("status_code", "source_type")) -> DataFrame:
    """Row counts per value of each dimension, in one pass
    (grouping sets: one scan and one shuffle for all dimensions).
    Output: dimension, value, n."""
    sets = [[F.col(d)] for d in dims]
    g = sync.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = None
    val = None
    for d in dims:
        hit = F.col(f"_g_{d}") == 0
        dim = F.when(hit, F.lit(d)) if dim is None else dim.when(hit, F.lit(d))
        val = F.when(hit, F.col(d).cast("string")) if val is None else val.when(hit, F.col(d).cast("string"))
    return g.select(dim.alias("dimension"), val.alias("value"), "n")


def views_of(sync: DataFrame) -> DataFrame:
    """The rows a sync cannot do because they are views."""
    return sync.filter(f"status_code = '{VIEWS_NOT_SUPPORTED}'")


def apply_sync(spark: SparkSession, sync: DataFrame, target_database: str | dict[str, str],
               statuses: Sequence[str] = (TO_CREATE,), max_workers: int = 8, mode: str = "register",
               base: str | None = None, to_format: str | None = None) -> DataFrame:
    """Y2: carry out the rows of a sync plan with the given statuses.

    ``mode='register'``: each table becomes an external table over its own
    files in ``target_database`` (metadata only, no data copied).
    ``mode='copy'``: each table is copied to ``base``/schema/table (K1/K2, read by
    name where the catalog has it, layout kept) and registered there; tables
    that would share a target name are refused.  ``target_database`` may map each
    source schema to its own.  Returns an outcome row per table: source_schema,
    source_name, target_name, status, error.  The plan rows are metadata (one
    per table) and are streamed to the driver, never the table data."""
    todo = sync.where(F.col("status_code").isin(list(statuses))).select(
        "source_schema", "source_name", "source_provider", "location")
    def target(schema: str) -> str:
        return target_database[schema] if isinstance(target_database, dict) else target_database

    if mode == "copy":
        if not base:
            raise ValueError("mode='copy' needs a base folder")
        rows = list(todo.toLocalIterator())
        tasks = [(source_ref(spark, r["source_schema"], r["source_name"], r["source_provider"], r["location"]),
                  f"{base.rstrip('/')}/{r['source_schema']}/{r['source_name']}") for r in rows]
        names = {(r["source_schema"], r["source_name"]): quote_name(target(r["source_schema"]), r["source_name"])
                 for r in rows}
        out = copy_tables(spark, tasks, to_format=to_format, max_workers=max_workers, target_names=names)
        named = records(spark, [(*k, n) for k, n in names.items()],
                        "source_schema string, source_name string, target_name string")
        return out.select(F.col("database").alias("source_schema"), F.col("table_name").alias("source_name"),
                          F.when(F.col("copied_successfully"), "success").when(F.col("action") == "drift", "drift")
                          .otherwise("failed").alias("status"),
                          "error").join(named, ["source_schema", "source_name"]).select(
            "source_schema", "source_name", "target_name", "status", "error")
    if mode != "register":
        raise ValueError("mode is 'register' or 'copy'")

    def one(r):
        name = quote_name(target(r["source_schema"]), r["source_name"])
        try:
            found = table_at(spark, name)
            if found and not (same_place(spark, found[0], r["location"]) and found[1] == (r["source_provider"] or "").lower()):
                return (r["source_schema"], r["source_name"], name, "drift", f"registered as {found[1]} at {found[0]}")
            if not found:
                spark.catalog.createTable(name, path=r["location"],
                                          source=r["source_provider"])
            return (r["source_schema"], r["source_name"], name, "success", None)
        except Exception as e:  # noqa: BLE001
            return (r["source_schema"], r["source_name"], name, "failed", str(e))

    # Registrations are independent catalog calls: a small pool runs them.
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        rows = list(pool.map(one, todo.toLocalIterator()))
    return records(spark,
        rows, "source_schema string, source_name string, target_name string, status string, error string")
