"""Copy side: which tables need a copy (F1), target paths (P1), the copy plan
(C1), single copies (K1/K2/K3) and bulk copies with an outcome table (K4)."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import bounded_text, quote_name
from ..sources.tables import (SAME_FORMAT_PROVIDERS, TableRef, fingerprint_exprs, largest_first,
                             partition_columns, read_table, records, table_fingerprint)
from .journal import Journal, beside, file_system

OUTCOME_SCHEMA = ("database string, table_name string, curr_loc string, ext_loc string, "
                  "format string, copied_successfully boolean, action string, error string, "
                  "source_rows long, source_hash decimal(38,0)")

# Scheduler pool the copy submissions run in (FAIR mode shares the cluster
# between the concurrent copies instead of running them one after another).
COPY_POOL = "migrakit_copy"


def needs_copy_predicate(location: Column, provider: Column, prefix: str = "s3",
                         legacy: str = "hive") -> Column:
    """not on the object store, or on the legacy provider.  Three-valued:
    a NULL location with a non-legacy provider is not selected."""
    return (~location.startswith(prefix)) | (provider == legacy)


def needs_copy(df: DataFrame, prefix: str = "s3", legacy: str = "hive",
               location_col: str = "location", provider_col: str = "provider") -> DataFrame:
    """Tables that have to be copied.  Views and temporary tables are never
    copied (they have no files of their own)."""
    cond = needs_copy_predicate(F.col(location_col), F.col(provider_col), prefix, legacy)
    if "table_type" in df.columns:
        cond = cond & ~F.coalesce(F.col("table_type") == "VIEW", F.lit(False))
    if "is_temporary" in df.columns:
        cond = cond & ~F.coalesce(F.col("is_temporary"), F.lit(False))
    return df.where(cond)


def with_target_path(df: DataFrame, base: str, table_col: str = "table_name",
                     out: str = "ext_loc", schema_col: str = "database") -> DataFrame:
    """``base + '/' + schema + '/' + table``: equal table names in two schemas
    have targets of their own."""
    return df.withColumn(out, F.concat(F.lit(base.rstrip("/")), F.lit("/"), F.col(schema_col), F.lit("/"),
                                       F.col(table_col)))


def plan_copy(inventory: DataFrame, counts: DataFrame, base: str, prefix: str = "s3",
              legacy: str = "hive", keys: Sequence[str] = ("database", "table_name")) -> DataFrame:
    """Needs-copy tables with their source row count, partition columns
    (``partition_col_list``, from the inventory) and target path.

    ``counts`` is (keys..., n); a table may come as several count rows (its
    count is their sum, NULL when any part is NULL, as in ``verify_counts``);
    a table without a count row gets NULL.  The count aggregation is
    partitioned by the keys, so the join adds no shuffle on that side."""
    layout = next((c for c in ("partition_col_list", "partition_columns") if c in inventory.columns), None)
    parts = F.col(layout) if layout else F.lit(None)
    chosen = needs_copy(inventory, prefix, legacy).select(
        *keys, F.col("location").alias("curr_loc"), "provider",
        parts.cast("array<string>").alias("partition_col_list"))
    per_table = counts.groupBy(*keys).agg(
        F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("source_count"))
    planned = chosen.join(per_table, list(keys), "left")
    return with_target_path(planned, base)


def target_format(provider: str | None, to_format: str | None) -> str:
    """K1 keeps a same-format provider; K2 converts any other to ``to_format``."""
    if provider and provider.lower() in SAME_FORMAT_PROVIDERS and not to_format:
        return provider.lower()
    return to_format or "parquet"


def has_files(spark: SparkSession, location: str) -> bool:
    """Whether anything is there (an empty folder is nothing)."""
    fs, path = file_system(spark, location)
    return fs.exists(path) and not (fs.getFileStatus(path).isDirectory() and len(fs.listStatus(path)) == 0)


def _size(spark: SparkSession, location: str) -> dict:
    fs, path = file_system(spark, location)
    found = fs.getContentSummary(path)
    return {"files": found.getFileCount(), "bytes": found.getLength()}


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, path = file_system(spark, old)
    if not fs.rename(path, file_system(spark, new)[1]):
        raise OSError(f"cannot move {old} to {new}")


def _remove(spark: SparkSession, location: str) -> None:
    fs, path = file_system(spark, location)
    fs.delete(path, True)


def _recover(spark: SparkSession, location: str) -> None:
    """After a crash between the two moves of a publish the old target is put back."""
    if has_files(spark, location):
        return
    fs, pattern = file_system(spark, beside(location, "_old.", ".*"))
    for kept in fs.globStatus(pattern) or []:
        fs.delete(file_system(spark, location)[1], True)          # an empty folder
        _move(spark, kept.getPath().toString(), location)
        return


def _publish(spark: SparkSession, staged: str, location: str) -> None:
    """Puts a complete folder in the place of the target: the old one is moved
    aside, never deleted before the new one is there."""
    fs, path = file_system(spark, location)
    old = beside(location, "_old.", "." + uuid.uuid4().hex[:12])
    if fs.exists(path):
        _move(spark, location, old)
    _move(spark, staged, location)
    _remove(spark, old)


def table_at(spark: SparkSession, name: str) -> tuple[str, str] | None:
    """(location, provider) of a catalog table, None where there is none."""
    if not spark.catalog.tableExists(name):
        return None
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return rows.get("Location", ""), (rows.get("Provider") or "").lower()


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    def whole(location: str) -> str:
        fs, path = file_system(spark, location)
        return fs.makeQualified(path).toString().rstrip("/")
    return bool(a) and bool(b) and whole(a) == whole(b)


def register_copy(spark: SparkSession, name: str, location: str, fmt: str, df: DataFrame, parts: Sequence[str]) -> str:
    """Makes the catalog name stand for the folder: ``registered``, or ``known`` where
    it does already.  A name that stands for another folder is drift, and an
    error."""
    found = table_at(spark, name)
    if found and not same_place(spark, found[0], location):
        raise NameError(f"drift: {name} is registered at {found[0]}, the copy is at {location}")
    if found:
        spark.catalog.refreshTable(name)
    else:
        layout = f" PARTITIONED BY ({', '.join(quote_name(p) for p in parts)})" if parts else ""
        at = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({df._jdf.schema().toDDL()}) USING {fmt}{layout} LOCATION '{at}'")
    if parts:
        spark.catalog.recoverPartitions(name)
    return "known" if found else "registered"


def existing_layout(spark: SparkSession, src: TableRef, df: DataFrame) -> set[str]:
    """Columns the source is already partitioned by: from the catalog for a
    named table, else from the partition schema that Spark's file index found."""
    if src.name:
        return {c.name for c in spark.catalog.listColumns(src.name) if c.isPartition}
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    try:
        return set(leaves.apply(0).relation().partitionSchema().fieldNames())
    except Exception:  # noqa: BLE001 - not a file relation: it has no layout of its own
        return set()


def _held(spark: SparkSession, src: TableRef, df: DataFrame, location: str, fmt: str, log: Journal) -> tuple[str, dict]:
    """What an existing target is: ``skipped`` where the journal says that this
    source was copied there and the files are as they were left, or where its
    rows and content hash are the source's; else ``skipped_unverified``."""
    last, size = log.published(), _size(spark, location)
    if last and last["curr_loc"] == (src.location or src.name) and (last["files"], last["bytes"]) == (size["files"], size["bytes"]):
        return "skipped", {"rows": last["rows"], "hash": last["hash"]}
    try:
        mine = table_fingerprint(df).first()
        theirs = table_fingerprint(read_table(spark, src.at(location, provider=fmt), df.schema), df.columns).first()
    except Exception as e:  # noqa: BLE001 - files that cannot be read as the source is are no copy of it
        return "skipped_unverified", {"error": f"the target cannot be compared with the source: {e}"}
    if (mine["n"], mine["content_hash"]) != (theirs["n"], theirs["content_hash"]):
        return "skipped_unverified", {"error": f"the target holds other rows than the source ({theirs['n']} against {mine['n']})"}
    log.write("verified", rows=mine["n"], hash=str(mine["content_hash"]), **size)
    return "skipped", {"rows": mine["n"], "hash": str(mine["content_hash"])}


def copy_table(spark: SparkSession, src: TableRef, ext_loc: str, to_format: str | None = None,
               if_exists: str = "skip", target_name: str | None = None,
               max_records_per_file: int | None = None, fingerprint: bool = True) -> dict:
    """K1/K2/K3: copy one table to ``ext_loc``, keeping its partition layout.

    The copy is one distributed job.  Keeping the source's layout it is
    narrow: scan -> (local sort by partition columns, added by Spark) ->
    files, no shuffle, as each source file holds one partition value.  A new
    layout is written through a ``rebalance`` on the partition columns: one
    shuffle, after which AQE splits a hot value over several tasks and merges
    small ones, so files stay near the advisory size instead of one file per
    value per input task.  Lost executors only rerun their tasks.

    The job writes to a hidden folder beside the target, which is then moved into
    its place: a copy that breaks leaves the old target, and a target is never
    half written.  Every step is recorded in the target's journal.

    ``fingerprint``: the row count and content hash of what was written are
    observed in the write itself (``source_rows``, ``source_hash``), so the
    check of the copy need not read the source again.  The observation sits
    in the final (writing) stage, where Spark applies each task's metrics
    exactly once, also when tasks are retried.

    ``if_exists='skip'`` leaves any existing target untouched, whoever wrote it.  It
    is a success (``skipped``) only where the journal or the content shows that it
    is a copy of this source; else ``skipped_unverified``.  ``target_name``: the
    catalog name of the copy; an existing copy whose name is missing is
    registered (``registered``), a name that stands for another folder is
    ``drift``.  Never raises; the outcome says what happened."""
    fmt = target_format(src.provider, to_format)
    outcome = {"database": src.database, "table_name": src.table,
               "curr_loc": src.location or src.name, "ext_loc": ext_loc, "format": fmt,
               "copied_successfully": False, "action": "failed", "error": None,
               "source_rows": None, "source_hash": None}
    log = Journal(spark, ext_loc, **{k: outcome[k] for k in ("database", "table_name", "curr_loc", "ext_loc", "format")})
    try:
        if if_exists not in ("skip", "fail", "overwrite"):
            raise ValueError("if_exists is 'skip', 'fail' or 'overwrite'")
        _recover(spark, ext_loc)
        there = has_files(spark, ext_loc)
        if there and if_exists == "fail":
            raise FileExistsError(f"{ext_loc} exists")
        found = table_at(spark, target_name) if target_name else None
        if found and not same_place(spark, found[0], ext_loc):
            raise NameError(f"drift: {target_name} is registered at {found[0]}, the copy is at {ext_loc}")
        df = read_table(spark, src)
        parts = [c for c in partition_columns(spark, src) if c in df.columns]
        if there and if_exists == "skip":
            action, seen = _held(spark, src, df, ext_loc, fmt, log)
            if action == "skipped" and target_name and register_copy(spark, target_name, ext_loc, fmt, df, parts) == "registered":
                action = "registered"
                log.write("registered")
            outcome.update(copied_successfully=action != "skipped_unverified", action=action, error=seen.get("error"))
            return outcome
        plain = df
        if parts and not set(parts) <= existing_layout(spark, src, df):
            # A new layout: group rows by the partition columns so each value
            # is written by few tasks.  ``rebalance`` lets AQE split a hot
            # value into advisory-size pieces and merge small ones.
            df = df.hint("rebalance", *parts)
        observation = None
        if fingerprint:
            try:
                df.agg(*fingerprint_exprs(df.schema))           # analysed only: can these types be hashed?
                observation = Observation()
                df = df.observe(observation, *fingerprint_exprs(df.schema))
            except Exception:  # noqa: BLE001 - the copy goes on without a hash
                observation = None
        staged = beside(ext_loc, "_staged.", "." + log.fixed["run"])
        writer = df.write.format(fmt).mode("errorifexists")
        if parts:
            writer = writer.partitionBy(*parts)
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        log.write("started")
        try:
            writer.save(staged)
            metrics = observation.get if observation is not None else {}
            seen = {"rows": metrics.get("n"), "hash": None if metrics.get("content_hash") is None else str(metrics["content_hash"])}
            log.write("staged", **seen)
            if if_exists != "overwrite" and has_files(spark, ext_loc):
                raise FileExistsError(f"{ext_loc} was written by somebody else meanwhile")
            _publish(spark, staged, ext_loc)
        except Exception:
            _remove(spark, staged)
            raise
        log.write("published", **seen, **_size(spark, ext_loc))
        outcome.update(source_rows=metrics.get("n"), source_hash=metrics.get("content_hash"))
        if target_name:
            if found:                                          # the new files may have other columns
                spark.sql(f"DROP TABLE {target_name}")
            register_copy(spark, target_name, ext_loc, fmt, plain, parts)
            log.write("registered")
        outcome.update(copied_successfully=True, action="copied")
    except Exception as e:  # noqa: BLE001 - the outcome table carries it
        outcome.update(error=str(e), action="drift" if isinstance(e, NameError) else "failed")
        try:
            log.write("failed", error=str(e)[:2000])
        except Exception:  # noqa: BLE001 - a target that cannot be written beside has no record
            pass
    return outcome


def copy_tables(spark: SparkSession, tasks: Iterable[tuple[TableRef, str]],
                to_format: str | None = None, if_exists: str = "skip", max_workers: int = 8,
                target_names: dict | None = None) -> DataFrame:
    """K4: copy many tables concurrently; one outcome row per table.

    Tables that share a target (folder or name) are all refused before anything
    is written: none may overwrite or stand for another.

    The driver pool only submits jobs (each copy is a distributed job); jobs
    share the executors through the FAIR scheduler pool, largest table first.  One failure does not
    stop the rest.  The outcome schema is fixed, so zero tables work."""
    tasks = largest_first(spark, tasks, lambda t: t[0])
    target_names = target_names or {}
    local = threading.local()

    folders = Counter(loc.rstrip("/") for _, loc in tasks)
    names = Counter(n.lower() for n in target_names.values())

    def run(task):
        ref, loc = task
        name = target_names.get((ref.database, ref.table))
        if folders[loc.rstrip("/")] > 1 or (name and names[name.lower()] > 1):
            return {"database": ref.database, "table_name": ref.table, "curr_loc": ref.location or ref.name,
                    "ext_loc": loc, "format": target_format(ref.provider, to_format), "copied_successfully": False,
                    "action": "refused", "error": f"several tables have the target {name or loc}",
                    "source_rows": None, "source_hash": None}
        if not getattr(local, "pool_set", False):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", COPY_POOL)
            local.pool_set = True
        return copy_table(spark, ref, loc, to_format, if_exists, name)

    with ThreadPoolExecutor(max_workers=max(1, max_workers)) as pool:
        outcomes = list(pool.map(run, tasks))
    rows = [(o["database"], o["table_name"], o["curr_loc"], o["ext_loc"], o["format"],
             o["copied_successfully"], o["action"], o["error"], o["source_rows"], o["source_hash"])
            for o in outcomes]
    return records(spark, rows, OUTCOME_SCHEMA)


def source_ref(spark: SparkSession, database: str, table: str, provider: str | None, location: str | None,
               partitions: Sequence[str] = ()) -> TableRef:
    """A table of a plan: read by its catalog name where the catalog has it (so
    its reader options, schema and layout hold), else from its files."""
    name = quote_name(database, table)
    try:
        known = spark.catalog.tableExists(name)
    except Exception:  # noqa: BLE001 - not a name this catalog can have
        known = False
    return TableRef(database, table, provider, location, tuple(partitions), name if known else None)


def copy_from_plan(spark: SparkSession, plan: DataFrame, to_format: str | None = None,
                   if_exists: str = "skip", max_workers: int = 8) -> DataFrame:
    """C1 -> K4: run the copies a copy plan lists (database, table_name,
    curr_loc, provider, ext_loc; optional partition_col_list).  The plan's
    rows (one per table) are streamed to the driver; each copy is its own
    distributed job."""
    has_parts = "partition_col_list" in plan.columns
    tasks = [(source_ref(spark, r["database"], r["table_name"], r["provider"], r["curr_loc"],
                         (r["partition_col_list"] or ()) if has_parts else ()), r["ext_loc"])
             for r in plan.toLocalIterator()]
    return copy_tables(spark, tasks, to_format, if_exists, max_workers)


def bounded_error(df: DataFrame, col: str = "error", limit: int = 32000) -> DataFrame:
    """P6 on a frame."""
    return df.withColumn(col, bounded_text(F.col(col), limit))
