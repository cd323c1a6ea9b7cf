"""Inventory from a live catalog, one row per table.  All of it is metadata: one
bulk listing per database, run from a small driver pool, whose texts are read as
columns.  A table whose text can be read in more than one way, and the tables of
a database whose listing fails, are described one by one; the describe rows
become a DataFrame and the pivot (P8) runs in Spark."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import quote_ident, quote_name
from ..operators.projections import attributes_wide
from .tables import records, union_all

# The describe rows an inventory keeps.
DESCRIBE_KEYS = ("Provider", "Location", "Owner", "Type", "View Text")
ERROR_KEY = "Error"
DETAILS = "# Detailed Table Information"
# The lines of a listing's text that an inventory reads.
LISTING_KEYS = ("Owner", "Type", "Provider", "View Text", "View Original Text", "Location", "Partition Columns", "Schema")
LONG_SCHEMA = "database string, table_name string, ordinal long, attr string, val string"


def list_tables(spark: SparkSession, databases: Sequence[str], max_workers: int = 8) -> DataFrame:
    """(database, table_name, is_temporary, error) of every table and view; a
    database that cannot be listed is one row with a NULL table and its error."""
    def one(db):
        try:
            return [(db, t.name, bool(t.isTemporary), None) for t in spark.catalog.listTables(db)]
        except Exception as e:  # noqa: BLE001
            return [(db, None, None, str(e))]

    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        rows = [r for part in pool.map(one, databases) for r in part]
    return records(spark, rows, "database string, table_name string, is_temporary boolean, error string")


def describe_long(spark: SparkSession, tables: Sequence[tuple[str, str]], max_workers: int = 8) -> DataFrame:
    """The ``DESCRIBE TABLE EXTENDED`` rows of each (database, table) as
    (database, table_name, ordinal, attr, val); a table whose describe fails
    is one row with attr ``Error``.  Only the rows an inventory keeps, and the
    attributes asked for, leave the call."""
    def one(t):
        db, name = t
        try:
            rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quote_name(db, name)}").collect()
            after = max((i for i, r in enumerate(rows) if r["col_name"] == DETAILS), default=-1)   # columns may have these names
            return [(db, name, i, r["col_name"], r["data_type"]) for i, r in enumerate(rows)
                    if i > after and r["col_name"] in DESCRIBE_KEYS]
        except Exception as e:  # noqa: BLE001
            return [(db, name, 0, ERROR_KEY, str(e))]

    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        rows = [r for part in pool.map(one, tables) for r in part]
    return records(spark, rows, LONG_SCHEMA)


def read_listing(information: Column) -> dict[str, Column]:
    """The attributes in the text of ``SHOW TABLE EXTENDED``, by the columns of an
    inventory, and ``plain``: whether the text can be read in one way only.

    Comments, properties and view texts may hold any line.  A key at the start of two
    lines, a view text without its end and a partition list that does not
    stand before the schema are not plain."""
    text = F.concat(F.lit("\n"), information)

    def times(key):
        return F.size(F.split(text, f"\n{key}: ")) - 1

    def found(pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    kind = found(r"\nType: ([^\n]*)")
    view = F.coalesce(F.upper(kind) == "VIEW", F.lit(False))
    listed = found(r"\nPartition Columns: \[([^\n]*)\]\nSchema: root\n")
    names = F.transform(F.regexp_extract_all(listed, F.lit(r"`((?:[^`]|``)*+)`"), F.lit(1)), lambda n: F.replace(n, F.lit("``"), F.lit("`")))
    plain = ((times("View Text") == times("View Original Text"))
             & ((times("Partition Columns") == 0) | listed.isNotNull()) & kind.isNotNull())
    for key in LISTING_KEYS:
        plain &= times(key) <= 1
    return {
        "provider": found(r"\nType: [^\n]*\nProvider: ([^\n]*)"),
        "location": F.when(~view, found(r"\nLocation: ([^\n]*)")),
        # The owner stands above the type, and no text of a user does.
        "owner": F.nullif(F.regexp_extract(F.substring_index(text, "\nType: ", 1), r"\nOwner: ([^\n]*)", 1), F.lit("")),
        "table_type": kind,
        "view_text": F.when(view, found(r"(?s)\nView Text: (.*?)\nView Original Text: ")),
        "partition_columns": F.coalesce(names, F.array().cast("array<string>")),
        "plain": plain}


def list_extended(spark: SparkSession, databases: Sequence[str], max_workers: int = 8) -> tuple[DataFrame | None, list[str]]:
    """One bulk listing per database, each an attribute of ``read_listing`` per column
    with (database, table_name, is_temporary); and the databases whose listing fails as a whole."""
    def one(db):
        try:
            rows = spark.sql(f"SHOW TABLE EXTENDED IN {quote_ident(db)} LIKE '*'")
            return rows.select(F.lit(db).alias("database"), F.col("tableName").alias("table_name"),
                               F.col("isTemporary").alias("is_temporary"),
                               *[c.alias(n) for n, c in read_listing(F.col("information")).items()])
        except Exception:  # noqa: BLE001 - the tables are described one by one, which names the fault
            return db

    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        parts = list(pool.map(one, databases))
    frames = [p for p in parts if isinstance(p, DataFrame)]
    return (union_all(frames) if frames else None), [p for p in parts if isinstance(p, str)]


def described(spark: SparkSession, listed: DataFrame, max_workers: int = 8) -> DataFrame:
    """The inventory columns of the rows of ``list_tables``, by two catalog calls per table."""
    pairs = [(r.database, r.table_name) for r in listed.where("table_name IS NOT NULL").toLocalIterator()]
    long = describe_long(spark, pairs, max_workers)
    wide = attributes_wide(
        long.select(F.to_json(F.array("database", "table_name")).alias("entity"), "ordinal", "attr", "val"),
        (*DESCRIBE_KEYS, ERROR_KEY), missing=None)

    def parts(t):
        db, name = t
        try:
            return (db, name, [c.name for c in spark.catalog.listColumns(quote_name(db, name)) if c.isPartition])
        except Exception:  # noqa: BLE001
            return (db, name, [])

    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        part_rows = list(pool.map(parts, pairs))
    partitions = records(spark, part_rows, "database string, table_name string, partition_columns array<string>")
    return (listed.withColumnRenamed("error", "list_error").withColumn("entity", F.to_json(F.array("database", "table_name")))
            .join(wide, "entity", "left").join(partitions, ["database", "table_name"], "left")
            .select("database", "table_name", "is_temporary", F.col("Provider").alias("provider"), F.col("Location").alias("location"),
                    F.col("Owner").alias("owner"), F.col("Type").alias("table_type"), F.col("View_Text").alias("view_text"),
                    "partition_columns", F.coalesce("list_error", F.col("Error")).alias("error")))


def inventory_from_catalog(spark: SparkSession, databases: Sequence[str]) -> DataFrame:
    """(database, table_name, provider, location, owner, table_type,
    view_text, is_temporary, partition_columns, error) per table, the shape the
    copy and sync operators take.  ``table_type`` is VIEW for views, TABLE else.
    What cannot be listed or described stays in the inventory with its error."""
    bulk, unlisted = list_extended(spark, databases)
    frames = []
    if bulk is not None:
        frames.append(bulk.where("plain").drop("plain").withColumn("error", F.lit(None).cast("string")))
        doubtful = bulk.where("NOT plain").select("database", "table_name", "is_temporary").collect()
        if doubtful:
            listed = records(spark, [(*r, None) for r in doubtful], "database string, table_name string, is_temporary boolean, error string")
            frames.append(described(spark, listed))
    if unlisted or not frames:
        frames.append(described(spark, list_tables(spark, unlisted)))
    return union_all(frames).select(
        "database", "table_name", F.lower("provider").alias("provider"), "location", "owner",
        F.when(F.upper("table_type") == "VIEW", "VIEW").otherwise("TABLE").alias("table_type"),
        "view_text", "is_temporary", "partition_columns", "error")
